"""Registered queries over references, with texts made from lines of orders; the SQL knows what each text says and reads none."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafweave.operators import references
from leafweave.plans.registry import lines_by_order, query

S = "(l_partkey + l_linenumber) % 10"
FIELDS = {
    "doc_id": "l_orderkey",
    "node_id": "l_orderkey * 10 + l_linenumber",
    "document_order": "l_linenumber",
    "text": f"CASE {S} WHEN 0 THEN 'FIG. ' || (l_suppkey % 3) || '. A result.' WHEN 1 THEN 'It is shown in Figure ' || (l_suppkey % 3) || ' and Table II here.' WHEN 2 THEN 'TABLE II: values' WHEN 3 THEN '\\\\[x=y. \\\\quad (' || (l_suppkey % 2) || ') \\\\]' WHEN 4 THEN 'where x is the value. It holds.' WHEN 5 THEN 'These new methods reduce noise.' WHEN 6 THEN 'Then, as discussed above the sum' WHEN 7 THEN 'See Section 3.' || (l_suppkey % 3) || ' and Eq. (' || (l_suppkey % 2) || ').' WHEN 8 THEN '<TABLE><tr>' ELSE 'Such words, no more' END",
    "evidence_type": f"CASE {S} WHEN 0 THEN 'caption' WHEN 2 THEN 'caption' WHEN 3 THEN 'formula' WHEN 8 THEN 'table' ELSE 'text' END",
    "section_id": "CASE WHEN l_linenumber <= 3 THEN 's1' WHEN l_linenumber = 4 THEN NULL ELSE 's2' END",
    "title": "CASE WHEN l_suppkey % 4 = 0 THEN '3.' || (l_partkey % 3) || ' Methods' ELSE 'Methods' END",
    "content_item_id": "CASE WHEN l_linenumber <= 4 THEN 'a' ELSE 'b' END",
    "possible_continuation": "l_partkey % 2 = 0",
}
_COLS = ", ".join(f"{e} AS {k}" for k, e in FIELDS.items() if k != "text")
NODES = rf"""u AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), n AS (SELECT {_COLS}, {S} AS s, l_suppkey % 3 AS k3, l_suppkey % 2 AS k2, l_partkey % 3 AS t3, l_suppkey % 4 = 0 AS titled FROM u),
d AS (SELECT doc_id, 'figure' AS kind, k3::VARCHAR AS label, node_id, section_id, content_item_id FROM n WHERE s = 0 UNION ALL SELECT doc_id, 'table', 'II', node_id, section_id, content_item_id FROM n WHERE s = 2
  UNION ALL SELECT doc_id, 'equation', k2::VARCHAR, node_id, section_id, content_item_id FROM n WHERE s = 3
  UNION ALL (SELECT doc_id, 'section', '3.' || t3, node_id, section_id, content_item_id FROM n WHERE titled QUALIFY row_number() OVER (PARTITION BY doc_id, t3 ORDER BY document_order) = 1)),
m AS (SELECT doc_id, node_id AS source, section_id, content_item_id, 0 AS place, 'figure' AS kind, k3::VARCHAR AS label, 'Figure ' || k3 AS cue FROM n WHERE s = 1 UNION ALL SELECT doc_id, node_id, section_id, content_item_id, 1, 'table', 'II', 'Table II' FROM n WHERE s = 1
  UNION ALL SELECT doc_id, node_id, section_id, content_item_id, 0, 'section', '3.' || k3, 'Section 3.' || k3 FROM n WHERE s = 7 UNION ALL SELECT doc_id, node_id, section_id, content_item_id, 1, 'equation', k2::VARCHAR, 'Eq. (' || k2 || ')' FROM n WHERE s = 7),
j AS (SELECT m.*, (SELECT count(*) FROM d WHERE d.doc_id = m.doc_id AND d.kind = m.kind AND d.label = m.label) AS c1, (SELECT min(node_id) FROM d WHERE d.doc_id = m.doc_id AND d.kind = m.kind AND d.label = m.label) AS i1,
  (SELECT count(*) FROM d WHERE d.doc_id = m.doc_id AND d.kind = m.kind AND d.label = m.label AND d.content_item_id = m.content_item_id) AS c2, (SELECT min(node_id) FROM d WHERE d.doc_id = m.doc_id AND d.kind = m.kind AND d.label = m.label AND d.content_item_id = m.content_item_id) AS i2,
  (SELECT count(*) FROM d WHERE d.doc_id = m.doc_id AND d.kind = m.kind AND d.label = m.label AND d.section_id = m.section_id) AS c3, (SELECT min(node_id) FROM d WHERE d.doc_id = m.doc_id AND d.kind = m.kind AND d.label = m.label AND d.section_id = m.section_id) AS i3 FROM m),
g AS (SELECT *, CASE WHEN c1 = 1 THEN i1 WHEN c2 = 1 THEN i2 WHEN c3 = 1 THEN i3 END AS target FROM j)"""
BACK = r"""r AS (SELECT *, sum(CASE WHEN rn > 1 AND ls IS DISTINCT FROM section_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY document_order) AS run FROM (SELECT *, row_number() OVER w AS rn, lag(section_id) OVER w AS ls FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY document_order))),
x AS (SELECT r.*, (SELECT max_by(p.node_id, p.document_order) FROM r p WHERE p.doc_id = r.doc_id AND p.run = r.run AND p.document_order < r.document_order AND p.evidence_type <> 'caption') AS prior FROM r),
q AS (SELECT n.node_id, n.doc_id, n.section_id, lag(node_id, 1) OVER w AS a1, lag(node_id, 2) OVER w AS a2, lag(node_id, 3) OVER w AS a3, lag(section_id, 1) OVER w AS s1, lag(section_id, 2) OVER w AS s2, lag(section_id, 3) OVER w AS s3, lag(evidence_type, 1) OVER w AS t1, lag(evidence_type, 2) OVER w AS t2, lag(possible_continuation, 1) OVER w AS p1, lag(possible_continuation, 2) OVER w AS p2, lag(possible_continuation, 3) OVER w AS p3 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY document_order)),
ro AS (SELECT node_id, CASE WHEN p1 AND s1 IS NOT DISTINCT FROM section_id THEN a1 WHEN t1 IN ('caption', 'figure', 'table') AND p2 AND s2 IS NOT DISTINCT FROM section_id THEN a2 WHEN t1 IN ('caption', 'figure', 'table') AND t2 IN ('caption', 'figure', 'table') AND p3 AND s3 IS NOT DISTINCT FROM section_id THEN a3 END AS root FROM q),
b AS (SELECT x.doc_id, x.node_id AS source, x.prior AS target, 'where x is the value' AS cue, 'formula_where_backreference' AS rule, 0.98 AS confidence, 1000 AS seq FROM x JOIN n p ON p.node_id = x.prior WHERE x.s = 4 AND p.s = 3
  UNION ALL SELECT doc_id, node_id, prior, 'These new methods', 'demonstrative_anaphora', 0.90, 1001 FROM x WHERE s = 5 AND prior IS NOT NULL
  UNION ALL SELECT x.doc_id, x.node_id, ro.root, 'These new methods', 'demonstrative_continuation_group', 0.88, 1002 FROM x JOIN ro ON ro.node_id = x.prior WHERE x.s = 5 AND ro.root IS NOT NULL
  UNION ALL SELECT doc_id, node_id, prior, 'as discussed above', 'explicit_backward_cue', 0.90, 1003 FROM x WHERE s = 6 AND prior IS NOT NULL)"""
ALL = "a AS (SELECT doc_id, source, target, cue, 'explicit_label' AS rule, 1.0 AS confidence, place AS seq FROM g WHERE target IS NOT NULL UNION ALL SELECT doc_id, source, target, cue, rule, confidence, seq FROM b), e AS (SELECT doc_id, source, target, cue, rule, confidence::DOUBLE AS confidence FROM a WHERE source <> target QUALIFY row_number() OVER (PARTITION BY doc_id, source, target ORDER BY confidence DESC, seq) = 1)"


def _nodes(spark, sf):
    n = lines_by_order(spark, sf, "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    n = n.selectExpr(*(f"{e} as {k}" for k, e in FIELDS.items()))
    return n.withColumn("section_path", F.array("title"))


@query(f"WITH {NODES} SELECT doc_id, kind, label, node_id FROM d")
def reference_targets(spark, sf):
    return references.targets(_nodes(spark, sf)).select("doc_id", "kind", "label", "node_id")


@query(f"WITH {NODES} SELECT doc_id, source, place, kind, label, cue, target, CASE WHEN target IS NULL THEN CASE WHEN c1 = 0 THEN 'target_not_found' ELSE 'target_not_unique' END END AS reason, c1 AS candidates FROM g")
def grounded_mentions(spark, sf):
    return references.grounded(_nodes(spark, sf))


@query(f"WITH {NODES}, {BACK} SELECT x.doc_id, x.node_id, x.prior, ro.root FROM x JOIN ro USING (node_id)")
def previous_content(spark, sf):
    return references.with_previous(_nodes(spark, sf)).select("doc_id", "node_id", F.col("prior.node_id").alias("prior"), "root")


@query(f"WITH {NODES}, {BACK}, {ALL} SELECT * FROM e")
def reference_edges(spark, sf):
    return references.reference_edges(_nodes(spark, sf))


@query(f"WITH {NODES}, {BACK}, {ALL}, f AS (SELECT node_id AS target, s, lead(s) OVER w AS ns, lead(node_id) OVER w AS table_body FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY document_order)) SELECT doc_id, source, target, table_body, cue FROM e JOIN f USING (target) WHERE f.s = 2 AND f.ns = 8")
def granularity_warnings(spark, sf):
    n = _nodes(spark, sf)
    return references.granularity_warnings(n, references.reference_edges(n))
