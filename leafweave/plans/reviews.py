"""Registered queries over reviews of blocks and selections of nodes. Blocks are documents cut every ten words; their layout is derived from keys, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import text as tx
from leafweave.operators import review, selection
from leafweave.plans.decisions import QUOTA, SEQ, _pairs, _seq
from leafweave.plans.registry import ROLES, _roles, _turns, query, t

# --- fragments ----------------------------------------------------------------------------------

PIECE = r"(?:[^ \n]+ ){0,9}[^ \n]+"
STATE = rf"""pc AS (SELECT doc_id, unnest(a) AS text, unnest(range(len(a))) AS block_no FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE}') AS a FROM documents WHERE text IS NOT NULL)),
bl AS (SELECT *, block_no // 12 AS page, block_no % 11 = 10 AS caption, block_no % 13 = 5 AS header, CASE WHEN block_no % 3 <> 1 THEN block_no // 9 END AS region, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS s FROM pc),
op AS (SELECT *, NOT caption AND NOT header AS prose, regexp_matches(s, '^(?:\p{{Ll}}|[,.;:)\]}}–—-])') AS continues, CASE WHEN s = '' THEN 'empty_text' WHEN regexp_matches(s, '[\p{{L}}\p{{N}}_]-$') THEN 'ends_with_hyphenated_word'
  WHEN regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:a|an|the|and|or|but|of|to|in|on|at|for|from|with|by|as|that|which|is|are|was|were)$') THEN 'ends_with_unfinished_phrase'
  WHEN NOT regexp_matches(s, '[.!?][\]\)\}}"''’”]*$') THEN 'does_not_end_with_terminal_punctuation' END AS open,
  len(regexp_extract_all(s, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+')) AS words, length(regexp_replace(s, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(s, '[^\p{{Lu}}]+', '', 'g')) AS capitals FROM bl),
fr AS (SELECT *, CASE WHEN s <> '' AND prose AND NOT (words BETWEEN 1 AND 10 AND letters > 0 AND capitals / greatest(1, letters) >= 0.8)
    THEN coalesce(open, CASE WHEN continues THEN 'lowercase_or_continuation_prefix' WHEN length(s) <= 40 AND len(string_split_regex(s, '\s+')) <= 8 AND NOT regexp_matches(s, '[.!?]$') THEN 'very_short_nonterminal_text' END) END AS reason,
  open IS NOT NULL AS o, lag(page) OVER w AS pp, lead(page) OVER w AS np FROM op WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
ng AS (SELECT *, CASE WHEN pp = page THEN lag(block_no) OVER w END AS pb, CASE WHEN np = page THEN lead(block_no) OVER w END AS nb, lag(o) OVER w AS po, lag(prose) OVER w AS pt, lag(region) OVER w AS pr, lead(continues) OVER w AS nc, lead(prose) OVER w AS nt, lead(region) OVER w AS nr FROM fr WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
ev AS (SELECT *, pb IS NOT NULL AND po AND continues AS after, nb IS NOT NULL AND o AND nc AS before, pb IS NOT NULL AND nb IS NOT NULL AND po AND o AS both_open, pb IS NOT NULL AND nb IS NOT NULL AND pt AND nt AS both_prose FROM ng WHERE reason IS NOT NULL),
br AS (SELECT *, region IS NULL AS unmatched, both_prose AND coalesce(pr = nr, false) AS same_region, after OR before OR both_open AS bridge FROM ev),
prop AS (SELECT doc_id, page, block_no, reason, unmatched, same_region, bridge, CASE WHEN unmatched AND bridge AND same_region THEN 'HIGH' WHEN unmatched AND bridge AND both_prose THEN 'MEDIUM' END AS confidence,
  CASE WHEN after THEN pb WHEN before THEN nb END AS target_no, CASE WHEN after THEN 'attach_after_previous' WHEN before THEN 'attach_before_next' ELSE 'ambiguous_target' END AS direction FROM br)"""


def _pieces(spark, sf):
    p = t(spark, sf, "documents").where("text is not null").repartition("doc_id").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("n", "text"))
    n = F.col("n").cast("long")
    p = p.select("doc_id", n.alias("block_no"), F.floor(n / 12).cast("long").alias("page"), "text", F.when(n % 11 == 10, "caption").otherwise("text").alias("block_type"), F.when(n % 13 == 5, "header").alias("label"), F.lit(None).cast("string").alias("region_role"), F.when(n % 3 != 1, F.floor(n / 9).cast("long")).alias("region"))
    return p.withColumn("unmatched", review.unmatched(F.col("region"), F.array().cast("array<string>"), F.when(F.col("region").isNotNull(), "layout")))


@query(f"WITH {STATE} SELECT * FROM prop")
def fragment_proposals(spark, sf):
    return review.fragment_proposals(_pieces(spark, sf))


@query(
    f"""WITH {STATE}, h AS (SELECT doc_id, block_no, target_no FROM prop WHERE confidence = 'HIGH' AND target_no IS NOT NULL), f AS (SELECT h.* FROM h ANTI JOIN (SELECT doc_id, block_no AS target_no FROM h) x USING (doc_id, target_no)),
g AS (SELECT op.doc_id, coalesce(target_no, block_no) AS block_no, string_agg(s, ' ' ORDER BY block_no) FILTER (WHERE s <> '') AS text, count(*) - 1 AS absorbed FROM op LEFT JOIN f USING (doc_id, block_no) GROUP BY op.doc_id, coalesce(target_no, block_no))
SELECT doc_id, block_no, md5(coalesce(text, '')) AS text_md5, absorbed FROM g"""
)
def fragment_attachments(spark, sf):
    b = _pieces(spark, sf)
    return review.attach_fragments(b, review.fragment_proposals(b)).select("doc_id", "block_no", F.md5("text").alias("text_md5"), "absorbed")


# --- roles and trust ----------------------------------------------------------------------------


@query(
    "WITH "
    + ROLES
    + r""", r AS (SELECT doc_id, block_no, role, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS s, block_no % 17 = 4 AS template, block_no % 2 = 0 AS unmatched, (doc_id + page) % 5 AS p FROM roles),
v AS (SELECT *, regexp_replace(s, '\s+', '', 'g') AS seen FROM r)
SELECT doc_id, block_no, role, CASE WHEN template AND role NOT IN ('document_title', 'author_metadata', 'publication_metadata', 'identifier_metadata') THEN 'template' WHEN role <> 'evidence_content' THEN role
  WHEN s IN ('→', '←', '↑', '↓', 'i', '☐', '□', '■', '●', '•') OR (length(seen) <= 2 AND NOT regexp_matches(seen, '[\p{L}\p{N}]')) THEN 'template'
  WHEN p = 0 AND (regexp_matches(s, '^\s*[•▪◦‣*-]\s*\S') OR length(s) <= 180 OR unmatched) THEN 'navigation' WHEN p = 1 THEN 'advertisement'
  WHEN regexp_matches(s, '(?i)(?:https?://|www\.|\b[a-z0-9-]+\.(?:com|org|net|it|de|io)\b|@)') AND length(s) <= 40 AND unmatched THEN 'template' ELSE role END AS routed FROM v"""
)
def role_routing(spark, sf):
    n, p = F.col("block_no"), (F.col("doc_id") + F.col("page")) % 5
    b = _roles(spark, sf).withColumn("page_role", F.when(p == 0, "NAVIGATION").when(p == 1, "FULL_AD").otherwise("ARTICLE_OR_MIXED"))
    return review.route_roles(b.withColumn("template", n % 17 == 4).withColumn("unmatched", n % 2 == 0)).select("doc_id", "block_no", "role", "routed")


FLAGS = {"inside_complex_layout_container": 2, "metadata_or_advertisement_keyword": 3, "repeated_bigram_loop": 5, "phone_number_detected": 7, "text_density_extreme_outlier_for_bbox": 11, "text_inside_visual_region_possible_valid": 13, "low_unique_token_ratio": 4}


@query(
    r"""WITH f AS (SELECT doc_id, text, lower(text) AS low, doc_id % 2 = 0 AS box, doc_id % 3 = 0 AS kw, doc_id % 5 = 0 AS lo, doc_id % 7 = 0 AS ph, doc_id % 11 = 0 AS de, doc_id % 13 = 0 AS vis, doc_id % 4 = 0 AS lu, doc_id % 17 = 0 AS title,
  regexp_matches(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS em, regexp_matches(text, '(?i)\b(?:https?://|www\.)[^\s<>()]+') AS ur FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
a AS (SELECT *, 0.02 * box::INT + 0.28 * kw::INT + 0.40 * lo::INT + 0.25 * ph::INT + 0.40 * de::INT + 0.22 * lu::INT + 0.12 * em::INT + 0.10 * ur::INT + 0.08 * (box AND ph)::INT + 0.12 * (box AND kw)::INT + 0.20 * (ph AND (lo OR lu))::INT AS w, ph OR em OR ur AS ent FROM f),
b AS (SELECT *, CASE WHEN vis THEN CASE WHEN ent OR kw OR lo OR de THEN greatest(0, w - 0.12) ELSE 0 END ELSE w END AS x FROM a),
c AS (SELECT *, round(least(1, CASE WHEN (title OR starts_with(low, 'fig.') OR starts_with(low, 'figure ') OR contains(low[1:80], 'top notch')) AND NOT (ent OR kw OR lo) THEN least(x, 0.2) ELSE x END)::DOUBLE, 6) AS risk_score FROM b),
d AS (SELECT *, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level FROM c),
s AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN kw AND box AND risk_level <> 'low' THEN 'metadata_only' WHEN risk_level = 'high' AND (de OR lo) THEN 'quarantined' WHEN ent AND risk_level <> 'low' THEN 'entity_masked'
  WHEN risk_level = 'medium' THEN 'needs_review' WHEN risk_level = 'high' THEN 'quarantined' ELSE 'accepted' END AS status FROM d)
SELECT doc_id, risk_score, risk_level, status, status = 'accepted' AS use_for_embedding, (ent OR de OR lo OR kw) AND text <> '' AS needs_second_reading, md5(CASE WHEN status IN ('accepted', 'needs_review') THEN text WHEN status = 'entity_masked' THEN
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_reduce(phones, lambda t, p: replace(t, p, '[UNVERIFIED_PHONE]'), text), '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[UNVERIFIED_EMAIL]', 'g'), '(?i)\b(?:https?://|www\.)[^\s<>()]+', '[UNVERIFIED_URL]', 'g'), '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b', '[UNVERIFIED_DOI]', 'g'), '(?i)\b(?:ISBN(?:-1[03])?:?\s*)?(?:97[89][-\s]?)?\d[-\s]?\d{2,5}[-\s]?\d{2,7}[-\s]?\d[-\s]?[0-9X]\b', '[UNVERIFIED_ISBN]', 'g') ELSE '' END) AS index_md5 FROM (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i)\b(?:tel|telephone|phone|fax|mobile|mob)\.?\s*[:：]?\s*(\+?\d[\d\s().\-]{5,}\d)', 1) || regexp_extract_all(text, '(?:^|\W)(\+\d[\d\s().\-]{6,}\d)(?:\W|$)', 1),
  lambda x: length(regexp_replace(x, '\D', '', 'g')) BETWEEN 7 AND 16 AND length(regexp_replace(x, '[^.]+', '', 'g')) <= 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS phones FROM s)"""
)
def verification_decisions(spark, sf):
    """Flags of e-mails and addresses from the text, the others from keys."""
    e = tx.entities(F.col("text"))
    found = [F.when(F.size(e[k]) > 0, f) for k, f in (("email", "email_detected"), ("url", "url_detected"))]
    flags = F.array_compact(F.array(*(F.when(F.col("doc_id") % k == 0, x) for x, k in FLAGS.items()), *found))
    d = t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 17 == 0, "Caption").alias("title"))
    v = review.verify(d.withColumn("flags", flags))
    return v.select("doc_id", "risk_score", "risk_level", "status", "use_for_embedding", "needs_second_reading", F.md5("index_text").alias("index_md5"))


@query(
    """WITH b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS block_id, l_partkey FROM lineitem),
r AS (SELECT page, block_id, CASE l_partkey % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN '' END AS type, unnest([l_partkey % 3, 3 + l_partkey % 2]) AS region FROM b)
SELECT page, region, arg_min(type, block_id) FILTER (WHERE type <> '') AS type, count(*) AS blocks, count(*) >= 2 AS container FROM r GROUP BY page, region"""
)
def region_containers(spark, sf):
    return review.region_containers(_lines_in_regions(spark, sf))


def _lines_in_regions(spark, sf):
    k = F.col("l_partkey")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).cast("long")
    kind = F.when(k % 4 == 0, "figure").when(k % 4 == 1, "table").when(k % 4 == 2, "")
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), i.alias("block_id"), kind.alias("region_type"), F.array(k % 3, 3 + k % 2).alias("regions"))


@query()
def block_flags(spark, sf):
    """Documents as blocks, ten a page."""
    d = F.col("doc_id")
    b = t(spark, sf, "documents").select(F.floor(d / 10).alias("page"), d.alias("block_id"), "text", F.array(d % 3, 3 + d % 4).alias("regions"), F.when(d % 4 == 0, "figure").when(d % 4 == 1, "table").alias("region_type"))
    return review.block_flags(b).select("page", "block_id", F.array_join("flags", ",").alias("flags"))


@query()
def second_readings(spark, sf):
    """Each turn beside the next of its conversation as if that were another reading of it."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("second"))
    return review.second_reading(c).select("conv_id", "turn", F.round("overlap", 6).alias("overlap"), F.array_join("disagreement", ",").alias("disagreement"))


# --- selections ---------------------------------------------------------------------------------

UNITS = """nod AS (SELECT l_suppkey % 50 AS doc_id, row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS idx FROM lineitem),
n AS (SELECT *, floor(sqrt(idx))::BIGINT AS unit FROM nod), u AS (SELECT doc_id, unit, count(*) AS n, min(idx) AS first FROM n GROUP BY ALL)"""


def _nodes(spark, sf):
    d = F.col("l_suppkey") % 50
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    n = t(spark, sf, "lineitem").select(d.alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("idx", i)
    return n.select("doc_id", "idx", F.floor(F.sqrt("idx")).cast("long").alias("unit"))


@query(f"WITH {UNITS}, b AS (SELECT * FROM u WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1) SELECT doc_id, unit, idx FROM n SEMI JOIN b USING (doc_id, unit) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 25")
def article_pilot(spark, sf):
    return selection.article_pilot(_nodes(spark, sf))


@query(
    f"""WITH {UNITS}, p AS (SELECT *, lead(unit) OVER w AS r, lead(n) OVER w AS nr FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
b AS (SELECT *, least(n, 12) AS a0, least(nr, 25 - least(n, 12)) AS b0 FROM p WHERE n + nr >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY least(n, nr) DESC, unit DESC, r DESC) = 1),
c AS (SELECT *, CASE WHEN a0 + b0 < 20 THEN least(n, 25 - b0) ELSE a0 END AS a1 FROM b)
SELECT n.doc_id, n.unit, idx FROM n JOIN c ON n.doc_id = c.doc_id AND n.unit = c.unit QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY idx DESC) <= a1
UNION ALL SELECT n.doc_id, n.unit, idx FROM n JOIN c ON n.doc_id = c.doc_id AND n.unit = r QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY idx) <= b0"""
)
def bridge_pilot(spark, sf):
    return selection.bridge_pilot(_nodes(spark, sf))


@query(
    f"""WITH {UNITS}, m AS (SELECT doc_id, idx, CASE WHEN idx % 13 <> 0 THEN unit END AS unit FROM n), k AS (SELECT doc_id, unit, count(*) AS n, min(idx) AS first FROM m WHERE unit IS NOT NULL GROUP BY ALL), o AS (SELECT doc_id, count(*) AS out FROM m WHERE unit IS NULL GROUP BY ALL),
v AS (SELECT *, row_number() OVER w AS pos, n + lead(n) OVER w + coalesce(out, 0) >= 20 AS enough FROM k LEFT JOIN o USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
c AS (SELECT doc_id, unit FROM (SELECT *, coalesce(min(pos) FILTER (WHERE enough) OVER (PARTITION BY doc_id), 1) AS st FROM v) WHERE pos BETWEEN st AND st + 1)
SELECT doc_id, unit, idx FROM (SELECT m.* FROM m SEMI JOIN c USING (doc_id, unit) UNION ALL SELECT * FROM m WHERE unit IS NULL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 25"""
)
def section_pilot(spark, sf):
    return selection.section_pilot(_nodes(spark, sf).withColumn("unit", F.when(F.col("idx") % 13 != 0, F.col("unit"))))


@query(
    f"""WITH {QUOTA}, r AS (SELECT doc_id, node_id, CASE WHEN node_id % 4 <> 3 THEN section END AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS at FROM nod),
w AS (SELECT x.doc_id, x.node_id AS a, y.node_id AS b, x.unit AS ua, y.unit AS ub FROM r x JOIN r y ON x.doc_id = y.doc_id AND y.at BETWEEN x.at + 1 AND x.at + 3),
z AS (SELECT doc_id, a, b, 'deterministic_anchor' AS reason, NULL AS scope FROM c WHERE anchor UNION ALL
  SELECT doc_id, a, b, unnest(CASE WHEN ua = ub THEN ['high_recall_distance_window', 'same_content_unit'] ELSE ['high_recall_distance_window'] END), CASE WHEN ua = ub THEN 'WITHIN_CONTENT_UNIT' WHEN ua IS NOT NULL AND ub IS NOT NULL THEN 'CROSS_CONTENT_UNIT' ELSE 'UNSCOPED' END FROM w)
SELECT doc_id, a, b, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, max(scope) AS scope FROM z GROUP BY doc_id, a, b"""
)
def nearby_candidates(spark, sf):
    n = _turns(spark, sf).select("doc_id", F.col("node_id").alias("idx"), F.when(F.col("node_id") % 4 != 3, F.col("section")).alias("unit"))
    return selection.add_nearby(n, _pairs(spark, sf).where("anchor").withColumn("reason", F.lit("deterministic_anchor")), 3)


@query(
    """WITH r AS (SELECT l_orderkey AS task, l_orderkey AS cur, l_partkey AS other, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank FROM lineitem)
SELECT least(cur, other) AS a, greatest(cur, other) AS b, task, rank FROM r WHERE rank <= task % 4 QUALIFY row_number() OVER (PARTITION BY least(cur, other), greatest(cur, other) ORDER BY task, rank) = 1"""
)
def ranked_pairs(spark, sf):
    k = F.col("l_orderkey")
    r = t(spark, sf, "lineitem").groupBy(k.alias("task")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ranked"))
    return selection.ranked_pairs(r.withColumn("current", F.col("task")).withColumn("cutoff", F.col("task") % 4))


@query(
    f"""WITH {SEQ}, d AS (SELECT *, CASE WHEN idx > 0 AND k % 5 < 2 AND (k % 11) / 10.0 >= 0.8 THEN CASE k % 5 WHEN 0 THEN 'STARTS_NEW_ITEM' ELSE 'INSERTED_STANDALONE_ITEM' END END AS dec, CASE WHEN k % 2 = 0 THEN 'article' END AS kd FROM o),
s AS (SELECT *, 1 + sum((dec IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS segment FROM d)
SELECT doc_id, segment::BIGINT AS segment, coalesce(max(dec), 'DOCUMENT_START') AS boundary, coalesce(max(kd) FILTER (WHERE dec IS NOT NULL), CASE WHEN segment = 1 THEN 'front_matter' ELSE 'other' END) AS kind, count(*) AS nodes, min(idx) AS first, max(idx) AS last FROM s GROUP BY doc_id, segment"""
)
def decided_segments(spark, sf):
    n, k = _seq(spark, sf), F.col("k")
    d = n.select("doc_id", "idx", F.when(k % 5 == 0, "STARTS_NEW_ITEM").when(k % 5 == 1, "INSERTED_STANDALONE_ITEM").otherwise("CONTINUES").alias("decision"), (k % 11 / 10.0).alias("confidence"), F.when(k % 2 == 0, "article").alias("kind"))
    return selection.decided_segments(n, d)


@query(f"WITH {SEQ} SELECT doc_id, k AS id, row_number() OVER w AS place, lag(k) OVER w AS previous, lead(k) OVER w AS following FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY idx, k)")
def group_adjacency(spark, sf):
    return selection.adjacency(_seq(spark, sf).withColumnRenamed("k", "id"))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey AS page FROM lineitem) SELECT doc_id, page FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 3 OR row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) <= 2")
def outer_pages(spark, sf):
    return selection.outer_pages(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page")), 3, 2)
