"""References between nodes: what nodes declare, what they mention, which mention means which node, and rules that point backwards.

Nodes have doc_id, node_id, document_order, text, evidence_type, section_id, section_path (titles), content_item_id and
possible_continuation. Everything is Columns, windows over a document and equality joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of declarations, mentions and backward cues.
DECLARATION = r"(?imd)^\s*(FIG(?:URE)?|TABLE)\.?\s*(\d+|[IVXLCDM]+)\s*(?:[.:\-–—]|$)"
MENTION = r"(?i)\b(fig(?:ure)?|table|section|eq(?:uation)?)\.?\s*(?:\(\s*)?((?:[A-Z]\.)?\d+(?:\.\d+)*|[IVXLCDM]+)(?![A-Z0-9])(?:\s*\))?"
EQUATION = r"\(\s*(\d+)\s*\)\s*\\\]\s*$"
SECTION = r"(?i)^\s*((?:[A-Z]\.)?\d+(?:\.\d+)*)\b"
DEMONSTRATIVE = r"(?i)^\s*(?:these|those|such)\s+.{0,80}?\b(?:techniques|methods|approaches|results|observations|findings|measurements|systems)\b"
BACKWARD = r"(?i)\b(?:as discussed above|as shown previously|as described above|the previous (?:section|result|discussion))\b"
CONFIDENCE = {"explicit_label": 1.0, "formula_where_backreference": 0.98, "demonstrative_anaphora": 0.90, "demonstrative_continuation_group": 0.88, "explicit_backward_cue": 0.90}


def kind(c: Column) -> Column:
    k = F.lower(F.regexp_replace(c, r"\.+$", ""))
    return F.when(F.startswith(k, F.lit("fig")), "figure").when(F.startswith(k, F.lit("eq")), "equation").otherwise(k)


def label(c: Column) -> Column:
    return F.upper(F.trim(c))


def _ltrim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def _pairs(text: Column, pattern: str) -> Column:
    """kind, label and cue of every match."""
    z = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "k"), (2, "l"), (0, "cue"))))
    return F.transform(z, lambda x: F.struct(kind(x["k"]).alias("kind"), label(x["l"]).alias("label"), x["cue"].alias("cue")))


def _formula(n: str = "") -> Column:
    return (F.col(f"{n}evidence_type") == "formula") | F.startswith(_ltrim(F.col(f"{n}text")), F.lit("\\["))


def targets(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, label, node_id, section_id, content_item_id of every declaration: figures and tables, numbered equations, and the first node of each numbered section."""
    base = ["doc_id", "node_id", "section_id", "content_item_id"]
    named = nodes.select(*base, F.explode(_pairs(F.col("text"), DECLARATION)).alias("d")).select(*base, "d.kind", "d.label")
    number = F.regexp_extract(F.trim(F.col("text")), EQUATION, 1)
    equations = nodes.where(_formula() & (number != "")).select(*base, F.lit("equation").alias("kind"), label(number).alias("label"))
    title = F.regexp_extract("title", SECTION, 1)
    first = F.min_by(F.struct(*base), F.struct("document_order", "node_id"))
    sections = nodes.select(*base, "document_order", F.explode("section_path").alias("title")).where(title != "").select("*", label(title).alias("label"))
    sections = sections.groupBy("doc_id", "label").agg(first.alias("f")).select("f.*", F.lit("section").alias("kind"), "label")
    return named.unionByName(equations).unionByName(sections).select("doc_id", "kind", "label", "node_id", "section_id", "content_item_id")


def mentions(nodes: DataFrame) -> DataFrame:
    """doc_id, source, section_id, content_item_id, place, kind, label, cue of every mention that does not begin inside a declaration."""
    free = F.regexp_replace(F.col("text"), DECLARATION, "\u0001")
    m = nodes.select("doc_id", F.col("node_id").alias("source"), "section_id", "content_item_id", F.posexplode(_pairs(free, MENTION)).alias("place", "m"))
    return m.select("doc_id", "source", "section_id", "content_item_id", "place", "m.*")


def grounded(nodes: DataFrame) -> DataFrame:
    """Every mention with its target: the only declaration of its label, else the only one in its content item, else in its section; null with a reason otherwise."""
    t = targets(nodes)
    one = lambda n: (F.count("*").alias(f"{n}_n"), F.min("node_id").alias(f"{n}_id"))
    key = ["doc_id", "kind", "label"]
    m = mentions(nodes).join(t.groupBy(*key).agg(*one("all")), key, "left")
    m = m.join(t.where("content_item_id is not null").groupBy(*key, "content_item_id").agg(*one("item")), [*key, "content_item_id"], "left")
    m = m.join(t.where("section_id is not null").groupBy(*key, "section_id").agg(*one("sec")), [*key, "section_id"], "left")
    target = F.when(F.col("all_n") == 1, F.col("all_id")).when(F.col("item_n") == 1, F.col("item_id")).when(F.col("sec_n") == 1, F.col("sec_id"))
    reason = F.when(target.isNull(), F.when(F.col("all_n").isNull(), "target_not_found").otherwise("target_not_unique"))
    return m.select("doc_id", "source", "place", "kind", "label", "cue", target.alias("target"), reason.alias("reason"), F.coalesce("all_n", F.lit(0)).alias("candidates"))


def with_previous(nodes: DataFrame) -> DataFrame:
    """Adds prior, the nearest earlier node that is no caption in an unbroken run of one section, and root, the unfinished node within three places before that only captions, figures and tables part from it."""
    d = Window.partitionBy("doc_id").orderBy("document_order")
    new = (F.row_number().over(d) > 1) & ~F.lag("section_id").over(d).eqNullSafe(F.col("section_id"))
    n = nodes.withColumn("_run", F.sum(new.cast("int")).over(d.rowsBetween(Window.unboundedPreceding, 0)))
    before = [F.lag(F.struct("node_id", "section_id", "evidence_type", "possible_continuation"), k).over(d) for k in (1, 2, 3)]
    fits = [b.isNotNull() & b["section_id"].eqNullSafe(F.col("section_id")) & F.coalesce(b["possible_continuation"], F.lit(False)) for b in before]
    skips = [b["evidence_type"].isin("caption", "figure", "table") for b in before]
    root = F.when(fits[0], before[0]["node_id"]).when(skips[0] & fits[1], before[1]["node_id"]).when(skips[0] & skips[1] & fits[2], before[2]["node_id"])
    n = n.withColumn("root", root)
    r = Window.partitionBy("doc_id", "_run").orderBy("document_order").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.coalesce(F.col("evidence_type") != "caption", F.lit(True)), F.struct("node_id", "evidence_type", "text", "root")), True).over(r)
    return n.withColumn("prior", prior).drop("_run")


def backward(nodes: DataFrame) -> DataFrame:
    """doc_id, source, target, cue, rule, seq of the rules that point backwards."""
    n = with_previous(nodes).where("prior is not null")
    text, prior = F.col("text"), F.col("prior")
    where = F.regexp_like(_ltrim(text), F.lit(r"(?i)^where\b")) & _formula("prior.")
    said, back = F.regexp_extract(text, DEMONSTRATIVE, 0), F.regexp_extract(text, BACKWARD, 0)
    edge = lambda ok, target, cue, rule, seq: F.when(ok, F.struct(target.alias("target"), cue.alias("cue"), F.lit(rule).alias("rule"), F.lit(seq).alias("seq")))
    each = F.array(
        edge(where, prior["node_id"], F.substring_index(_ltrim(text), ".", 1), "formula_where_backreference", 1000),
        edge(said != "", prior["node_id"], said, "demonstrative_anaphora", 1001),
        edge((said != "") & prior["root"].isNotNull(), prior["root"], said, "demonstrative_continuation_group", 1002),
        edge((said == "") & (back != ""), prior["node_id"], back, "explicit_backward_cue", 1003),
    )
    return n.select("doc_id", F.col("node_id").alias("source"), F.explode(F.array_compact(each)).alias("e")).select("doc_id", "source", "e.*")


def reference_edges(nodes: DataFrame) -> DataFrame:
    """One edge for each source and target: the most confident cue, the first of equals. Edges to oneself go."""
    g = grounded(nodes).where("target is not null").select("doc_id", "source", "target", "cue", F.lit("explicit_label").alias("rule"), F.col("place").alias("seq"))
    e = g.unionByName(backward(nodes)).where("source <> target")
    conf = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), F.col("rule"))
    best = F.max_by(F.struct("cue", "rule", conf.alias("confidence")), F.struct(conf.alias("c"), (-F.col("seq")).alias("s")))
    return e.groupBy("doc_id", "source", "target").agg(best.alias("b")).select("doc_id", "source", "target", "b.*")


def granularity_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to a table's caption whose next node is the table itself."""
    w = Window.partitionBy("doc_id").orderBy("document_order")
    declares = F.exists(_pairs(F.col("text"), DECLARATION), lambda x: x["kind"] == "table")
    n = nodes.select("doc_id", F.col("node_id").alias("target"), declares.alias("declares"), F.lead("node_id").over(w).alias("table_body"), F.lead("text").over(w).alias("after"))
    n = n.where(F.col("declares") & F.startswith(F.lower(_ltrim(F.col("after"))), F.lit("<table")))
    return edges.join(n.select("doc_id", "target", "table_body"), ["doc_id", "target"]).select("doc_id", "source", "target", "table_body", "cue")
