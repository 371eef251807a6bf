"""Document-local vectors and candidate pairs. A document is the scope of every pair, so pairs grow with a document's size, not the corpus'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import text as tx


def tfidf(nodes: DataFrame) -> DataFrame:
    """Unit TF-IDF weights of nodes (doc_id, node_id, text) within their document: (1 + ln tf)(ln((1 + N) / (1 + df)) + 1), to 8 places."""
    t = nodes.select("doc_id", "node_id", F.explode(tx.terms(F.col("text"))).alias("term"))
    tf = t.groupBy("doc_id", "node_id", "term").agg(F.count("*").alias("tf"))
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("total"))
    df = tf.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    w = tf.join(df, ["doc_id", "term"]).join(n, "doc_id").withColumn("w", (1 + F.log(F.col("tf"))) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "node_id")))
    return w.withColumn("weight", F.round(F.col("w") / norm, 8)).select("doc_id", "node_id", "term", "weight")


def similar_pairs(weights: DataFrame) -> DataFrame:
    """Sparse dot products of a document's nodes that share a term: doc_id, a, b, similarity (a < b)."""
    x, y = weights.toDF("doc_id", "a", "term", "wa"), weights.toDF("doc_id", "b", "term", "wb")
    return x.join(y, ["doc_id", "term"]).where("a < b").groupBy("doc_id", "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """Each node's k best partners by (similarity, distance, partner): doc_id, node, other, similarity, rank."""
    both = pairs.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"), "similarity").select("doc_id", "e.*", "similarity")
    w = Window.partitionBy("doc_id", "node").orderBy(F.desc("similarity"), F.abs(F.col("node") - F.col("other")), "other")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def channels(nodes: DataFrame, weights: DataFrame, window: int = 2, k: int = 2, section_k: int = 1) -> DataFrame:
    """Candidate pairs of a document from three channels (neighbours in order, best similarity, best of the same section) with their reasons."""
    n = nodes.select("doc_id", F.col("node_id").alias("a"), F.col("section").alias("sa"))
    m = nodes.select("doc_id", F.col("node_id").alias("b"), F.col("section").alias("sb"))
    near = n.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + window))).join(m, ["doc_id", "b"]).select("doc_id", "a", "b", F.lit("structural_neighbor").alias("reason"))
    s = similar_pairs(weights)

    def best(pairs, k, reason):
        t = top_k(pairs, k)
        return t.select("doc_id", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(reason).alias("reason"))

    same = s.join(n, ["doc_id", "a"]).join(m, ["doc_id", "b"]).where("sa = sb").select("doc_id", "a", "b", "similarity")
    all_ = near.unionByName(best(s, k, "embedding_top_k")).unionByName(best(same, section_k, "same_section"))
    return all_.groupBy("doc_id", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


# Reasons that make a pair mandatory, and reasons from the language of a relation.
MANDATORY = ["anaphoric_reference_signal", "formula_context_signal", "explicit_figure_reference", "explicit_table_reference", "explicit_equation_reference", "cross_content_unit_bridge"]
RELATION = ["background_discourse_signal", "contrasts_with_language_signal", "depends_on_language_signal", "evidence_claim_signal", "explains_language_signal", "mention_detail_signal", "qualifies_language_signal", "results_in_language_signal"]


def quotas(pairs: DataFrame, similarity_k: int = 2, role_k: int = 1, cross_k: int = 1, far: int = 3) -> DataFrame:
    """Pairs (doc_id, a, b, similarity, role_complement, cross_section, anchor) that some node's quota keeps, with the reasons: the most similar, the most similar of a
    complementary role, the most similar far away in another section; anchors always."""
    d = F.abs(F.col("b") - F.col("a"))
    both = pairs.withColumn("distance", d).withColumn("e", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))).select("*", "e.*")

    def first(k, when, distance, reason):
        w = Window.partitionBy("doc_id", "node").orderBy(F.desc("when"), F.desc("similarity"), distance, "other")
        return F.when(F.col("when") & (F.row_number().over(w) <= k), reason), when

    kept = both
    for reason, k, when, distance in (("similarity_quota", similarity_k, F.lit(True), F.asc("distance")), ("role_complement_quota", role_k, F.col("role_complement"), F.desc("distance")), ("long_cross_section_quota", cross_k, F.col("cross_section") & (F.col("distance") >= far), F.desc("distance"))):
        c, when = first(k, when, distance, reason)
        kept = kept.withColumn("when", when).withColumn(reason, c)
    all_ = F.array("similarity_quota", "role_complement_quota", "long_cross_section_quota", F.when(F.col("anchor"), "deterministic_anchor"))
    return kept.select("doc_id", "a", "b", F.explode(F.array_compact(all_)).alias("reason")).groupBy("doc_id", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def candidate_score(threshold: float = 0.5) -> tuple:
    """Columns (score, evidence) of a pair from its similarity, distance and reasons (an array)."""
    r, s, d = F.col("reasons"), F.col("similarity"), F.col("distance")
    must = F.arrays_overlap(r, F.array(*map(F.lit, MANDATORY)))
    strong = F.coalesce(s >= threshold, F.lit(False))
    entity, anchor = F.array_contains(r, "shared_entities"), F.array_contains(r, "shared_anchor_signal")
    n = F.size(F.array_intersect(r, F.array(*map(F.lit, RELATION))))
    parts = [F.when(must, 100.0), F.when(d == 1, 50.0).when(d == 2, 1.0), F.when(strong, 4.0 + 10.0 * (s - threshold)), F.when(entity, 2.0), F.when(anchor, 2.0), F.least(F.lit(3.0), 1.25 * n), F.when(F.array_contains(r, "same_section"), 0.25)]
    score = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    names = [(must, "mandatory_reference_or_continuity"), (d == 1, "immediate_neighbor"), (strong, "strong_embedding"), (entity, "shared_entities"), (anchor, "shared_anchor"), (n > 0, "relation_language_or_role")]
    return F.round(score, 6), F.array_compact(F.array(*(F.when(c, v) for c, v in names)))


def keep_greedily(rows: list[tuple], per_node: int) -> list[int]:
    """Positions kept of rows (score, distance, a, b, evidence?): best first, mandatory (50 or more) always, others while both ends have room; all kept use room."""
    used, kept = {}, []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], rows[i][1], rows[i][2], rows[i][3])):
        score, _, a, b, evidence = rows[i]
        if score >= 50 or (evidence and max(used.get(a, 0), used.get(b, 0)) < per_node):
            kept.append(i)
            for x in (a, b):
                used[x] = used.get(x, 0) + 1
    return kept


def prune(pairs: DataFrame, per_node: int = 3, threshold: float = 0.5) -> DataFrame:
    """Pairs (doc_id, a, b, similarity, distance, reasons) that survive the greedy quota, with score. Each choice depends on those before it, hence one grouped function per document."""
    score, evidence = candidate_score(threshold)
    p = pairs.select("doc_id", "a", "b", F.coalesce("distance", F.lit(10**9)).cast("long").alias("distance"), score.alias("score"), (F.size(evidence) > 0).alias("evidence"))

    def one(pdf):
        return pdf.iloc[keep_greedily(list(zip(pdf["score"], pdf["distance"], pdf["a"], pdf["b"], pdf["evidence"], strict=True)), per_node)][["doc_id", "a", "b", "score"]]

    return p.groupBy("doc_id").applyInPandas(one, "doc_id long, a long, b long, score double")


def nearest_vectors(rows: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """node, other, rank: each vector's k nearest of its label by dot product (rounded to six places, ties by id). rows: vec_id, label, v.

    Vectors are packed into blocks of about `block`; blocks of one label are multiplied in pairs and keep k for each vector, so
    what is exchanged grows with vectors times blocks of their label, not with pairs of vectors.
    """
    import numpy as np
    import pyarrow as pa

    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    b = rows.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))

    def packed(t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").to_pylist(), "<f8")
        return pa.table({"label": t.column("label")[:1], "block": t.column("block")[:1], "ids": pa.array([t.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "m": pa.array([v.tobytes()], pa.binary())})

    p = b.select("label", "block", "vec_id", "v").groupBy("label", "block").applyInArrow(packed, "label long, block long, ids binary, m binary")

    def best(batches):
        for t in batches:
            node, other, similar = [], [], []
            for i, j, a, c in zip(*(t.column(n).to_pylist() for n in range(4)), strict=True):
                i, j = np.frombuffer(i, "<i8"), np.frombuffer(j, "<i8")
                s = np.round(np.frombuffer(a, "<f8").reshape(len(i), -1) @ np.frombuffer(c, "<f8").reshape(len(j), -1).T, 6)
                s[i[:, None] == j[None, :]] = -np.inf
                by = np.argsort(j, kind="stable")  # then equal scores stand by id
                top = by[np.argsort(-s[:, by], axis=1, kind="stable")[:, :k]]
                row = np.repeat(np.arange(len(i)), top.shape[1])
                got = s[row, top.ravel()]
                fine = np.isfinite(got)
                node.append(i[row][fine])
                other.append(j[top.ravel()][fine])
                similar.append(got[fine])
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(cat(node, np.int64)), pa.array(cat(other, np.int64)), pa.array(cat(similar, float))], names=["node", "other", "similarity"])

    x, y = p.select("label", F.col("ids").alias("i"), F.col("m").alias("a")), p.select("label", F.col("ids").alias("j"), F.col("m").alias("c"))
    pairs = x.join(y, "label").select("i", "j", "a", "c")
    near = pairs.mapInArrow(best, "node long, other long, similarity double")
    w = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("node", "other", "rank")
