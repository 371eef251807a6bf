"""Edges: remapping to canonical nodes, integrity, components, traversal."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def remap(edges: DataFrame, aliases: DataFrame, active: DataFrame, drop_types: list[str] | None = None) -> DataFrame:
    """Every edge (seq, source, target, edge_type) with its ends remapped and an outcome: output, or why it was dropped (first rule that holds).

    aliases: source_node_id, canonical_node_id, one row an id. active: node_id, one row an id.
    """
    a = aliases.select("source_node_id", "canonical_node_id")
    s, t = a.toDF("source", "s2"), a.toDF("target", "t2")
    e = edges.join(s, "source", "left").join(t, "target", "left")
    e = e.select("seq", "edge_type", F.coalesce("s2", "source").alias("source"), F.coalesce("t2", "target").alias("target"))
    n = active.select(F.col("node_id").alias("source"), F.lit(True).alias("s_on"))
    m = active.select(F.col("node_id").alias("target"), F.lit(True).alias("t_on"))
    e = e.join(n, "source", "left").join(m, "target", "left")
    by_type = F.col("edge_type").isin(drop_types or [])
    state = F.when(by_type, "dropped_by_type").when(F.col("source") == F.col("target"), "dropped_self_loop_after_remap").when(F.col("s_on").isNull() | F.col("t_on").isNull(), "dropped_dangling_after_remap").otherwise("output")
    e = e.withColumn("outcome", state)
    w = Window.partitionBy("source", "target", "edge_type", "outcome").orderBy("seq")
    again = (F.col("outcome") == "output") & (F.row_number().over(w) > 1)
    return e.withColumn("outcome", F.when(again, "dropped_duplicate_after_remap").otherwise(F.col("outcome"))).select("seq", "source", "target", "edge_type", "outcome")


def both_ways(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """A forward and an inverse row for each edge, with the inverse label."""
    label = F.create_map(*(F.lit(x) for kv in inverse.items() for x in kv))
    f = edges.select("source", "target", F.col("relation").alias("label"), F.lit("forward").alias("view"))
    b = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.coalesce(F.element_at(label, F.col("relation")), F.concat(F.lit("INVERSE_"), "relation")).alias("label"), F.lit("inverse").alias("view"))
    return f.unionByName(b)


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder: what several steps read is worked out once, and lineage ends."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node id reachable over undirected edges (source, target).

    Rounds of contraction: every node takes the name of its smallest neighbour, down to one that is smaller than all of its
    own, and edges are redrawn between names, each once. At most half of the nodes are names, so a round works on what the last
    one left and not on all edges. Then names are followed from the last round back to the first. Rounds end in checkpoints.
    """
    e = kept(edges.select("source", "target").where("source <> target"))
    took = []
    for _ in range(most):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
        name = both.groupBy("source").agg(F.min("target").alias("m")).select(F.col("source").alias("node"), F.least("source", "m").alias("name")).checkpoint()
        while True:  # names that others took lead on to theirs, twice as far each time
            up = name.where("name <> node").toDF("name", "upper")
            if name.join(up, "name", "left_semi").isEmpty():
                break
            name = name.join(up, "name", "left").select("node", F.coalesce("upper", "name").alias("name")).checkpoint()
        took.append(name)
        e = e.join(name.toDF("source", "s"), "source").join(name.toDF("target", "t"), "target").where("s <> t")
        e = e.select(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target")).distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    root = took.pop() if took else e.toDF("node", "name")
    while took:
        root = took.pop().join(root.toDF("name", "root"), "name", "left").select("node", F.coalesce("root", "name").alias("name"))
    return root.toDF("node", "root")


def strongest_edges(edges: DataFrame) -> DataFrame:
    """Of edges (seq, source, target, cue, confidence) one for each source and target: the most confident, the first of equals. Edges to oneself go."""
    best = F.max_by(F.struct("seq", "cue", "confidence"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("seq")))
    return edges.where("source <> target").groupBy("source", "target").agg(best.alias("e")).select("source", "target", "e.*")
