"""What a model replied, read and checked by rules: each parser adds what it could use of a reply, and whether all of it is valid.

A reply is a JSON object as text (null, or anything else, is no reply and invalid). a and b are the ids of the task's two
nodes. Model calls themselves are functions that the caller brings; see leafweave.functions.models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels that tasks ask for.
SCREENED = ["RELATED", "POSSIBLE", "NONE"]
SIGNALS = ["SAME_CLAIM_OR_RESULT", "EVIDENCE_OR_QUANTIFICATION", "EXPLANATION_OR_MECHANISM", "CONDITION_OR_SCOPE", "EXPLICIT_CONTRAST"]
DIRECTNESS = ["DIRECT", "SHARED_CENTER", "MEDIATED", "TOPIC_ONLY", "REFERENCE_ONLY", "CONTEXT_ONLY", "REDUNDANT", "INSUFFICIENT"]
SPLIT = ["SUPPORTS", "EXPLAINS_OR_ELABORATES", "MODIFIES", "CONTRASTS_WITH"]
COARSE = ["EXPANDS", "SUPPORTS", "CONDITIONS", "CONTRASTS_WITH"]
FOUR = ["CONTRIBUTES_TO", "MODIFIES", "CONTRASTS_WITH", "REFERENCES"]
STRICT = ["ELABORATES", "SUPPORTS", "EXPLAINS", "QUALIFIES", "DEPENDS_ON", "CONTRASTS_WITH"]
MODES = ["EVIDENTIAL", "EXPLANATORY"]
ABSTAIN = "REJECT_UNCERTAIN"
CONFIDENCE_WORDS = {"high": 0.85, "medium": 0.60, "low": 0.30, "maybe": 0.40}


def given(c: Column) -> Column:
    """Whether a text says anything."""
    return F.coalesce(F.regexp_like(c, F.lit(r"\S")), F.lit(False))


def clamped(c: Column) -> Column:
    """A number from 0 to 1, null where the text is none."""
    n = c.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)) + F.when(n.isNotNull(), 0.0)


def worded(c: Column) -> tuple[Column, Column]:
    """A confidence said in numbers, per cent or words, and how it was read."""
    s = F.lower(F.trim(c))
    percent = F.endswith(s, F.lit("%"))
    n = F.regexp_replace(s, "%+$", "").try_cast("double") / F.when(percent, 100.0).otherwise(1.0)
    words = F.create_map(*(F.lit(x) for kv in CONFIDENCE_WORDS.items() for x in kv))
    word = F.element_at(words, s)
    value = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)) + F.when(n.isNotNull(), 0.0), word, F.lit(0.0))
    kind = F.when(n.isNotNull(), "numeric").when(word.isNotNull(), "categorical_normalized").otherwise("invalid_defaulted")
    return value, kind


def loose(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def grounded(span: Column, text: Column) -> Column:
    """Whether a span that says anything stands in a text, whatever its case and white space."""
    return given(span) & F.coalesce(F.contains(loose(text), loose(span)), F.lit(False))


def ends(s: Column, t: Column, a: Column, b: Column) -> Column:
    """Whether source and target are the task's two nodes, either way round."""
    return F.coalesce((s != t) & (((s == a) & (t == b)) | ((s == b) & (t == a))), F.lit(False))


def _label(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def _read(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("p", F.from_json("reply", schema)).withColumn("is_reply", F.col("p").isNotNull() & F.startswith(F.ltrim("reply"), F.lit("{")))


def _result(rows: DataFrame, valid: Column, **fields: Column) -> DataFrame:
    """The task, its fields (null without a reply) and whether they are valid."""
    rows = rows.withColumn("_valid", F.col("is_reply") & F.coalesce(valid, F.lit(False)))
    return rows.select("task_id", *(F.when(F.col("is_reply"), c).alias(k) for k, c in fields.items()), F.col("_valid").alias("valid"))


PAIR = "source_node_id string, target_node_id string, confidence string"


def typed_pair(rows: DataFrame, relations: list[str], abstain: str | None = None) -> DataFrame:
    """A relation with its direction, of fixed relations; an abstention has no ends. rows: task_id, a, b, reply."""
    r = _read(rows, f"relation_type string, {PAIR}")
    label, s, t, c = _label(F.col("p.relation_type")), F.col("p.source_node_id"), F.col("p.target_node_id"), clamped(F.col("p.confidence"))
    out = (label == abstain) & c.isNotNull() if abstain else F.lit(False)
    valid = out | (label.isin(relations) & ends(s, t, F.col("a"), F.col("b")) & c.isNotNull())
    return _result(r, valid, relation=label, source=F.when(~out, s), target=F.when(~out, t), confidence=c)


def coarse_typed(rows: DataFrame) -> DataFrame:
    return typed_pair(rows, COARSE)


def four_class_typed(rows: DataFrame) -> DataFrame:
    return typed_pair(rows, FOUR, ABSTAIN)


def strictly_typed(rows: DataFrame) -> DataFrame:
    return typed_pair(rows, STRICT)


def split_typed(rows: DataFrame) -> DataFrame:
    """Semantic relation and reference of a pair, each valid by itself; the reply is valid if both are."""
    r = _read(rows, "semantic struct<relation: string, source_node_id: string, target_node_id: string, confidence: string>, references struct<exists: boolean, source_node_id: string, target_node_id: string, cue: string, confidence: string>")
    a, b = F.col("a"), F.col("b")
    sem, ref = F.col("p.semantic"), F.col("p.references")
    label, sc, rc = _label(sem["relation"]), clamped(sem["confidence"]), clamped(ref["confidence"])
    free = sem["source_node_id"].isNull() & sem["target_node_id"].isNull()
    semantic = sc.isNotNull() & F.when(label == ABSTAIN, free).otherwise(label.isin(SPLIT) & ends(sem["source_node_id"], sem["target_node_id"], a, b))
    none = ref["source_node_id"].isNull() & ref["target_node_id"].isNull() & ref["cue"].isNull()
    held = ends(ref["source_node_id"], ref["target_node_id"], a, b) & given(ref["cue"])
    reference = rc.isNotNull() & F.when(ref["exists"], held).when(~ref["exists"], none).otherwise(False)
    valid = sem.isNotNull() & ref.isNotNull() & semantic & reference
    return _result(r, valid, relation=label, semantic_confidence=sc, reference=ref["exists"], reference_confidence=rc)


def freely_judged(rows: DataFrame) -> DataFrame:
    """Whether a pair is related: a status, a description and a span of each side, or none of these."""
    r = _read(rows, "status string, relation_description string, supporting_span_a string, supporting_span_b string, confidence string")
    status, c = _label(F.col("p.status")), clamped(F.col("p.confidence"))
    said = [F.col(f"p.{x}") for x in ("relation_description", "supporting_span_a", "supporting_span_b")]
    every, none = given(said[0]) & given(said[1]) & given(said[2]), said[0].isNull() & said[1].isNull() & said[2].isNull()
    valid = c.isNotNull() & F.when(status.isin("RELATED_STRONG", "AMBIGUOUS"), every).when(status == "UNRELATED", none).otherwise(False)
    return _result(r, valid, status=status, confidence=c)


def existence_judged(rows: DataFrame) -> DataFrame:
    """Relatedness with its signals and an anchor in each text, or a reason against it. rows: also text_a, text_b."""
    r = _read(rows, "status string, signals array<string>, best_relation_hypothesis string, anchor_a string, anchor_b string, unrelated_reason string, relationship_probability string")
    p = lambda x: F.col(f"p.{x}")
    status, prob, signals = _label(p("status")), clamped(p("relationship_probability")), p("signals")
    known = signals.isNotNull() & (F.size(signals) == F.size(F.array_distinct(signals))) & F.forall(signals, lambda x: F.coalesce(x.isin(SIGNALS), F.lit(False)))
    yes = known & (F.size(signals) > 0) & given(p("best_relation_hypothesis")) & grounded(p("anchor_a"), F.col("text_a")) & grounded(p("anchor_b"), F.col("text_b")) & p("unrelated_reason").isNull()
    no = known & (F.size(signals) == 0) & p("best_relation_hypothesis").isNull() & p("anchor_a").isNull() & p("anchor_b").isNull() & given(p("unrelated_reason"))
    valid = prob.isNotNull() & F.when(status.isin("RELATED", "POSSIBLE_RELATION"), yes).when(status == "UNRELATED", no).otherwise(False)
    return _result(r, valid, status=status, probability=prob)


def strictly_validated(rows: DataFrame) -> DataFrame:
    """A verdict on an edge: kept only if direct, with an anchor in each text, a subject and a contribution; else rejected for a reason."""
    r = _read(rows, "verdict string, directness string, anchor_a string, anchor_b string, shared_atomic_subject string, contribution_a_to_b string, contribution_b_to_a string, third_node_required boolean, rejection_reason string, confidence string")
    p = lambda x: F.col(f"p.{x}")
    verdict, direct, third, c = _label(p("verdict")), _label(p("directness")), p("third_node_required"), clamped(p("confidence"))
    keep = (direct == "DIRECT") & ~third & grounded(p("anchor_a"), F.col("text_a")) & grounded(p("anchor_b"), F.col("text_b")) & given(p("shared_atomic_subject")) & (given(p("contribution_a_to_b")) | given(p("contribution_b_to_a"))) & ~given(p("rejection_reason"))
    drop = direct.isin(DIRECTNESS[1:]) & given(p("rejection_reason")) & (third == (direct == "MEDIATED"))
    valid = c.isNotNull() & F.when(verdict == "KEEP_EDGE", keep).when(verdict == "REJECT_EDGE", drop).otherwise(False)
    return _result(r, valid, verdict=verdict, directness=direct, confidence=c)


def fixed_typed(rows: DataFrame) -> DataFrame:
    """One type of a fixed set with the direction it demands; a second type only between supports and explanations."""
    r = _read(rows, f"relation string, secondary_relation string, direction_status string, relation_description string, {PAIR}")
    p = lambda x: F.col(f"p.{x}")
    label, second, way, c = _label(p("relation")), F.upper(p("secondary_relation")), _label(p("direction_status")), clamped(p("confidence"))
    both = ["SUPPORTS", "EXPLAINS_OR_ELABORATES"]
    free = p("source_node_id").isNull() & p("target_node_id").isNull()
    two = second.isNull() | (label.isin(both) & second.isin(both) & (second != label))
    one = F.when(label.isin([*both, "MODIFIES"]), (way == "DIRECTED") & ends(p("source_node_id"), p("target_node_id"), F.col("a"), F.col("b")))
    one = one.when(label == "CONTRASTS_WITH", (way == "SYMMETRIC") & free).when(label == ABSTAIN, (way == "UNRESOLVED") & free & second.isNull()).otherwise(False)
    return _result(r, two & one & given(p("relation_description")) & c.isNotNull(), relation=label, secondary=second, direction=way, confidence=c)


def profile_typed(rows: DataFrame) -> DataFrame:
    """A contribution with its modes, which may be several, or another relation without modes."""
    r = _read(rows, f"primary_relation string, contribution_modes array<string>, direction_status string, relation_description string, {PAIR}")
    p = lambda x: F.col(f"p.{x}")
    label, modes, way, c = _label(p("primary_relation")), p("contribution_modes"), _label(p("direction_status")), clamped(p("confidence"))
    free = p("source_node_id").isNull() & p("target_node_id").isNull()
    aimed = (way == "DIRECTED") & ends(p("source_node_id"), p("target_node_id"), F.col("a"), F.col("b"))
    known = modes.isNotNull() & (F.size(modes) == F.size(F.array_distinct(modes))) & F.forall(modes, lambda x: F.coalesce(x.isin(MODES), F.lit(False)))
    open_ = (way == "UNRESOLVED") & free
    one = F.when(label == "CONTRIBUTES_TO", (F.size(modes) > 0) & (aimed | open_)).when(label == "MODIFIES", (F.size(modes) == 0) & aimed)
    one = one.when(label == "CONTRASTS_WITH", (F.size(modes) == 0) & (way == "SYMMETRIC") & free).when(label == "RELATED", (F.size(modes) == 0) & open_).otherwise(False)
    return _result(r, known & one & given(p("relation_description")) & c.isNotNull(), relation=label, modes=F.coalesce(modes, F.array().cast("array<string>")), direction=way, confidence=c)


def selected_targets(rows: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` distinct supplied targets with a description and spans; one that is not makes all invalid. rows: task_id, candidates, reply."""
    r = _read(rows, "selected array<struct<target_id: string, relation_description: string, source_span: string, target_span: string>>")
    x = F.col("p.selected")
    ids = F.transform(x, lambda v: v["target_id"])
    fine = F.forall(x, lambda v: F.coalesce(F.array_contains(F.col("candidates"), v["target_id"]), F.lit(False)) & given(v["relation_description"]) & given(v["source_span"]) & given(v["target_span"]))
    fine = F.coalesce(x.isNotNull() & fine & (F.size(ids) == F.size(F.array_distinct(ids))), F.lit(False))
    return _result(r, fine & (F.size(x) <= most), targets=F.when(fine, ids).otherwise(F.array().cast("array<string>")))


def ranked_targets(rows: DataFrame) -> DataFrame:
    """Every expected target in the order supplied, those left out after them; complete if the reply named each once. rows: task_id, expected, reply."""
    r = _read(rows, "ranked_target_ids array<string>")
    named = F.filter(F.coalesce(F.col("p.ranked_target_ids"), F.array().cast("array<string>")), lambda v: F.coalesce(F.array_contains(F.col("expected"), v), F.lit(False)))
    complete = F.col("is_reply") & (F.size(named) == F.size("expected")) & (F.size(F.array_distinct(named)) == F.size("expected"))
    return r.select("task_id", F.array_distinct(F.concat(named, "expected")).alias("ranked"), F.coalesce(complete, F.lit(False)).alias("complete"))


SUFFIX = r"^(.*?_EV_)0*(\d+)$"


def ranked_in_sequence(rows: DataFrame) -> DataFrame:
    """A permutation of the expected ids and how many of them are edges. Ids without their padding zeros are mended where one expected id fits. rows: task_id, expected, reply."""
    r = _read(rows, "ranked_candidate_ids array<string>, edge_cutoff string")
    plain = lambda v: F.regexp_replace(v, SUFFIX, "$1$2")
    fits = lambda v: F.filter("expected", lambda e: F.regexp_like(e, F.lit(SUFFIX)) & F.regexp_like(v, F.lit(SUFFIX)) & (plain(e) == plain(v)))
    mended = F.transform("p.ranked_candidate_ids", lambda v: F.when(F.array_contains(F.col("expected"), v), v).when(F.size(fits(v)) == 1, F.get(fits(v), F.lit(0))).otherwise(v))
    r = r.withColumn("mended", mended)
    n = F.size("expected")
    order = F.coalesce((F.size("mended") == n) & (F.size(F.array_distinct("mended")) == n) & (F.size(F.array_except("mended", "expected")) == 0), F.lit(False))
    cut = F.when(F.regexp_like("p.edge_cutoff", F.lit(r"^-?\d+$")), F.col("p.edge_cutoff").try_cast("int"))
    whole = F.coalesce((cut >= 0) & (cut <= n), F.lit(False))
    asked = F.col("is_reply") & F.col("p.ranked_candidate_ids").isNotNull()
    return r.select("task_id", F.when(asked & order, F.col("mended")).otherwise(F.col("expected")).alias("ranked"), F.when(asked & whole, cut).otherwise(0).cast("long").alias("cutoff"), (asked & order & whole).alias("valid"))


def screened(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every candidate pair with its class; those without a decision, or one of no known class, are possible. decisions: seq, pair_id, classification, confidence (text); of several the last counts."""
    d = decisions.groupBy("pair_id").agg(F.max_by(F.struct("classification", F.coalesce("confidence", F.lit("")).alias("said"), F.col("confidence").isNull().alias("unsaid")), "seq").alias("d"))
    c = candidates.join(d, "pair_id", "left")
    label = F.upper(F.coalesce("d.classification", F.lit("POSSIBLE")))
    fallback = F.col("d").isNull() | ~label.isin(SCREENED)
    value = F.when(F.coalesce("d.unsaid", F.lit(True)), F.when(fallback, 0.5).otherwise(0.0)).otherwise(worded(F.col("d.said"))[0])
    return c.select("pair_id", F.when(fallback, "POSSIBLE").otherwise(label).alias("classification"), value.alias("confidence"), fallback.alias("fallback"))
