"""Registered queries over short texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.functions import text as tx
from leafweave.functions import words
from leafweave.plans.registry import query, t

TURNS = "c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)"


def _turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t(spark, sf, "conversations").withColumn("before", F.lag("text").over(w))


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://', '', 'g'), '\d+', '#', 'g'), '[^a-zà-öø-ÿ0-9#@./:+_-]+', ' ', 'g'), ' ')"


@query(
    f"""WITH {TURNS}, k AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({NORMAL.format('text')}, ' '), lambda x: length(x) >= 3)) AS a, list_distinct(list_filter(string_split({NORMAL.format('before')}, ' '), lambda x: length(x) >= 3)) AS b FROM c WHERE before IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, len(a) AS tokens, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) ELSE 0.0 END AS jaccard FROM k"""
)
def template_token_overlap(spark, sf):
    c = _turns(spark, sf).where("before is not null and text is not null")
    a, b = words.long_tokens(F.col("text")), words.long_tokens(F.col("before"))
    return c.select("conv_id", "turn", F.size(a).cast("long").alias("tokens"), F.round(tx.jaccard(a, b), 8).alias("jaccard"))


@query(
    f"""WITH {TURNS}, k AS (SELECT conv_id, turn, text, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]{{3,}}'), lambda x: lower(x))) AS a, list_distinct(list_transform(regexp_extract_all(before, '[A-Za-z][A-Za-z''’-]{{3,}}'), lambda x: lower(x))) AS b,
  trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS s, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''’-]*') AS w, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS caps FROM c WHERE before IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(1, least(len(a), len(b))), 8) AS overlap, length(s) BETWEEN 1 AND 90 AND len(string_split(s, ' ')) <= 12 AND NOT regexp_matches(s, '[.?!;]$') AS label,
  CASE WHEN len(w) BETWEEN 2 AND 14 AND length(text) <= 130 AND NOT regexp_matches(text, '[.,;?!]$') THEN caps / greatest(1, letters) >= 0.72 OR len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) / len(w) >= 0.78 ELSE false END AS title FROM k"""
)
def compact_texts(spark, sf):
    c = _turns(spark, sf).where("before is not null and text is not null")
    x = F.col("text")
    return c.select("conv_id", "turn", F.round(words.salient_overlap(x, F.col("before")), 8).alias("overlap"), words.compact_label(x).alias("label"), words.compact_title(x).alias("title"))


SAID = "CASE p_partkey % 7 WHEN 0 THEN 'The RADAR-2 and Virgo Collaboration met FIG with Gravitational Wave of the Sun' WHEN 1 THEN 'Table One and Section Two, NASA NASA' WHEN 2 THEN 'Higgs Boson and Higgs boson, HIGGS BOSON' WHEN 3 THEN 'no names here' WHEN 4 THEN 'Of The And For' WHEN 5 THEN '123-4 A B-C' ELSE 'UNESCO' END"
FOUND = {0: "gravitational wave of the sun=Gravitational Wave of the Sun;radar 2=RADAR-2;virgo collaboration=Virgo Collaboration", 1: "nasa=NASA", 2: "boson=BOSON;higgs=HIGGS;higgs boson and higgs=Higgs Boson and Higgs", 3: "", 4: "", 5: "b c=B-C", 6: "unesco=UNESCO"}


@query("SELECT p_partkey AS id, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FOUND.items()) + " END AS entities, CASE WHEN p_partkey % 7 = 6 THEN 'entity:unesco:' || substr(sha1('unesco'), 1, 8) END AS own FROM part")
def named_entities(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), words.named_entities(F.expr(SAID)).alias("e"))
    return p.select("id", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["name"])), ";").alias("entities"), F.when(F.col("id") % 7 == 6, words.entity_id(F.get("e", F.lit(0))["key"])).alias("own"))


@query(
    r"""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'The  Mass
is 3' WHEN 1 THEN 'mass (m)' WHEN 2 THEN NULL WHEN 3 THEN 'The  Mass
is 3 (kg), mass (m) ' || p_size ELSE NULL END AS span, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE trim(p_name || chr(10) || p_brand) END AS embedded, CASE p_partkey % 4 WHEN 0 THEN 'bold link x' WHEN 1 THEN '' WHEN 2 THEN 'a b' ELSE p_name END AS cleaned FROM part"""
)
def spans_and_cleaning(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    text = F.concat(F.lit("The  Mass\nis 3 (kg), mass (m) "), F.col("p_size").cast("string"))
    span = F.when(k % 5 == 0, "the mass is 3").when(k % 5 == 1, "MASS (m)").when(k % 5 == 2, "mass of").when(k % 5 == 3, "__FULL_FORMULA__").otherwise("  ")
    mode = lambda m: words.embedding_text(F.col("p_name"), F.col("p_brand"), m)
    raw = F.when(k % 4 == 0, "<b>bold</b> [link](http://a) ![i](b)x<!-- gone\n -->").when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, "a \n b").otherwise(F.col("p_name"))
    return p.select(k.alias("id"), words.recovered_span(span, text).alias("span"), F.when(k % 3 == 0, mode("original_only")).when(k % 3 == 1, mode("base_summary_only")).otherwise(mode("original_plus_summary")).alias("embedded"), words.cleaned(raw).alias("cleaned"))


#: Replies and the JSON they hold.
REPLIES = {
    0: ('```json\n{"b": 1, "a": [1, 2]}\n```', '{"a": [1, 2], "b": 1}'),
    1: ('Sure: {"x": "a } b"} and more', '{"x": "a } b"}'),
    2: ('{"f": "\\alpha and \\frac"}', '{"f": "\\\\alpha and \\\\frac"}'),
    3: ("no value here", None),
    4: ('{"open": [1, 2', None),
    5: ('text [1, {"k": "v"}] tail ]', '[1, {"k": "v"}]'),
    6: ('"only text"', '"only text"'),
}


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("SELECT p_partkey AS id, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {_quoted(v[1])}" for k, v in REPLIES.items()) + " END AS found FROM part")
def extracted_json(spark, sf):
    k = F.col("p_partkey") % 7
    reply = F.lit(None).cast("string")
    for i, (raw, _) in REPLIES.items():
        reply = F.when(k == i, F.lit(raw)).otherwise(reply)
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), words.extracted_json(reply).alias("found"))


@query(
    r"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM d)
SELECT doc_id, md5(CASE WHEN length(s) > 200 THEN left(s, 200) || chr(10) || '...[TRUNCATED]' ELSE s END) AS snippet, length(s) AS chars FROM s"""
)
def page_snippets(spark, sf):
    """Texts with metadata lines put between theirs, which must go again."""
    d = t(spark, sf, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    noisy = F.concat(F.array(F.lit("<!-- bbox: [1,2] -->"), F.lit("- block_id: b1")), lines, F.array(F.lit("x deepseek_bbox y"), F.lit("Matched_Region： r"), F.lit("layout_type:text")))
    whole = words.without_metadata(F.array_join(noisy, "\n"), 10**9)
    return d.select("doc_id", F.md5(words.without_metadata(F.array_join(noisy, "\n"), 200)).alias("snippet"), F.char_length(whole).cast("long").alias("chars"))


@query("SELECT l_orderkey AS id, array_to_string(list_distinct_in_order, ',') AS values_ FROM (SELECT l_orderkey, list(v ORDER BY first) AS list_distinct_in_order FROM (SELECT l_orderkey, v, min(n) AS first FROM (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS n, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'v' || (l_suppkey % 3) END AS v FROM lineitem) GROUP BY ALL) WHERE v IS NOT NULL AND v <> '' GROUP BY l_orderkey)")
def distinct_in_order(spark, sf):
    k = F.col("l_partkey") % 5
    v = F.when(k == 0, F.lit(None)).when(k == 1, "").otherwise(F.concat(F.lit("v"), F.col("l_suppkey") % 3))
    n = F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    g = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), v.alias("v")))).alias("a"))
    return g.select("id", F.array_join(words.kept_in_order(F.transform("a", lambda x: x["v"])), ",").alias("values_")).where("values_ <> ''")


NUMERAL = ["IV", "xii", "0", "IIII", "MCMXC", "A", " 7 ", "", "12", "IX"]
VALUE = ["4", "12", "0", "4", "1990", "NULL", "7", "NULL", "12", "9"]


@query("SELECT p_partkey AS id, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(VALUE)) + " END AS number FROM part")
def numerals(spark, sf):
    label = F.expr("case p_partkey % 10 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(NUMERAL)) + " end")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.number_of(label).alias("number"))
