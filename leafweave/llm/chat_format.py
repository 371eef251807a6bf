"""Chat formatting by a grammar round trip, in DataFrame functions alone.

A turn is rendered as [INST]role[/INST]text</s>. A deterministic parser reads it back: it knows three control strings
and demands exactly one of each, in order. A turn that does not come back identical (its role or text holds a control
string, or what looks like an escaped one) is rendered again with one more backslash inside each such string and read
back again; if it still differs the query fails rather than pass a damaged turn. The whole conversation is then parsed
from the formatted string, and every result column comes from that parse.

The contract's digests run over a whole conversation, so a conversation's turns meet in one row.

Defined cases: null text and null role are empty; turns that tie are ordered by role and text; a null conv_id is a
conversation of its own; without an assistant turn the masked text is empty; a very long text is read whole, but a
conversation is bounded by what one row can hold; rows repeated stay repeated; an empty table gives only what the caller adds;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm.common import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = r"</s>|\[/?INST\]"
TURN = r"(?s)\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(c: Column) -> Column:
    """One backslash more in every control string, escaped or not; undone by unescape()."""
    return F.regexp_replace(F.regexp_replace(c, r"<(\\*)/s>", r"<\\$1/s>"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<\\(\\*)/s>", r"<$1/s>"), r"\[\\(\\*)(/?INST\])", r"[$1$2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _identical(turn: Column, role: Column, text: Column) -> Column:
    """Whether the parser reads exactly this role and text from a rendered turn."""
    whole = F.regexp_extract(turn, TURN, 0) == turn
    three = F.regexp_count(turn, F.lit(CONTROL)) == 3
    return whole & three & (unescape(F.regexp_extract(turn, TURN, 1)) == role) & (unescape(F.regexp_extract(turn, TURN, 2)) == text)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, source (what the turns said: role, newline, text, newline each), one row per conversation."""
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    plain, escaped = render(role, text), render(escape(role), escape(text))
    t = t.withColumn(
        "rendered",
        F.when(_identical(plain, role, text), plain).when(_identical(escaped, role, text), escaped).otherwise(F.raise_error(F.lit("a turn does not survive its round trip")).cast("string")),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    g = t.groupBy("conv_id").agg(turns.alias("turns"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("formatted"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("source"),
    )


def parse_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, and turns (role, text, loss) read back from formatted; loss marks the assistant's text."""
    f = F.col("formatted")
    roles, texts = (F.transform(F.regexp_extract_all(f, F.lit(TURN), F.lit(k)), unescape) for k in (1, 2))
    return chats.withColumn("turns", F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), (x["role"] == "assistant").alias("loss"))))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{OPEN} ok {CLOSE}"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    p = parse_chats(format_chats(c.unionByName(own)))
    back = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    p = p.withColumn("back", back).withColumn("masked", F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), ""))
    same = F.when(F.col("back") == F.col("source"), F.col("back")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string"))
    return p.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(same, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(regexp_replace(regexp_replace(role, '<(\\*)/s>', '<\\\1/s>', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) +
    length(regexp_replace(regexp_replace(text, '<(\\*)/s>', '<\\\1/s>', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) + 17 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
