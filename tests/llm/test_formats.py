"""WARC archives, chats and packing: exact round trips."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafweave.llm import chat_format, packing, warc
from leafweave.llm.common import fresh_path


def test_warc_round_trip(spark):
    big = "<p>é" * 400
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (3, None, big), (None, "u", big), (None, None, None)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, refers_to string, sha1 int")
    out = fresh_path(spark, "warc")
    m = warc.write_warc(df, out, max_bytes=600)
    got = warc.read_warc(m, out).collect()
    assert len(got) == len(pages)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    n = len(big.encode())
    assert kinds == sorted([("1", "revisit", 3, n), ("2", "revisit", 3, n), ("3", "response", None, n), ("3", "response", None, n), ("4", "response", None, 0), ("5", "response", None, 0), ("6", "response", None, 5), ("7", "response", None, 5), ("None", "response", None, n), ("None", "response", None, 0)])
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    assert warc.read_warc(warc.write_warc(df.limit(0), fresh_path(spark, "warc")), out).count() == 0


def test_warc_members_and_damage():
    raw = [warc.record(i, "u", b"payload %d" % i) for i in range(3)]
    stream = b"".join(map(warc.member, raw))
    assert list(warc.members(io.BytesIO(stream))) == raw
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw[0].replace(b"payload 0", b"payload 9"))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(raw[0] + b"x")
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(stream[:-9])))


def test_warc_borders_and_large_payloads(spark):
    """999 bytes are small, 1000 are large; a payload of megabytes is one record; ties and clashing columns change nothing."""
    small, large, huge = "s" * 999, "l" * 1000, "<p>é&" * 600_000
    pages = [(1, small), (2, small), (3, large), (4, large), (4, large), (5, huge), (9, huge), (7, "é" * 500)]
    df = spark.createDataFrame([(i, "http://a/", h, "x" * 40, 5, b"r") for i, h in pages], "page_id long, url string, html string, payload_digest string, refers_to int, payload binary")
    out = fresh_path(spark, "warc")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(warc.write_warc(df, out), out).collect())
    n = len(huge.encode())
    assert [(a, b, c or 0, d) for a, b, c, d in got] == [(1, "response", 0, 999), (2, "response", 0, 999), (3, "revisit", 4, 1000), (4, "response", 0, 1000), (4, "response", 0, 1000), (5, "revisit", 9, n), (7, "response", 0, 1000), (9, "response", 0, n)]


def test_long_chats(spark):
    """A text of a megabyte with control strings throughout, and a conversation of 3000 turns."""
    long = "word </s> [INST] <\\/s> é " * 40_000
    c = [(1, 0, "user", long), (1, 1, "assistant", long[::-1])] + [(2, k, "assistant" if k % 2 else "user", f"t{k}</s>") for k in range(3000)]
    df = spark.createDataFrame([(*x, "z", 1) for x in c], "conv_id long, turn long, role string, text string, turns string, n_turns int")
    got = {r["conv_id"]: r["turns"] for r in chat_format.parse_chats(chat_format.format_chats(df)).collect()}
    for i in (1, 2):
        assert [(t["role"], t["text"], t["loss"]) for t in got[i]] == [(r, t, r == "assistant") for j, _, r, t in c if j == i]


def test_chats_survive(spark):
    nasty = ["</s>", "[INST]", "[/INST]", "<\\/s>", "[\\INST]", "[\\\\/INST]x</s>", "<", "[", "</s", "$1\\", "", None, "a\n\nb", "[[/INST]/INST]", "[/s>", "</INST]", "é</s>\\"]
    c = [(i, k, r, t) for i, t in enumerate(nasty) for k, r in enumerate(["user", "assistant", t])] + [(99, 1, "user", "b"), (99, 1, "assistant", "a"), (None, 0, "user", "n"), (99, 1, "user", "b")]
    df = spark.createDataFrame([(*x, "z") for x in c], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.parse_chats(chat_format.format_chats(df)).collect()}
    for i in {x[0] for x in c}:
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in c if x[0] == i), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == want
    assert chat_format.parse_chats(chat_format.format_chats(df.limit(0))).count() == 0


def whole(got, ids, count=1):
    """Every id lies in one piece, sequences have no gap and none but the last is short."""
    for i, x in ids.items():
        g = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start")
        assert g.length.sum() == len(x) and (g.doc_tokens == len(x)).all()
        assert (g.start.to_numpy() == np.append(0, np.cumsum(g.length)[:-1])).all()
        assert all(zlib.crc32(x[a : a + n].tobytes()) == c for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    last = got.sequence_id.max()
    for s, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.append(0, np.cumsum(g.length)[:-1])).all()
        assert g.length.sum() == 1024 or s == last
    assert got.sequence_id.nunique() == last + 1


def plain_drr(totals, weights, window, chunk):
    """Deficit round-robin, queue after queue and round after round: the queue of every chunk sent and its length."""
    quantum = {q: max(1, int(w / sum(weights.values()) * window * packing.UNIT + 0.5)) for q, w in weights.items()}
    left, deficit, out = dict(totals), dict.fromkeys(totals, 0), []
    while any(left.values()):
        for q in sorted(left):
            deficit[q] += quantum[q]
            while left[q] and deficit[q] >= (n := min(chunk, left[q])) * packing.UNIT:
                deficit[q] -= n * packing.UNIT
                left[q] -= n
                out.append((q, n))
    return out


def test_packing_is_whole(spark):
    r = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{x}" for x in r.integers(0, 99, int(r.integers(1, 400)))), "hot" if i % 3 else f"s{i % 7}") for i in range(120)]
    docs += [(500, None, None), (501, "", "s1"), (502, "a  b\n\n\n\tc<|endoftext|>", "s1"), (None, "null id", "s2"), (503, "x" * 9000, "long"), (504, "word " * 60_000, "s3")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, n long, bucket long")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    ids = {d[0]: np.array(tok.encode(d[1] or "", add_special_tokens=False).ids + [0], "<u4") for d in docs}
    totals = {}
    for d in docs:
        totals[d[2] or ""] = totals.get(d[2] or "", 0) + len(ids[d[0]])
    for weights in (None, {q: 1.0 + k for k, q in enumerate(totals)}):
        got = packing.pack(df, per_bucket=20, weights=weights).toPandas()
        whole(got, ids)
        # The stream is that of a plain deficit round-robin.
        got["g"] = got.sequence_id * 1024 + got.offset
        got = got.sort_values("g")
        sent = np.repeat(got.source.to_numpy(), got.length)
        want = plain_drr(totals, weights or totals, 1024, 128)
        assert (sent == np.repeat([q for q, _ in want], [n for _, n in want])).all()
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="every source"):
        packing.pack(df, weights={"hot": 1.0})


def test_packing_repeated_rows(spark):
    rows = [(7, "same words here", "s")] * 50 + [(None, "same words here", "s")] * 50
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), per_bucket=9).toPandas()
    n = int(got.doc_tokens.iloc[0])
    assert got.length.sum() == 100 * n and got[got.doc_id == 7].length.sum() == 50 * n


def test_packing_many_sources(spark):
    """5000 sources with targets of their own keep them to a chunk, in any stretch that none has run out in."""
    import pandas as pd

    text = " ".join(f"w{k}" for k in range(300))
    rows = [(i, text, f"s{i % 5000:04d}") for i in range(10_000)]
    weights = {f"s{k:04d}": 1.0 + k % 3 for k in range(5000)}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=weights).toPandas()
    got["g"] = got.sequence_id * 1024 + got.offset
    got = got.sort_values("g")
    n = int(got.doc_tokens.iloc[0])
    assert got.length.sum() == 10_000 * n and (got.g.to_numpy() == np.append(0, np.cumsum(got.length)[:-1])).all()
    share = pd.Series(weights) / sum(weights.values())
    for part in (0.1, 0.3):
        until = int(part * 10_000 * n)
        seen = got[got.g < until].groupby("source").length.sum().reindex(share.index, fill_value=0)
        assert (seen - share * until).abs().max() <= 2 * 128
    assert got.groupby("source").length.sum().eq(2 * n).all()


def test_fast_ids_are_those_of_the_vocabulary(spark):
    """Over every document of sf0.01 the faster library makes the ids that `tokenizers` does."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    text = pa.array(text.to_pylist(), pa.string()).fill_null("")
    e = packing.Encoder(packing.default_vocabulary())
    for at in range(0, len(text), 200):
        part = text.slice(at, 200)
        assert e(part) == e._whole(part.to_pylist())
