"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. A round grants queue i a quantum of w_i windows' worth of tokens; what it may send is
its deficit counter cut down to whole chunks of `chunk` tokens, and the rest of the counter carries to the next round.
The chunks of all queues, round after round, form one stream, cut every `window` tokens; so any stretch of the stream
holds each source in its target proportion to within a chunk, and every window but the last is full.

What a queue has sent after r rounds has a closed form, S_i(r) = chunk * floor(r * quantum_i / chunk), at most its total; so
chunk c of queue i leaves in round ceil(end of c / quantum_i), known without any other queue. Chunks sorted by round, queue and
place are the stream, and a running sum of their lengths is where each stands: sums within the ranges of a distributed sort, then
over the ranges. Deficits so carry over windows and partitions without a sequential pass, for any number of queues; nothing comes to
the driver but a sum for each range (at most `RANGES`).

A document's ids are made once and written with 16 bits each; documents meet in buckets of about `per_bucket` of all queues.
Targets default to the sources' own shares; given weights must name every source.

Defined cases: null text is empty (its one id 0 is still packed); null source is a queue of its own, named ''; very long texts are
encoded whole and cut into pieces; rows repeated with one doc_id, and rows with a null one, are packed each; of queues that send in
one round the lesser name comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafweave.llm.common import MADE, buckets_for, drop, materialise, table

#: Parts of a token in a quantum; a queue of up to 2^46 tokens stays within 64 bits.
UNIT = 1 << 16
#: Of text encoded at a time.
TEXT_BYTES = 4 << 20
#: Chunks in a range of the sort, and how many ranges there are at most.
PER_RANGE, RANGES = 250_000, 10_000
#: The vocabulary's own pattern (a fixed value) and where it never joins: before a space, around a newline. Texts with a
#: longer run of white space, white space of another kind, an added token or the mark itself are encoded whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHOLE = r"[ \n][ \n](?:[ \n]|$)|[\t\r\x0b\x0c\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|endoftext\|>"
MARK = "\x01"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fast(path: str, tokenizer):
    """The file's merges as ranks for the faster of two libraries, where the file allows it: byte-level BPE, ids in merge order."""
    m = json.loads(open(path, encoding="utf-8").read())
    model, pre = m["model"], m.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and m.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))}
    pair = lambda x: "".join(x) if isinstance(x, list) else x.replace(" ", "")
    ids = [model["vocab"][pair(x)] for x in model["merges"]]
    if ids != list(range(ids[0], ids[0] + len(ids))):
        return None
    added = {x["content"] for x in m.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in added}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "It's   a\n\nprobe, naïve 12³ ¿qué? \u4e2d\u6587 \U0001f600.\tEnd  "
    return own.encode_to_numpy if own.encode_ordinary(probe) == tokenizer.encode(probe, add_special_tokens=False).ids else None


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit bytes (32-bit for larger vocabularies).

    Texts are cut where the vocabulary's pattern cuts too; each distinct piece is encoded once a call, all of them in lines,
    and a text's ids are gathered from its pieces' by Arrow. A vocabulary of another kind is encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = _fast(path, self.tokenizer)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _values(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct pieces, and where each piece's are. A line's end is an id of its own, which no piece holds."""
        blank = ["", " ", "\n"]
        which = pc.index_in(pieces, value_set=pa.array(blank)).fill_null(-1).to_numpy(zero_copy_only=False)
        words = pieces.filter(pa.array(which < 0))
        end = self.fast("\n")[0]
        raw, lengths = [], []
        for at in range(0, len(words), 50_000):
            part = words.slice(at, 50_000)
            ids = self.fast(pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), "\n")[0].as_py())
            ends = np.append(np.flatnonzero(ids == end), len(ids))
            lengths.append(np.diff(ends, prepend=-1) - 1)
            raw.append(ids[ids != end].astype(self.dtype))
        for x in blank:
            raw.append(self.fast(x).astype(self.dtype))
            lengths.append(np.array([len(raw[-1])]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) * self.dtype.itemsize
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.concatenate(raw).tobytes())])
        return values, np.where(which < 0, np.cumsum(which < 0) - 1, len(words) + which)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        if self.fast is None:
            return self._whole(texts.to_pylist())
        out: list = [None] * len(texts)
        whole = pc.match_substring_regex(texts, WHOLE)
        odd = pc.indices_nonzero(whole)
        for i, x in zip(odd.to_pylist(), self._whole(texts.take(odd).to_pylist()), strict=True):
            out[i] = x
        rest = pc.indices_nonzero(pc.invert(whole))
        if not len(rest):
            return out
        plain = texts.take(rest).cast(pa.large_string())
        plain = pc.replace_substring(pc.replace_substring(plain, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        cut = pc.split_pattern(plain, MARK)
        pieces = cut.flatten().dictionary_encode()
        values, at = self._values(pieces.dictionary.cast(pa.string()))
        ids = values.take(pa.array(at[pieces.indices.to_numpy()]))
        data, starts = memoryview(ids.buffers()[2]), np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        ends = starts[np.asarray(cut.offsets) - cut.offsets[0].as_py()].tolist()
        for i, a, b in zip(rest.to_pylist(), ends, ends[1:], strict=False):
            out[i] = bytes(data[a:b])
        return out


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for a worker's process: a vocabulary takes a second and much memory to read."""
    return Encoder(path)


def _slices(batches, most: int):
    """Batches joined or cut to about `most` bytes of text, at least one row each."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most - size, "right")))
            held.append(b.slice(at, end - at))
            size += int(ends[end - 1] - (ends[at - 1] if at else 0))
            at = end
            if size >= most or at < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


TOKENS = "row long, doc_id long, source string, n long, ids binary"


def _tokenise(vocabulary: str):
    def rows(batches):
        encode = encoder(vocabulary)
        end = np.zeros(1, encode.dtype).tobytes()
        row = TaskContext.get().partitionId() << 40
        for t in _slices(batches, TEXT_BYTES):
            text = pc.fill_null(t.column(1), "").combine_chunks()
            ids = [x + end for x in encode(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)]
            n = [len(x) // len(end) for x in ids]
            out = pa.table({"row": pa.array(range(row, row + len(n)), pa.int64()), "doc_id": t.column(0), "source": t.column(2), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})
            row += len(n)
            yield from out.to_batches(max_chunksize=2000)

    return rows


def quanta(queues: DataFrame, weights: dict[str, float] | None, window: int) -> DataFrame:
    """source, total, quantum: what a round grants each queue, in parts of a token."""
    if weights is None:
        share = queues.select("source", "total", F.col("total").cast("double").alias("share"))
    else:
        given = queues.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, share double")
        share = queues.join(given, "source", "left")
        if share.where("share is null or not share > 0").limit(1).count():
            raise ValueError("weights must give every source a target above 0")
    whole = share.agg(F.sum("share")).first()[0] or 1.0
    return share.select("source", "total", F.greatest(F.lit(1), F.round(F.col("share") / whole * window * UNIT)).cast("long").alias("quantum"))


ORDER = "source string, c long, round long, part int, at long, n long"


def _running(batches):
    """Where each chunk of a range stands in it."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(3).to_numpy()
        ends = at + np.cumsum(n)
        if len(n):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(len(n), part), pa.int32()), pa.array(ends - n, pa.int64()), b.column(3)], names=["source", "c", "round", "part", "at", "n"])
            at = int(ends[-1])


def stream(spans: DataFrame, tokens: int, chunk: int) -> DataFrame:
    """source, c, g: the place in the stream of the first token of every chunk. spans: stretches (base, m) of the queues, with total and quantum."""
    first = F.expr(f"(base + {chunk} - 1) div {chunk}")
    after = F.expr(f"(base + m + {chunk} - 1) div {chunk}")
    own = spans.where(first < after).select("source", "total", "quantum", F.explode(F.sequence(first, after - 1)).alias("c"))
    end = F.least((F.col("c") + 1) * chunk, F.col("total"))
    own = own.select("source", "c", F.expr(f"(least((c + 1) * {chunk}, total) * {UNIT} + quantum - 1) div quantum").alias("round"), (end - F.col("c") * chunk).alias("n"))
    ranges = min(RANGES, buckets_for(tokens, chunk * PER_RANGE))
    by = ["round", "source", "c"]
    order = materialise(own.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(_running, ORDER), "order")
    parts = order.groupBy("part").agg(F.min(F.struct(*by)).alias("first"), F.sum("n").alias("n")).orderBy("first").collect()
    before = np.cumsum([0] + [r["n"] for r in parts]).tolist()
    starts = spans.sparkSession.createDataFrame([(r["part"], x) for r, x in zip(parts, before, strict=False)], "part int, start long")
    return order.join(F.broadcast(starts), "part").select("source", "c", (F.col("start") + F.col("at")).alias("g"))


PIECE = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _cut(n: np.ndarray, base: int, places: np.ndarray, chunk: int, window: int):
    """The pieces (document, start, length, place in the stream) of documents of n tokens that follow each other in a queue from base on."""
    last = base + np.cumsum(n)
    first = last - n
    c0 = first // chunk
    k = (last - 1) // chunk - c0 + 1
    doc = np.repeat(np.arange(len(n)), k)
    c = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + c0[doc]
    a, b = np.maximum(first[doc], c * chunk), np.minimum(last[doc], (c + 1) * chunk)
    g = places[c - base // chunk] + a - c * chunk
    # A piece that crosses windows' ends is cut there.
    while (two := (cut := (g // window + 1) * window - g) < b - a).any():
        doc, a, b, g = (np.concatenate(x) for x in ((doc, doc[two]), (a, (a + cut)[two]), (np.where(two, a + cut, b), b[two]), (g, (g + cut)[two])))
    o = np.lexsort((a, doc))
    doc, a, b, g = doc[o], a[o], b[o], g[o]
    # Neighbours in their document that are neighbours in one window are one piece.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1] + (b - a)[:-1]) | (g[1:] % window == 0)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], a[heads] - first[doc[heads]], b[tails] - a[heads], g[heads]


def _pieces(chunk: int, window: int):
    def rows(t: pa.Table, held: pa.Table) -> pa.Table:
        if not t.num_rows:
            return PIECE_ARROW.empty_table()
        ids, raw, source = (t.column(x).to_pylist() for x in ("doc_id", "ids", "source"))
        order = sorted(range(len(ids)), key=lambda i: (source[i], ids[i] is not None, ids[i] or 0, raw[i]))
        held = held.sort_by([("source", "ascending"), ("c", "ascending")])
        names = held.column("source").to_pylist()
        places, base = held.column("g").to_numpy(), held.column("base").to_numpy()
        n = t.column("n").to_numpy()[order]
        parts, i, j = [], 0, 0
        while i < len(order):
            x, i1, j1 = source[order[i]], i, j
            while i1 < len(order) and source[order[i1]] == x:
                i1 += 1
            while j1 < len(names) and names[j1] == x:
                j1 += 1
            doc, start, length, g = _cut(n[i:i1], int(base[j]), places[j:j1], chunk, window)
            parts.append((doc + i, start, length, g))
            i, j = i1, j1
        doc, start, length, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        crc, at = np.empty(len(doc), np.int64), -1
        for i, (d, s, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
            if d != at:
                x = raw[order[d]]
                view, at = memoryview(np.frombuffer(x, f"<u{len(x) // n[d]}").astype("<u4").tobytes()), d
            crc[i] = zlib.crc32(view[4 * s : 4 * (s + m)])
        who = pa.array(np.array(order)[doc])
        cols = [t.column("doc_id").take(who), t.column("source").take(who), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], g // window, g % window))]
        return pa.table(cols, schema=PIECE_ARROW)

    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 1024, chunk: int = 128, weights: dict[str, float] | None = None, per_bucket: int = 4000) -> DataFrame:
    """The pieces of every document: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset. weights: target share by source, by default its own."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("source", F.lit("")).alias("source"))
    t = materialise(d.mapInArrow(_tokenise(vocabulary or default_vocabulary()), TOKENS), "tokens")
    t = t.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets_for(t.count(), per_bucket))))
    by = materialise(t.groupBy("source", "bucket").agg(F.sum("n").alias("m")), "stretches")
    spent = [MADE[-1]]
    queues = materialise(quanta(by.groupBy("source").agg(F.sum("m").alias("total")), weights, window), "queues")
    spent.append(MADE[-1])
    base = F.sum("m").over(Window.partitionBy("source").orderBy("bucket")) - F.col("m")
    spans = materialise(by.withColumn("base", base).join(queues, "source"), "spans")
    places = stream(spans, by.agg(F.sum("m")).first()[0] or 0, chunk)
    c = F.explode(F.sequence(F.expr(f"base div {chunk}"), F.expr(f"(base + m - 1) div {chunk}"))).alias("c")
    # An explosion's size is underrated by the planner, which would broadcast it.
    held = spans.select("source", "bucket", "base", c).hint("merge").join(places.hint("merge"), ["source", "c"])
    drop(docs.sparkSession, spent)
    return t.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_pieces(chunk, window), PIECE)


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
