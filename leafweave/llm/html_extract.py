"""HTML main-text extraction with a suffix array per host.

A page is read as a stream of blocks of words. Markup gives each block a feature: within a marked article (article, main,
role=main), within a part that tags, roles or whole class tokens call a menu, header, footer, sidebar, notice, advert, form
or comments, or neither. A mark never silences an article or what surrounds it, unless the page has another article outside
marks; only menus, footers, asides, comments and related items hold articles that are not the page's own.

The streams of a host's distinct pages are concatenated, blocks parted by pads and pages by separators, and a suffix array with
longest common prefixes counts for each run of `run` words in how many distinct pages it is found. It decides every block that
markup leaves open, inside marked articles and, on pages without one, everywhere: a block goes if each of its runs is found in
`share` of the host's distinct pages and in `least` of them. Pads let a run end with its block, so that a short block counts as
a whole. So phrases, quotations and copies among a host's pages stay, and what most of its pages repeat goes, whole blocks at a
time. Boxes inside an article are a small part of it: if repeated blocks hold over `box` of its words, the page is one of many near
copies and its article stays whole. On pages with a marked article, text outside it is not main text.

A host's contents are dealt to shards of about `per_shard` pages and `per_words` words by their hash. What travels of a page,
once a task for all copies in it, are 16 bits a word (96 bits a run), and 47 bits for the whole of a block shorter than a run. A shard's array names the runs found in a fair part of its pages, with
counts, which are added up over the host's shards: a host of any size gives what one array over it would give. (What a shard does
not name, since it falls short of the share by eight standard deviations, counts nothing; contents being dealt by hash, no run of the
share is so rare in any. Shards of few pages name all, a host's only shard what it repeats.) Pages are then decided where they lie.

Defined cases: null html gives empty text; null url is a host of its own; very long pages are read whole and have a shard nearly to
themselves; rows repeated with one page_id, and null page_ids, give a row each; equal pages count as one; a host of fewer than
`least` distinct pages repeats nothing; a run found in exactly the share goes; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import MADE, buckets_for, drop, materialise, slices, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|button|title|canvas|object|math|xmp|noembed)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements by what they are for: those that may hold articles of others, those that may wrap a page's own, those that stand on top.
APART = frozenset("nav footer aside".split())
WRAPPING = frozenset("form dialog menu".split())
HEAD = frozenset("title meta link base style script noscript template".split())
#: Elements that an opening tag ends where they are left open.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset("article main".split())
#: Class tokens and ids, whole or joined by hyphens with each other and with words that say nothing.
CALLED_APART = frozenset("comment comments disqus respond related recommended nav navbar navigation menu footer breadcrumb breadcrumbs pagination pager".split())
CALLED = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal overlay sidebar share sharing social topbar toolbar widget widgets login search skip".split())
CALLED_TOP = frozenset("header masthead".split())
PLAIN_WORDS = frozenset("site page main top bottom left right box block container wrapper wrap list section area bar link links text inner outer slot unit item items form reader readers user primary secondary global the js id".split())
ROLES_APART = frozenset("navigation contentinfo complementary".split())
ROLES = frozenset("search dialog alert alertdialog menu menubar toolbar form".split())
#: What a mark does: nothing, silence what does not hold the page's article, silence outside articles, silence all.
FREE, SOFT, TOP, HARD = 0, 1, 2, 3
ARTICLE, OPEN, MARKED = 0, 1, 2
RUN, SHARE, LEAST, BOX = 6, 0.5, 3, 0.2
PER_SHARD, PER_WORDS = 256, 150_000
#: Bytes of markup for a word, where shards are counted before pages are parsed.
WORD_BYTES = 6
#: Large hosts that are broadcast, and repeated runs that are at a time, 8 bytes each.
SMALL, RUNS = 200_000, 2_000_000


@functools.lru_cache(4096)
def _called(token: str) -> int:
    parts = [x for x in re.split(r"[-_]+", token) if x]
    marks = CALLED_APART | CALLED | CALLED_TOP
    if not any(x in marks for x in parts) or not all(x in marks or x in PLAIN_WORDS or x.isdigit() for x in parts):
        return FREE
    return HARD if not CALLED_APART.isdisjoint(parts) else SOFT if not CALLED.isdisjoint(parts) else TOP


def _attributes(raw: str) -> tuple[int, bool]:
    """What an element's attributes mark it as, and whether they call it the main part."""
    mark, main = FREE, False
    for m in ATTR.finditer(raw):
        k, v = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if k in ("class", "id"):
            for x in v.split():
                mark = max(mark, _called(x))
        elif k == "role":
            main |= v == "main"
            mark = max(mark, HARD if v in ROLES_APART else SOFT if v in ROLES else TOP if v == "banner" else FREE)
        elif (k == "style" and "display:none" in v.replace(" ", "")) or (k in ("hidden", "aria-hidden") and v != "false"):
            mark = max(mark, SOFT)
    return mark, main


class _Tree:
    """A page's elements, as far as they matter, and its text by element; None in the text is the border of a block."""

    def __init__(self):
        self.parent, self.mark, self.main, self.wraps = [-1], [FREE], [False], [False]
        self.text: list[tuple[int, str] | None] = []

    def add(self, parent: int, mark: int, main: bool, wraps: bool) -> int:
        for x, v in ((self.parent, parent), (self.mark, mark), (self.main, main), (self.wraps, wraps)):
            x.append(v)
        return len(self.parent) - 1

    def zones(self) -> tuple[list[int], bool]:
        """The zone of each element, and whether any is a marked article."""

        def resolve(spared: set[int]) -> list[int]:
            zone = [OPEN]
            for k in range(1, len(self.parent)):
                above, mark = zone[self.parent[k]], self.mark[k]
                silent = above == MARKED or (not self.main[k] and (mark == HARD or (mark == TOP and above != ARTICLE) or (mark == SOFT and k not in spared)))
                zone.append(MARKED if silent else ARTICLE if self.main[k] else above)
            return zone

        zone = resolve(set())
        if ARTICLE in zone or not any(self.main):
            return zone, ARTICLE in zone
        # Every article lies in something marked: what wraps one, and is not apart, does not silence it.
        spared: set[int] = set()
        for k, main in enumerate(self.main):
            way, at = [], k
            while main and at > 0:
                way.append(at)
                at = self.parent[at]
            if not any(self.mark[x] == HARD and not self.main[x] for x in way):
                spared.update(way)
        zone = resolve(spared)
        return zone, ARTICLE in zone


def read_page(page: str) -> tuple[list[tuple[list[str], int]], bool]:
    """The blocks of a page, each its words and zone, and whether the page marks an article."""
    tree, stack, at = _Tree(), [("", 0)], 0

    def border():
        if tree.text and tree.text[-1] is not None:
            tree.text.append(None)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            tree.text.append((stack[-1][1], html.unescape(page[at : m.start()])))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                border()
            continue
        inline = tag in INLINE and tag != "label"
        if not inline:
            border()
        if tag in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        mark, main = _attributes(m[4]) if m[4] else (FREE, False)
        if inline and mark == FREE and not any(x[0] == tag for x in stack):
            continue  # of no state, nor inside one whose end it could be taken for
        while stack[-1][0] in ENDS.get(tag, ()) or (not inline and stack[-1][0] == "p") or (stack[-1][0] == "head" and tag not in HEAD):
            stack.pop()
        main |= tag in MAIN
        if tag in APART or tag == "head":
            mark = HARD
        elif tag == "header":
            mark = max(mark, TOP)
        elif tag in WRAPPING:
            mark = max(mark, SOFT)
        elif tag in ("html", "body"):
            mark = FREE
        stack.append((tag, tree.add(stack[-1][1], mark, main, tag in WRAPPING)))
    if at < len(page):
        tree.text.append((stack[-1][1], html.unescape(page[at:])))
    zone, seen = tree.zones()
    blocks, parts = [], {}
    for x in [*tree.text, None]:
        if x is not None:
            parts.setdefault(zone[x[0]], []).append(x[1])
            continue
        for z, strings in parts.items():
            if w := "".join(strings).split():
                blocks.append((w, z))
        parts = {}
    return blocks, seen


def host_of(url: Column) -> Column:
    """The host that a URL names, lower-cased; nothing for others."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1)), F.lit(""))


READ = "page_id long, url string, host string, key long, fresh boolean, open int, words binary, ends array<int>, zones array<int>"


def tokens(words: list[bytes], ends: list[int], run: int) -> tuple[np.ndarray, list[int]]:
    """What a page's stream is made of: 16-bit hashes of the words of its blocks, and one hash for each block too short for a run that pads do not anchor at both ends."""
    long, short, begin = [], [], 0
    for end in ends:
        if end - begin > run - 2:
            long += words[begin:end]
        else:
            short.append(xxhash.xxh64_intdigest(b" ".join(words[begin:end]), 1) >> 17)
        begin = end
    return np.fromiter(map(zlib.crc32, long), np.uint32, len(long)).astype("<u2"), short


def _read(batches):
    """Pages as blocks; `fresh` is the first of a content in its task."""
    seen: set[tuple[str, int]] = set()
    for b in slices(batches, column=3):
        out = [[] for _ in range(6)]
        for host, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            blocks, marked = read_page(h or "")
            words = " ".join(w for x, _ in blocks for w in x).encode()
            ends, zones = np.cumsum([len(x) for x, _ in blocks], dtype=np.int32), np.array([z for _, z in blocks], np.int32)
            zone = ARTICLE if marked else OPEN
            key = xxhash.xxh64_intdigest(words + b"\0" + ends.tobytes() + zones.tobytes() + bytes([zone])) - (1 << 63)
            if len(seen) >= 1 << 20:
                seen.clear()
            for o, v in zip(out, (key, (host, key) not in seen, zone, zlib.compress(words, 1), ends, zones), strict=True):
                o.append(v)
            seen.add((host, key))
        ints = pa.list_(pa.int32())
        cols = [b.column(0), b.column(1), b.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary()), pa.array(out[4], ints), pa.array(out[5], ints)]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "key", "fresh", "open", "words", "ends", "zones"])


# --- the array ----------------------------------------------------------------------------------


def suffix_array(s: np.ndarray, most: int | None = None) -> np.ndarray:
    """By prefix doubling; with `most`, suffixes are told apart by their first `most` tokens at least."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        pair = rank * (n + 1)
        if k < n:
            pair[: n - k] += rank[k:] + 1
        order = np.argsort(pair)
        pair = pair[order]
        step = np.zeros(n, np.int64)
        step[1:] = pair[1:] != pair[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n or (most is not None and k >= most):
            return order


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix and the one before it in the array, up to most words."""
    n, a, b = len(s), sa[1:], sa[:-1]
    lcp, open_ = np.zeros(n, np.int64), np.ones(n - 1, bool)
    for k in range(most):
        open_ &= (a + k < n) & (b + k < n)
        open_[open_] = s[a[open_] + k] == s[b[open_] + k]
        lcp[1:][open_] += 1
    return lcp


class Streams:
    """The token streams of pages, concatenated: run - 1 pads around every block, a separator of its own after every page."""

    def __init__(self, long: list[np.ndarray], short: list[list[int]], ends: list[list[int]], run: int):
        parts, page, first, last, owner, at = [], [], [], [], [], 0
        pad = np.full(run - 1, -1, np.int64)
        for i, (t, u, e) in enumerate(zip(long, short, ends, strict=True)):
            t, u = t.astype(np.int64), iter(u)
            begin, taken, size = 0, 0, 0
            for end in e:
                n = end - begin
                if n > run - 2:
                    block = t[taken : taken + n]
                    taken += n
                else:
                    block = np.array([(1 << 16) + next(u)])
                parts += [pad, block]
                first.append(at + size)  # of the block's runs, the first begins with its pads
                size += run - 1 + len(block)
                last.append(at + size)  # and the last with its last word
                owner.append(i)
                begin = end
            parts += [pad, np.array([-2 - i])]
            size += run
            page.append(np.full(size, i))
            at += size
        self.run, self.s, self.page = run, np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate(page) if page else np.zeros(0, np.int64)
        self.first, self.last, self.owner = np.array(first, np.int64), np.array(last, np.int64), np.array(owner, np.int64)

    @classmethod
    def of(cls, words: list[list[str]], ends: list[list[int]], run: int) -> Streams:
        got = [tokens([x.encode() for x in w], e, run) for w, e in zip(words, ends, strict=True)]
        return cls([x[0] for x in got], [x[1] for x in got], ends, run)

    def counts(self) -> np.ndarray:
        """For each place, in how many distinct pages the run that begins there is found."""
        if not len(self.s):
            return np.zeros(0, np.int64)
        sa = suffix_array(self.s, self.run)
        group = np.cumsum(common_prefixes(self.s, sa, self.run) < self.run)
        pages = int(self.page[-1]) + 1
        held = np.unique(group * pages + self.page[sa]) // pages
        out = np.empty(len(sa), np.int64)
        out[sa] = np.bincount(held, minlength=group[-1] + 1)[group]
        return out

    def keys(self, host: str) -> np.ndarray:
        """A hash of the run that begins at each place, the same in every shard of a host."""
        with np.errstate(over="ignore"):
            h = (self.s.astype(np.uint64) + np.uint64(3)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            out = np.full(len(h), xxhash.xxh64_intdigest(host, 2), np.uint64)
            ext = np.concatenate([h, np.zeros(self.run, np.uint64)])
            for j in range(self.run):
                out = out * np.uint64(0x9E3779B97F4A7C15) + ext[j : j + len(h)]
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def within(self) -> np.ndarray:
        """The places where a run of a block begins."""
        step = np.zeros(len(self.s) + 1, np.int64)
        np.add.at(step, self.first, 1)
        np.add.at(step, self.last, -1)
        return np.cumsum(step[:-1]) > 0

    def least(self, values: np.ndarray) -> list[list]:
        """By page, of each block the least of its runs' values."""
        out: list[list] = [[] for _ in range(int(self.page[-1]) + 1)] if len(self.page) else []
        if len(self.first):
            cuts = np.column_stack([self.first, self.last]).ravel()
            low = np.minimum.reduceat(np.append(values, values[-1:]), cuts)[::2]
            for i, v in zip(self.owner.tolist(), low.tolist(), strict=True):
                out[i].append(v)
        return out


def needed(pages: int, share: float = SHARE, least: int = LEAST) -> int:
    """In how many of a host's distinct pages a run must be found to be repeated."""
    return max(least, math.ceil(share * pages - 1e-9))


def kept(words: list[str], ends: list[int], zones: list[int], zone: int, gone: list[bool], box: float) -> tuple[str, int]:
    """The main text of a page, and how many of its words the array took."""
    begin, text, size, lost = 0, [], 0, 0
    own = []
    for end, z, g in zip(ends, zones, gone, strict=True):
        if z == zone:
            own.append((begin, end, g))
            size += end - begin
            lost += g * (end - begin)
        begin = end
    if zone == ARTICLE and lost > box * size:
        own, lost = [(a, b, False) for a, b, _ in own], 0
    for a, b, g in own:
        if not g:
            text += words[a:b]
    return " ".join(text), lost


STREAM = "host string, key long, long binary, short array<long>, ends array<int>"


def _streams(run: int):
    """What travels of pages."""

    def rows(batches):
        for b in slices(batches, column=2):
            got = [tokens(zlib.decompress(w).split(b" "), e, run) for w, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1] for x in got], pa.list_(pa.int64())), b.column(3)], names=["host", "key", "long", "short", "ends"])

    return rows


NAMED = "host string, w long, k long"


def _named(run: int, share: float, least: int):
    """A shard: the runs that many of its distinct pages hold, with counts, and the number of these pages under no run. A host's only shard names just what is repeated."""

    def rows(t: pa.Table) -> pa.Table:
        _, first = np.unique(t.column("key").to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        host, n = t.column("host")[0].as_py(), t.num_rows
        enough = needed(n, share, least) if t.column("shards")[0].as_py() == 1 else max(1, math.floor(share * n - 8 * math.sqrt(n * share * (1 - share))))
        w, k = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if enough <= n:
            s = Streams([np.frombuffer(x, "<u2") for x in t.column("long").to_pylist()], t.column("short").to_pylist(), t.column("ends").to_pylist(), run)
            counts = s.counts()
            hit = s.within() & (counts >= enough)
            if hit.any():
                w, at = np.unique(s.keys(host)[hit], return_index=True)
                k = counts[hit][at]
        return pa.table({"host": pa.array([host] * (len(w) + 1), pa.string()), "w": pa.array([None, *w.tolist()], pa.int64()), "k": pa.array([n, *k.tolist()], pa.int64())})

    return rows


TEXT = "page_id long, url string, text string, n_repeated int"


def beginnings(words: list[str], ends: list[int], run: int) -> tuple[list[str], list[int], list[bool]]:
    """The first `run` words of every block, and whether these are all of it: most blocks differ from what is repeated there."""
    begin, out, cuts, whole = 0, [], [], []
    for end in ends:
        out += words[begin : min(end, begin + run)]
        cuts.append(len(out))
        whole.append(end - begin <= run)
        begin = end
    return out, cuts, whole


def _texts(repeated, hosts, run: int, box: float):
    """The main texts of pages, given all repeated runs and the hashes of the hosts that have any."""

    def rows(batches):
        known, some = repeated.value, hosts.value

        def repeats(words: list[str], ends: list[int], host: str, whole: list[bool] | None = None) -> list[bool]:
            s = Streams.of([words], [ends], run)
            keys = s.keys(host)
            hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
            if whole is not None:  # of a block cut short only runs that begin before its last word are its own
                cut = np.flatnonzero(~np.array(whole))
                for i in cut.tolist():
                    hit[s.last[i] - run + 1 : s.last[i]] = True
            return s.least(hit)[0]

        for b in slices(batches, column=5):
            text, lost = [], []
            for host, zone, words, ends, zones in zip(*(b.column(k).to_pylist() for k in (2, 4, 5, 6, 7)), strict=True):
                words = zlib.decompress(words).decode().split(" ") if ends else []
                gone = [False] * len(ends)
                if ends and xxhash.xxh64_intdigest(host, 2) in some and any(repeats(*(part := beginnings(words, ends, run))[:2], host, part[2])):
                    gone = repeats(words, ends, host)
                x, n = kept(words, ends, zones, zone, gone, box)
                text.append(x)
                lost.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(lost, pa.int32())], names=["page_id", "url", "text", "n_repeated"])

    return rows


def extract(pages: DataFrame, run: int = RUN, share: float = SHARE, least: int = LEAST, box: float = BOX, per_shard: int = PER_SHARD, per_words: int = PER_WORDS, at_once: int = RUNS) -> DataFrame:
    """page_id, url, text, n_repeated (words that the array took) of every row of pages."""
    spark, before = pages.sparkSession, len(MADE)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("host", host_of(F.col("url")))
    p = p.select("page_id", "url", "host", "html")
    size = F.greatest(F.ceil(F.count("*") / per_shard), F.ceil(F.sum(F.octet_length("html")) / (per_words * WORD_BYTES)), F.lit(1))
    large = materialise(p.groupBy("host").agg(size.cast("long").alias("shards")).where("shards > 1"), "hosts")
    read = materialise(p.mapInArrow(_read, READ), "read")
    parsed = MADE[-1]
    dealt = read.where("fresh").select("host", "key", "words", "ends").mapInArrow(_streams(run), STREAM).join(F.broadcast(large) if large.count() <= SMALL else large, "host", "left")
    dealt = dealt.withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod("key", "shards"))
    named = materialise(dealt.groupBy("host", "shard").applyInArrow(_named(run, share, least), NAMED), "named")
    counts = named.where("w is not null").groupBy("host", "w").agg(F.sum("k").alias("k"))
    distinct = materialise(named.where("w is null").groupBy("host").agg(F.sum("k").alias("pages")), "distinct")
    need = F.greatest(F.lit(least), F.ceil(F.col("pages") * share - 1e-9))
    repeated = materialise(counts.join(distinct, "host").where(F.col("k") >= need).select("host", "w"), "repeated")
    passes, out = buckets_for(repeated.count(), at_once), None
    turn = F.pmod(F.xxhash64("host"), F.lit(passes))
    for k in range(passes):
        runs = repeated.where(turn == k).select("w").toArrow().column("w").to_numpy()
        hosts = {xxhash.xxh64_intdigest(r[0], 2) for r in repeated.where(turn == k).select("host").distinct().collect()}  # no more than runs
        mine = read.where(turn == k).select("page_id", "url", "host", "key", "open", "words", "ends", "zones")
        texts = mine.mapInArrow(_texts(spark.sparkContext.broadcast(np.sort(runs)), spark.sparkContext.broadcast(hosts), run, box), TEXT)
        out = texts if out is None else out.unionByName(texts)
    drop(spark, [x for x in MADE[before:] if x != parsed])
    return out


def op9_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
