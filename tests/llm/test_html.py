import math
import random

import pytest

from leafweave.llm.html_extract import ARTICLE, LEAST, OPEN, RUN, SHARE, Streams, extract, kept, needed, read_page, suffix_array

HEADED = """<html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body%s><header>Site <nav><a>Menu</a></nav></header>
<div class="cookie-notice">We use cookies</div><article%s><h1>Head &amp; line</h1><p>One <b>two<br>three&nbsp;x<p>four</p><div class="ad">Buy now</div><aside>side</aside>
<form>mail <input></form><p>fi<i>ve</i></p><section class="comments"><article>rude</article></section></article><footer>&copy; foot</footer></body>"""


def main_text(page):
    blocks, seen = read_page(page)
    zone = ARTICLE if seen else OPEN
    return " ".join(w for words, z in blocks if z == zone for w in words)


@pytest.mark.parametrize(("body", "article"), [("", ""), (' class="has-sidebar"', ""), ("", ' class="post social-science"'), (' class="sidebar"', ' class="widget"'), (' style="display:none"', ' id="main-content"')])
def test_marked_article(body, article):
    assert main_text(HEADED % (body, article)) == "Head & line One two three x four five"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='widget'><article>in</article></div><div class='comments'><article>c</article></div>", "in"),
        ("<article>own</article><div class='widget'><article>teaser</article></div>", "own"),
        ("<main><div class='related'><article>card</article></div><p>text</main>", "text"),
        ("<form><div class=content><article>art</article></div></form>", "art"),
        ("<html><head><title>x</title><p>para", "para"),
        ("<article>a<span class='ad'>x<span>y</span>z</span>b c", "ab c"),
        ("<div>un <i>marked</i></div><nav>n</nav>", "un marked"),
        ("<ul><li class=menu-item>a<ul><li>b</li><li>c</li></ul></li><li>d</ul>", "d"),
        ("<article><div class='page-header'><h1>Title</h1></div>t</article><div class='page-header'>no</div>", "Title t"),
        ("<article>open &lt; <b>bold", "open < bold"),
        ("plain", "plain"),
        ("</div></p>x", "x"),
        ("<!-- never closed", ""),
        ("<script>x", ""),
        ("", ""),
    ],
)
def test_plain_reader(page, text):
    assert main_text(page) == text


def test_whole_suffix_array():
    import numpy as np

    s = np.random.default_rng(0).integers(0, 3, 200)
    assert suffix_array(s).tolist() == sorted(range(200), key=lambda i: s[i:].tolist())


def plain_counts(pages, run):
    """Of each block the least number of pages that hold one of its runs, pads included."""
    pad = [""] * (run - 1)
    runs = lambda b: [tuple((pad + b + pad)[k : k + run]) for k in range(len(b) + run - 1)]
    where = {}
    for i, p in enumerate(pages):
        for b in p:
            for r in runs(b):
                where.setdefault(r, set()).add(i)
    return [[min(len(where[r]) for r in runs(b)) for b in p] for p in pages]


def some_pages(r, n):
    common = [[f"c{r.randrange(9)}" for _ in range(k)] for k in (1, 2, 9, 14)]
    pages = []
    for _ in range(n):
        p = [[f"u{r.randrange(12)}" for _ in range(r.randrange(1, 15))] for _ in range(r.randrange(4))]
        pages.append(p + [list(c) for c in common if r.random() < 0.7])
        r.shuffle(pages[-1])
    return [*pages, []]


def flat(p):
    ends, n = [], 0
    for b in p:
        n += len(b)
        ends.append(n)
    return [w for b in p for w in b], ends


def test_counts_by_brute_force():
    r = random.Random(2)
    for run in (3, 6):
        pages = some_pages(r, 15)
        s = Streams.of(*map(list, zip(*map(flat, pages), strict=True)), run)
        assert s.least(s.counts()) == plain_counts(pages, run)


def plain_extract(rows, run=RUN, share=SHARE, least=LEAST, box=0.2):
    """The rule of the module over all pages of a host at once, by sets of runs."""
    from urllib.parse import urlsplit

    hosts, out = {}, []

    def _host(u):
        return (urlsplit(u or "").hostname or "") if "//" in (u or "") else ""

    for _, u, h in rows:
        hosts.setdefault(_host(u), {})[str(read_page(h or ""))] = None
    texts = {}
    for host, contents in hosts.items():
        pages = [eval(c) for c in contents]
        need = max(least, math.ceil(share * len(pages)))
        for (blocks, seen), low in zip(pages, plain_counts([[b for b, _ in p] for p, _ in pages], run), strict=True):
            zone = ARTICLE if seen else OPEN
            own = [(b, k >= need) for (b, z), k in zip(blocks, low, strict=True) if z == zone]
            lost, size = sum(len(b) for b, g in own if g), sum(len(b) for b, _ in own)
            spare = seen and lost > box * size
            texts[host, str((blocks, seen))] = " ".join(w for b, g in own if spare or not g for w in b)
    for i, u, h in rows:
        out.append((i, u, texts[_host(u), str(read_page(h or ""))]))
    return out


def site(r, host, n, marked):
    menu, foot, box = "home news sport weather shop about us", "all rights reserved", "Subscribe to our weekly letter"
    rows = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(f'{r.choice(chr(97) + chr(98))}{r.randrange(500)}' for _ in range(r.randrange(8, 30)))}</p>" for _ in range(r.randrange(3, 6)))
        body += f"<div>{box}</div><p>end {i}</p>"
        rows.append((r.randrange(10**6), f"http://{host}/p{i}", f"<body><div>{menu}</div>{'<article>' * marked}{body}{'</article>' * marked}<div>{foot}</div></body>"))
    return rows


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = site(r, "a.example", 40, True) + site(r, "b.example", 30, False) + site(r, "c.example", 2, False)
    rows += rows[3:9] + [(rows[0][0], "http://a.example/x", rows[50][2]), (None, "http://b.example/", rows[45][2]), (None, None, None), (5, None, "<p>one"), (6, "bad url", "")]
    rows += [(900 + k, "http://d.example/", f"<article><p>{' '.join(f'w{x}' for x in range(40))}</p><p>{k % 3}</p></article>") for k in range(12)]  # copies, but for a word
    rows += [(950, "http://a.example/long", "<article><p>" + " ".join(f"l{r.randrange(10**6)}" for _ in range(60_000)) + "</p></article>")]
    df = spark.createDataFrame([(*p, 1, "m", "k", 3) for p in rows], "page_id long, url string, html string, n long, host string, key string, uid int")
    want = sorted(plain_extract(rows), key=str)
    assert any("w39 0" in w[2] for w in want)  # near copies keep their article
    text = {w[1]: w[2] for w in want}
    assert "Subscribe" not in text["http://a.example/p9"] and "home" not in text["http://b.example/p9"] and "reserved" not in text["http://b.example/p9"]
    for shard, words, at_once in ((1000, 10**9, 10**6), (7, 10**9, 10**6), (1000, 900, 20)):
        got = [(x["page_id"], x["url"], x["text"]) for x in extract(df, per_shard=shard, per_words=words, at_once=at_once).collect()]
        assert sorted(got, key=str) == want
    assert extract(df.limit(0)).count() == 0


def test_threshold():
    assert [needed(n) for n in (1, 2, 4, 6, 7, 100)] == [3, 3, 3, 3, 4, 50]
    assert kept(["a", "b", "c"], [1, 3], [ARTICLE, ARTICLE], ARTICLE, [False, True], 0.7) == ("a", 2)
    assert kept(["a", "b", "c"], [1, 3], [ARTICLE, ARTICLE], ARTICLE, [False, True], 0.6) == ("a b c", 0)
