"""OCR readers and page decisions on small rows, and the greedy steps against brute force."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafweave.operators import pages, retrieval
from leafweave.sources import ocr


def test_grounding(spark):
    rows = [
        (1, "<|ref|> a <|/ref|><|det|>[[0, 0, 999, 999], [10,20,30,40]]<|/det|>"),
        (2, "<|det|>[[5, 6, 1, 2]]<|/det|>"),
        (3, "no tag"),
        (4, None),
        (5, "<|ref|>b<|/ref|><|det|>broken<|/det|>"),
        (6, "<|ref|>c<|/ref|><|det|>[[0, 0, 1500, 20]]<|/det|>"),
    ]
    p = spark.createDataFrame(rows, "page long, text string").withColumn("width", F.lit(1998)).withColumn("height", F.lit(999))
    got = [(r["page"], r["id"], r["text"], r["pixel_bbox"], r["source"]) for r in ocr.grounding(p).orderBy("page", "id").collect()]
    assert got == [
        (1, 0, "a", [0, 0, 1998, 999], "text_ref_det"),
        (1, 1, "a", [20, 20, 60, 40], "text_ref_det"),
        (2, 0, "", [2, 2, 10, 6], "text_det_only"),
        (6, 0, "c", [0, 0, 1500, 20], "text_ref_det"),
    ]
    with pytest.raises(ValueError):
        ocr.grounding(p, "percent")


def test_markdown_blocks(spark):
    md = '<!-- bbox: {"type": "title", "pixel_bbox": [1, 2, 3, 4]} -->\n\nHead\nline\n\nsecond\n<!-- bbox: {broken} -->\n\n<!-- bbox: {"bbox": [5, 6, 7, 8]} -->\r\n| a |\n|---|\n\n\nTable 1 x\n<!-- bbox: {"bbox": [9, 9, 9, 9]} -->'
    p = spark.createDataFrame([("p", md), ("e", ""), ("n", None)], "page string, text string")
    got = [tuple(r) for r in ocr.markdown_blocks(p).select("page", "block_no", "block_type", "markdown", "bbox").orderBy("page", "block_no").collect()]
    assert got == [
        ("p", 1, "heading", "Head\nline", [1, 2, 3, 4]),
        ("p", 2, "text", "second\n<!-- bbox: {broken} -->", None),
        ("p", 3, "table", "| a |\n|---|", [5, 6, 7, 8]),
        ("p", 4, "caption", "Table 1 x", None),
    ]


def test_files(spark, tmp_path):
    for doc, page in (("a", "page_002"), ("a", "page_10"), ("b", "cover")):
        (tmp_path / "in" / doc).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / doc / f"{page}.json").write_text(json.dumps({"doc_id": doc, "page": page}, indent=1))
    p = ocr.read_pages(spark, str(tmp_path / "in"), "doc_id string, page string")
    assert sorted((r["doc_id"], r["page_no"]) for r in p.collect()) == [("a", 2), ("a", 10), ("b", 10**12)]
    e = spark.createDataFrame([("a", "x", "é"), ("b", "y", None)], "doc_id string, source string, target string")
    ocr.write_graph({"edges": e, "empty": e.where("false")}, str(tmp_path / "out"))
    assert sorted(map(tuple, ocr.read_rows(spark, str(tmp_path / "out/edges"), "source string, target string").collect())) == [("x", "é", "a"), ("y", None, "b")]
    assert (tmp_path / "out" / "empty").is_dir()
    (tmp_path / "in" / "b" / "other.json").write_text('{"doc_id": "z", "page": "1"}')
    with pytest.raises(Exception, match="other document"):
        ocr.read_pages(spark, str(tmp_path / "in"), "doc_id string, page string").collect()


def test_paper_regions(spark):
    def regions(ref, ack=()):
        n = spark.createDataFrame([(1, i, i in ref, i == 9, i in ack) for i in range(11)], "doc_id long, idx long, reference boolean, affiliation boolean, acknowledgement boolean")
        return "".join(r["region"][:2] for r in pages.paper_regions(n).orderBy("idx").collect())

    assert regions(range(3, 8)) == "SC" * 3 + "BI" * 5 + "AU" + "AF" * 2
    assert regions(range(3, 8), [1]) == "SC" + "AC" * 2 + "BI" * 5 + "AU" + "AF" * 2
    assert regions([]) == "SC" * 11


def test_title_anchors(spark):
    body = "word " * 40
    rows = [(1, 0, "A Title First"), (1, 1, body), (1, 2, "The Second Title"), (1, 3, "by somebody"), (1, 4, body), (1, 5, "Figure 3"), (1, 6, body), (1, 7, "Ends here."), (1, 8, body), (1, 9, "LAST"), (1, 10, None), (1, 11, "")]
    assert [r["idx"] for r in pages.title_anchors(spark.createDataFrame(rows, "doc_id long, idx long, text string")).collect()] == [2]


def test_greedy_match_one_to_one():
    r = np.random.default_rng(1)
    for _ in range(200):
        gold, found = (sorted(set(r.integers(0, 20, 6).tolist())) for _ in "ab")
        for tolerance in (0, 1, 3):
            m = pages.match_greedily(gold, found, tolerance)
            free, want = set(found), []
            for v in gold:
                near = sorted((abs(v - c), c) for c in free if abs(v - c) <= tolerance)
                if near:
                    free.remove(near[0][1])
                    want.append((v, near[0][1]))
            assert m == want


def test_prune_keeps_its_promise(spark):
    r = np.random.default_rng(2)
    rows = [(d, a, b, float(r.random()), b - a, [x for x in ("same_section", "shared_entities", "explicit_figure_reference") if r.random() < 0.2]) for d in (1, 2) for a, b in itertools.combinations(range(9), 2)]
    p = spark.createDataFrame(rows, "doc_id long, a long, b long, similarity double, distance long, reasons array<string>")
    score, evidence = retrieval.candidate_score(0.5)
    s = {(x["doc_id"], x["a"], x["b"]): (x["s"], x["b"] - x["a"], bool(x["e"])) for x in p.withColumn("s", score).withColumn("e", evidence).collect()}
    want = set()
    for d in (1, 2):
        used = dict.fromkeys(range(9), 0)
        for (_, a, b), (v, _, e) in sorted(((k, x) for k, x in s.items() if k[0] == d), key=lambda t: (-t[1][0], t[1][1], t[0])):
            if v >= 50 or (e and used[a] < 3 and used[b] < 3):
                want.add((d, a, b))
                used[a] += 1
                used[b] += 1
    assert {tuple(x)[:3] for x in retrieval.prune(p, 3).collect()} == want
    assert retrieval.prune(p.where("false")).count() == 0
