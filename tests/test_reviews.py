"""Reviews of blocks and selections of nodes on small rows."""

import pytest
from pyspark.sql import functions as F

from leafweave.operators import review, selection

BLOCK = "doc_id long, page long, block_no long, text string, block_type string, label string, region_role string, region long, unmatched boolean"


def _block(no, text, region=None, kind="text", page=1, label=None):
    return (1, page, no, text, kind, label, None, region, region is None)


def test_fragments_join_their_neighbour(spark):
    rows = [_block(1, "The first part of", 7), _block(2, "a sentence that ends."), _block(3, " A new one. ", 7), _block(4, "and more,"), _block(5, "Other region.", 8)]
    b = spark.createDataFrame(rows, BLOCK)
    p = {r["block_no"]: r for r in review.fragment_proposals(b).collect()}
    assert set(p) == {1, 2, 4}
    assert (p[2]["confidence"], p[2]["target_no"], p[2]["direction"], p[2]["reason"]) == ("HIGH", 1, "attach_after_previous", "lowercase_or_continuation_prefix")
    assert p[1]["confidence"] is None and not p[1]["unmatched"]
    assert p[4]["confidence"] is None and not p[4]["bridge"] and p[4]["target_no"] is None
    got = {r["block_no"]: (r["text"], r["absorbed"]) for r in review.attach_fragments(b, review.fragment_proposals(b)).collect()}
    assert got == {1: ("The first part of a sentence that ends.", 1), 3: ("A new one.", 0), 4: ("and more,", 0), 5: ("Other region.", 0)}


def test_fragments_stop_at_pages_and_chains(spark):
    b = spark.createDataFrame([_block(1, "It goes on and", 7), _block(2, "on.", page=2), _block(3, None, 7, page=2), _block(4, "", page=2), _block(5, "NEWS", page=2)], BLOCK)
    p = {r["block_no"]: r for r in review.fragment_proposals(b).collect()}
    assert p[2]["target_no"] is None and not p[2]["bridge"] and 3 not in p and 4 not in p and 5 not in p
    # A block that is itself absorbed takes nothing.
    b = spark.createDataFrame([_block(i, x) for i, x in ((1, "a"), (2, "b"), (3, "c"))], BLOCK)
    chain = spark.createDataFrame([(1, 2, 1, "HIGH"), (1, 3, 2, "HIGH")], "doc_id long, block_no long, target_no long, confidence string")
    assert {r["block_no"]: r["text"] for r in review.attach_fragments(b, chain).collect()} == {1: "a b", 3: "c"}
    assert review.attach_fragments(b.where("false"), chain).count() == 0


def test_routing(spark):
    rows = [
        ("evidence_content", "•", None, False, False, "template"),
        ("evidence_content", "x" * 200, "NAVIGATION", False, False, "evidence_content"),
        ("evidence_content", "x" * 200, "NAVIGATION", False, True, "navigation"),
        ("evidence_content", "x" * 200, "FULL_AD", False, False, "advertisement"),
        ("evidence_content", "www.example.org", None, False, True, "template"),
        ("evidence_content", "www.example.org", None, False, False, "evidence_content"),
        ("document_title", "T", "FULL_AD", True, True, "document_title"),
        ("section_heading", "S", None, True, False, "template"),
        ("evidence_content", None, None, False, False, "template"),
    ]
    b = spark.createDataFrame(rows, "role string, text string, page_role string, template boolean, unmatched boolean, want string")
    assert all(r["routed"] == r["want"] for r in review.route_roles(b).collect())


@pytest.mark.parametrize(
    ("text", "title", "flags", "score", "status"),
    [
        ("plain", None, None, 0.0, "accepted"),
        ("", None, ["phone_number_detected"], 0.25, "empty"),
        (None, None, [], 0.0, "empty"),
        ("me@example.org", None, ["email_detected", "phone_number_detected", "unknown"], 0.37, "entity_masked"),
        ("x", None, ["inside_complex_layout_container", "metadata_or_advertisement_keyword"], 0.42, "metadata_only"),
        ("x", None, ["repeated_bigram_loop", "low_unique_token_ratio", "very_long_unspaced_token"], 0.8, "quarantined"),
        ("x", "A caption", ["abnormal_character_distribution", "low_unique_token_ratio"], 0.2, "accepted"),
        ("x", None, ["abnormal_character_distribution", "low_unique_token_ratio"], 0.4, "needs_review"),
        ("x", None, ["text_inside_visual_region_possible_valid", "low_unique_token_ratio"], 0.0, "accepted"),
        ("x", None, ["secondary_ocr_strong_disagreement", "phone_digit_sequence_disagreement"], 0.95, "quarantined"),
    ],
)
def test_verify(spark, text, title, flags, score, status):
    r = review.verify(spark.createDataFrame([(text, title, flags)], "text string, title string, flags array<string>"), allow_medium=True).first()
    assert (r["risk_score"], r["status"]) == (score, status)
    assert r["index_text"] == {"accepted": text, "needs_review": text, "entity_masked": "[UNVERIFIED_EMAIL]"}.get(status, "")
    assert r["use_for_nodes"] == (status == "accepted") and r["use_for_embedding"] == (status in ("accepted", "needs_review", "entity_masked"))


def _nodes(spark, units):
    return spark.createDataFrame([(1, i, u) for i, u in enumerate(units)], "doc_id long, idx long, unit long")


def _idx(df):
    return sorted(r["idx"] for r in df.collect())


def test_pilots(spark):
    n = _nodes(spark, [0] * 22 + [1] * 30 + [2] * 30 + [3] * 5)
    assert _idx(selection.article_pilot(n)) == list(range(22, 47))
    assert _idx(selection.bridge_pilot(n)) == list(range(40, 65))
    assert _idx(selection.article_pilot(_nodes(spark, [0] * 19))) == []
    assert _idx(selection.bridge_pilot(_nodes(spark, [0] * 18 + [1] * 3))) == list(range(21))
    assert _idx(selection.bridge_pilot(_nodes(spark, [0] * 25))) == []
    # Sections 0 and 1 are too small together, 1 and 2 are not; without any such run, the first two.
    assert _idx(selection.section_pilot(_nodes(spark, [0] * 3 + [1] * 4 + [2] * 16))) == list(range(3, 23))
    assert _idx(selection.section_pilot(_nodes(spark, [0, 1, None, 2]))) == [0, 1, 2]


def test_pairs(spark):
    n = _nodes(spark, [5, 5, None])
    p = spark.createDataFrame([(1, 0, 2, "x"), (1, 0, 1, "x")], "doc_id long, a long, b long, reason string")
    got = {(r["a"], r["b"]): (r["reasons"], r["scope"]) for r in selection.add_nearby(n, p, 1).collect()}
    assert got == {(0, 1): ("high_recall_distance_window,same_content_unit,x", "WITHIN_CONTENT_UNIT"), (1, 2): ("high_recall_distance_window", "UNSCOPED"), (0, 2): ("x", None)}
    t = spark.createDataFrame([(1, 9, [3, 4, 3], 2), (2, 3, [9, 5], 2), (3, 1, [2], 0), (4, 1, None, 3)], "task long, current long, ranked array<long>, cutoff long")
    assert sorted(tuple(r) for r in selection.ranked_pairs(t).collect()) == [(3, 5, 2, 2), (3, 9, 1, 1), (4, 9, 1, 2)]


def test_decided_segments(spark):
    n = spark.createDataFrame([(1, i) for i in range(6)], "doc_id long, idx long")
    d = spark.createDataFrame([(1, 0, "STARTS_NEW_ITEM", 0.9, "a"), (1, 2, "STARTS_NEW_ITEM", 0.8, "b"), (1, 3, "STARTS_NEW_ITEM", 0.79, "c"), (1, 4, "CONTINUES", 1.0, "d"), (1, 5, "INSERTED_STANDALONE_ITEM", 1.0, None)], "doc_id long, idx long, decision string, confidence double, kind string")
    got = sorted(tuple(r)[1:] for r in selection.decided_segments(n, d).collect())
    assert got == [(1, "DOCUMENT_START", "front_matter", 2, 0, 1), (2, "STARTS_NEW_ITEM", "b", 3, 2, 4), (3, "INSERTED_STANDALONE_ITEM", "other", 1, 5, 5)]
    assert selection.decided_segments(n.where("false"), d).count() == 0


def test_outer_pages(spark):
    p = spark.createDataFrame([(1, i % 6) for i in range(12)], "doc_id long, page long")
    assert sorted(r["page"] for r in selection.outer_pages(p, 2, 1).collect()) == [0, 1, 5]
    assert [(r["place"], r["previous"], r["following"]) for r in selection.adjacency(spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "doc_id long, idx long, id long")).orderBy("place").collect()] == [(1, None, 11), (2, 10, None)]
