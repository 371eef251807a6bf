"""Telephone numbers, masks, flags of blocks and second readings on small rows."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafweave.functions import text as tx
from leafweave.operators import review


@pytest.mark.parametrize(
    ("text", "phones", "masked"),
    [
        ("Tel: 022 767 61 11.", ["022 767 61 11"], "Tel: [UNVERIFIED_PHONE]."),
        ("call +41 22 767 6111 or fax: +41 22 767 6111", ["+41 22 767 6111"], "call [UNVERIFIED_PHONE] or fax: [UNVERIFIED_PHONE]"),
        # The pattern of ISBNs takes bare runs of digits too.
        ("a+41227676111 and +41227676111b", [], "a+[UNVERIFIED_ISBN] and +41227676111b"),
        ("phone 12345", [], "phone 12345"),
        ("tel 123.456.7890", [], "tel 123.456.7890"),
        ("1227676111", [], "[UNVERIFIED_ISBN]"),
        ("ISBN 978-3-16-148410-0 of me@example.org", [], "[UNVERIFIED_ISBN] of [UNVERIFIED_EMAIL]"),
        ("", [], ""),
        (None, None, None),
    ],
)
def test_phones(spark, text, phones, masked):
    r = spark.createDataFrame([(text,)], "t string").select(tx.phones(F.col("t")).alias("p"), tx.masked_fully(F.col("t")).alias("m")).first()
    assert (r["p"], r["m"]) == (phones, masked)


def test_flags(spark):
    rows = [
        (1, 1, "Published by me@example.org", [7, 8], "figure"),
        (1, 2, "Tel: 022 767 61 11", [7, None], ""),
        (1, 3, None, None, "table"),
        (2, 4, "see https://example.org and 10.1234/abc", [7], None),
        (None, 5, "plain", [7], "table"),
    ]
    b = spark.createDataFrame(rows, "page long, block_id long, text string, regions array<long>, region_type string")
    got = {r["block_id"]: r["flags"] for r in review.block_flags(b).collect()}
    layout = ["inside_complex_layout_container", "layout_type_figure", "text_inside_visual_region_possible_valid"]
    assert got == {
        1: sorted([*layout, "inside_visual_region_possible_valid", "metadata_or_advertisement_keyword", "email_detected"]),
        2: sorted([*layout, "metadata_or_advertisement_keyword", "phone_number_detected", "isbn_detected"]),
        3: ["empty_text", "inside_table_like_region"],
        4: ["doi_detected", "url_detected"],
        5: ["inside_table_like_region"],
    }
    assert review.block_flags(b.where("false")).count() == 0


def test_second_reading(spark):
    long = "the quick brown fox jumps over the lazy dog again and again"
    rows = [
        (1, long, long.upper(), []),
        (2, long, "9876 54321 !!!! ????", ["secondary_ocr_strong_disagreement"]),
        (3, long, "thequickbrownfoxjumpsoverthelazydog againandagain", ["secondary_ocr_partial_disagreement"]),
        (4, long, "the quick fox wanders off", ["secondary_ocr_partial_disagreement"]),
        (5, "short", "other", []),
        (6, long, "", ["secondary_ocr_empty"]),
        (7, None, None, ["secondary_ocr_empty"]),
        (8, "tel: 022 767 61 11", "tel something", ["phone_not_supported_by_secondary_ocr"]),
        (9, "tel: 022 767 61 11", "tel: 022 767 61 12", ["phone_digit_sequence_disagreement"]),
        (10, "tel: 22 767 61 11", "tel: 022 767 61 11", []),
    ]
    d = spark.createDataFrame(rows, "id long, text string, second string, want array<string>")
    got = review.second_reading(d).collect()
    assert {r["id"]: r["disagreement"] for r in got} == {r["id"]: r["want"] for r in got}
    assert SequenceMatcher(None, long, rows[2][2]).ratio() >= 0.3 and review.second_reading(d.where("false")).count() == 0
