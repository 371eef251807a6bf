"""Rules on where articles begin, on small rows."""

import pytest

from leafweave.operators import articles


def test_commercial_roles(spark):
    rows = [
        (0, "Welcome to the digital edition", 2000, 0, "front_matter"),
        (1, "IN THIS ISSUE", 10, 0, "table_of_contents"),
        (2, "short", 100, 1, "cover_or_separator"),
        (3, "From  the\nEditor: www.a.com", 2000, 0, "editorial"),
        (4, "Order now", 3000, 0, "advertisement"),
        (5, "mail me@example.com", 1000, 2, "advertisement"),
        (6, "a product", 500, 5, "content"),
        (7, None, 400, 0, "content"),
        (8, "", 0, 3, "back_cover_or_separator"),
    ]
    p = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, idx long, text string, body_chars long, images long, want string")
    got = articles.commercial_roles(p).collect()
    assert {r["idx"]: r["page_role"] for r in got} == {r["idx"]: r["want"] for r in got}
    assert {r["idx"]: r["role_score"] for r in got}[4] == 0.78
    assert articles.commercial_roles(p.where("false")).count() == 0


@pytest.mark.parametrize(
    ("kind", "text", "y", "score", "starts"),
    [
        ("title", "A long title of something", 0.1, 0.82, True),
        ("title", "A long title of something", None, 0.56, False),
        ("title", "A long title of something", 0.4, 0.64, True),
        ("sub_title", "Quantum gravity measured again", 0.1, 0.86, True),
        ("title", "Measured gravity: another quantum surprise", 0.9, 0.36, False),
        ("title", "NEW RESULTS", 0.1, 0.52, False),
        ("sub_title", "Appointments and Awards", 0.1, 0.84, True),
        ("title", "Editorial", 0.1, 0.0, False),
        ("title", "Volume 12", 0.1, 0.0, False),
        ("title", None, 0.1, 0.0, False),
    ],
)
def test_title_scores(spark, kind, text, y, score, starts):
    toc = spark.createDataFrame([(1, "quantum gravity measured again other words")], "doc_id long, toc string")
    r = articles.title_scores(spark.createDataFrame([(1, kind, text, y)], "doc_id long, kind string, text string, y double"), toc).first()
    assert (r["score"], r["starts"]) == (score, starts)


def test_structural_roles(spark):
    body = "word " * 40
    rows = [("Volume 5 Number 2", "RUNNING_HEADER"), ("References", "FURTHER_READING"), ("By A Writer", "BYLINE"), ("Figure 2 shows", "CAPTION"), ("FIELD WORK", "DEPARTMENT_LABEL"), ("Policy", "DEPARTMENT_LABEL"), ("The Great Title", "TITLE"), (body, "BODY"), ("Please register now at once.", "ADVERTISEMENT"), (None, "BODY"), ("Another Good Title", "BODY")]
    n = spark.createDataFrame([(1, 1, i, x, False, False) for i, (x, _) in enumerate(rows)] + [(1, 2, 50, body, False, False), (1, 2, 51, "x", True, False), (1, 2, 52, "y", False, True)], "doc_id long, page long, idx long, text string, visual boolean, explicit boolean")
    got = [r["role"] for r in articles.structural_roles(n).orderBy("idx").collect()]
    assert got == [w for _, w in rows] + ["BODY", "CAPTION", "TITLE"]


def test_boundary_zones(spark):
    n = spark.createDataFrame([(1, 1 + i // 5, i, "In this\n issue" if i == 12 else "t") for i in range(15)], "doc_id long, page long, idx long, text string")
    t = spark.createDataFrame(
        [(1, 1, 1, "a", "LIKELY_STARTS_NEW_ITEM", 0.5), (1, 1, 1, "b", None, None), (1, 4, 1, "c", "SECTION_OR_RUNNING_LABEL", 0.9), (1, 6, 2, "d", "UNCERTAIN", 0.1), (1, 11, 3, "e", "UNCERTAIN", 0.1)],
        "doc_id long, idx long, page long, title string, classification string, margin double",
    )
    got = sorted(tuple(r) for r in articles.boundary_zones(n, t).collect())
    assert got == [(1, 1, 0, 4, 5, 2, True, 0.5), (1, 6, 5, 9, 5, 1, False, 0.1)]
