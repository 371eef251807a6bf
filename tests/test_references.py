"""What references are for: the cases a reader of such graphs would try first."""

import pytest

from leafweave.operators import references

SCHEMA = "doc_id long, node_id string, document_order long, text string, evidence_type string, section_id string, section_path array<string>, content_item_id string, possible_continuation boolean"


def node(i, order, text, kind="text", path=None, item=None, cont=False):
    return (1, i, order, text, kind, "s1", path, item, cont)


CASES = {
    "a declaration is no reference to itself": ([node("f", 2, "FIG. 1. A result.", "caption")], set()),
    "a cue means its declared target": ([node("x", 1, "A summary."), node("s", 2, "The signal is shown in Fig. 1."), node("f", 3, "FIG. 1. Signal data.", "caption")], {("s", "f")}),
    "where follows its formula": ([node("f", 1, r"\[x=y+1.\]", "formula"), node("e", 2, "where x is the observed value.")], {("e", "f")}),
    "anaphora reach across a figure": ([node("root", 1, "The techniques include a mirror that optimizes", cont=True), node("f", 2, "FIG. 1. Diagram.", "figure"), node("c", 3, "the signal extraction and readout."), node("a", 4, "These interferometry techniques reduce noise.")], {("a", "c"), ("a", "root")}),
    "numbered equations": ([node("s", 1, "The positional encoding follows Equation 8)."), node("e", 2, r"\[x=y. \quad (8) \]", "formula")], {("s", "e")}),
    "section labels keep their depth": ([node("t", 1, "Architecture details.", path=["3.2 Model architecture"]), node("s", 2, "See Section 3.2 for details.", path=["4 Experiments"])], {("s", "t")}),
    "repeated labels by content item": ([node("fa", 1, "FIG. 1. A.", "caption", item="a"), node("s", 2, "See Figure 1.", item="a"), node("fb", 3, "FIG. 1. B.", "caption", item="b")], {("s", "fa")}),
    "words are no Roman numerals": ([node("s", 1, "The cross-section compared well, and this towering figure in physics helped.")], set()),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_reference_edges(spark, name):
    rows, want = CASES[name]
    n = spark.createDataFrame(rows, SCHEMA)
    assert {(r["source"], r["target"]) for r in references.reference_edges(n).collect()} == want
    if name.startswith("words"):
        assert references.mentions(n).count() == 0


def test_unresolved(spark):
    n = spark.createDataFrame([node("s", 1, "See Table 4 and Fig. 2."), node("a", 2, "FIG. 2. A", "caption"), node("b", 3, "FIG. 2. B", "caption")], SCHEMA)
    assert {(r["cue"], r["reason"]) for r in references.grounded(n).where("target is null").collect()} == {("Table 4", "target_not_found"), ("Fig. 2", "target_not_unique")}
