"""The filters keep columns of any name."""

import pytest

from folioscope.llm import decontamination, jaccard_join, line_dedup, quality

NAMES = ["a.b", "with blank", "back`tick", "x.`y`.z"]


@pytest.mark.parametrize("name", ["quality", "boilerplate", "passages", "near copies", "benchmark"])
def test_names_with_dots_blanks_and_back_ticks(spark, name):
    text = "some words that stand here and there and again at the end of a line"
    rows = [(k, f"{text} {k}", "en", "a", 3, *range(k, k + 4)) for k in range(6)] + [(6, None, None, None, None, None, None, None, None)]
    quoted = ", ".join("`" + n.replace("`", "``") + "` long" for n in NAMES)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {quoted}")
    out = {
        "quality": lambda: quality.selected(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int"), 0),
        "boilerplate": lambda: line_dedup.without_boilerplate(docs),
        "passages": lambda: line_dedup.without_passages(docs),
        "near copies": lambda: jaccard_join.one_of_each(docs),
        "benchmark": lambda: decontamination.decontaminate(docs, spark.createDataFrame([("i", "nothing of the kind")], "item_id string, text string")),
    }[name]()
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept and all(r["a.b"] == r["doc_id"] and r["x.`y`.z"] == r["doc_id"] + 3 for r in kept if r["text"] is not None)
