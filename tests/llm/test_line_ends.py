"""Closing quotes and brackets after a line's terminal mark, however many."""

from vitaeflow.llm import quality


def test_many_closers_after_a_mark(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words + "." + ")" * 40), (2, words + ")" * 40), (3, words + '.”»"'), (4, words + "?' x")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
