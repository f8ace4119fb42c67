"""Paragraphs of one to four words group with their copies."""

from featsift.llm import paragraphs


def test_short_lines(spark):
    long = "这是一个没有空格的很长的段落" * 30
    rows = [(1, f"Read more\n{long}\n\n one two  three four"), (2, f"x\nread  MORE \n{long}"), (3, "one two three\nONE two three four\n \n"), (4, "read more now")]
    got = sorted(tuple(r) for r in paragraphs.near_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 1, 2, False), (1, 1, 1, 2, False), (1, 3, 1, 2, False), (2, 1, 1, 2, True), (2, 2, 1, 2, True), (3, 1, 1, 2, True)]
