"""One CSV file cut at every place reads as pandas reads it whole."""

import pandas as pd
import pytest

from featsift.sources.metadata import read_metadata_csv

TEXT = (
    'ID,"a b",c\n1,plain,x\n2,"with, comma","two\nlines"\n3,"a ""quoted"" word",""\n4,"three\n\nlines, ""here""\n",NA\n'
    '\n5,"""",y\n6,,"n/a"\r\n7,"end\r\nof line",é漢\n8,last,"z"'
)


@pytest.fixture
def cut_at(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def set_to(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield set_to
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def test_every_split_point(spark, tmp_path, cut_at):
    path = tmp_path / "m.csv"
    path.write_bytes(TEXT.encode())
    want = pd.read_csv(path, dtype=str).astype(object).where(lambda d: d.notna(), None)
    want = sorted(map(tuple, want.itertuples(index=False)))
    for size in [*range(5, 60, 6), 61, 10_000]:
        cut_at(size)
        got = sorted(tuple(r) for r in read_metadata_csv(spark, str(path)).collect())
        assert got == want, size
    cut_at(16)
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 5


def test_folder_of_files(spark, tmp_path, cut_at):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'ID,t\n{i},"x\n{i}"\n')
    cut_at(7)
    assert sorted(tuple(r) for r in read_metadata_csv(spark, str(tmp_path)).collect()) == [("0", "x\n0"), ("1", "x\n1"), ("2", "x\n2")]
