import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("featsift-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="featsift-tests-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def f6(spark):
    """FIXTURES.md F6: 6 rows, labels 1,1,1,0,0,0, six features."""
    from featsift.operators.matrix import WideMatrix

    cols = {
        0: [1, 2, 1, 0, 1, 0],
        1: [5, 5, 5, 5, 5, 5],
        2: [0, 0, 0, 0, 0, 0],
        3: [1, 1, 1, 0, 0, 0],
        4: [1, 2, 1, 0, 1, 0],
        5: [-1, 0, 2, 0, 0, 1],
    }
    labels = [1, 1, 1, 0, 0, 0]
    cells = [(r, f, float(v)) for f, vals in cols.items() for r, v in enumerate(vals) if v != 0]
    entries = spark.createDataFrame(cells, "row_id long, feature_id long, value double")
    rows = spark.createDataFrame(list(enumerate(labels)), "row_id long, label int")
    columns = spark.createDataFrame([(f,) for f in cols], "feature_id long")
    return WideMatrix(entries=entries, rows=rows, columns=columns, label_col="label")
