"""featsift: feature screening, encoding and tabular modelling on Spark.

A wide sample-by-feature matrix is held as a long sparse DataFrame
``(row_id, feature_id, value)`` (zeros omitted) together with a row spine and a
column spine.  Every statistic is a Spark aggregation over that long form, every
fitted state is a small DataFrame, and every ``transform`` is a join.
"""

__version__ = "0.1.0"
