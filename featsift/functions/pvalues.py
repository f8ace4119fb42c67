"""p-value columns: Arrow-batched pandas UDFs (no Spark SQL function exists)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from featsift.functions.special import chi2_sf, f_sf


def f_pvalue(f: Column, d1: int, d2: int) -> Column:
    """Survival of F(d1, d2) at ``f`` (null stays null)."""

    @F.pandas_udf(DoubleType())
    def _sf(s: pd.Series) -> pd.Series:
        return pd.Series(f_sf(s.astype("float64").to_numpy(), float(d1), float(d2)), index=s.index)

    return _sf(f)


def chi2_pvalue(x: Column, dof: int) -> Column:
    """Survival of chi-square(dof) at ``x`` (null stays null)."""

    @F.pandas_udf(DoubleType())
    def _sf(s: pd.Series) -> pd.Series:
        return pd.Series(chi2_sf(s.astype("float64").to_numpy(), float(dof)), index=s.index)

    return _sf(x)
