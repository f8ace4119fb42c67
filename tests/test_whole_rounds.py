"""The chains ask for the reference's rounds and patience."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featsift.operators import models as MD
from featsift.plans import catalog
from featsift.plans import pipelines as PL
from featsift.sources import tables as T
from tests.conftest import SF_SMALL


class _Asked(Exception):
    pass


@pytest.mark.parametrize("name, rounds, patience", [
    ("fused_score", 2000, 80), ("onehot_fused_score", 300, 20), ("three_way_report", 2000, 80), ("gbt_score", 2000, None),
    ("onehot_aligned_score", 100, None), ("reduced_gbt_submission", 300, None),
])
def test_rounds_of_the_reference(spark, monkeypatch, name, rounds, patience):
    def reduced(spark, sf_dir, k_tokens=None, k_pca=250, seed=42, fit_rows=None):
        parts = [T.token_matrix(spark, sf_dir, part, with_columns=False).rows for part in ("labelled", "unlabelled")]
        vec = array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features")
        return *(p.select("*", vec) for p in parts), 2

    def watched(self, vectors, valid=None, patience=None):
        raise _Asked(self.params.rounds, patience, vectors.count() > 0)

    monkeypatch.setattr(PL, "reduced_tokens", reduced)
    monkeypatch.setattr(MD.SparseBoosting, "watched", watched)
    with pytest.raises(_Asked) as asked:
        catalog.QUERIES[name](spark, SF_SMALL)
    assert asked.value.args == (rounds, patience, True)
