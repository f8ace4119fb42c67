"""Every document is judged, however small its language or source."""

import random

import pytest

from featsift.llm import quality_rules
from tests.llm.conftest import SCHEMA

WORDS = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when".split()


def _texts():
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(WORDS) for _ in range(150)).capitalize() + "."
    junk = lambda: " ".join("#$%&*|<>" * 2 + rng.choice(WORDS) + str(rng.random()) for _ in range(150))
    return plain, junk


def _verdicts(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, source, len(t)) for i, (t, lang, source, _) in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert all(r.distance2 is not None for r in got.values())
    clean = {r.doc_id for r in quality_rules.keep_clean(docs).collect()}
    assert clean == {i for i, r in got.items() if r.kept} == {i for i, row in enumerate(rows) if row[3]}


@pytest.mark.parametrize("lang, source", [("en", "rare"), ("xx", "a"), (None, None)])
def test_junk_in_a_small_group(spark, lang, source):
    plain, junk = _texts()
    rows = [(plain(), "en", "a", True) for _ in range(300)]
    rows += [(plain(), lang, source, True) for _ in range(20)] + [(junk(), lang, source, False) for _ in range(20)]
    _verdicts(spark, rows)


def test_many_pools_meet_their_rows_by_salt(spark, monkeypatch):
    plain, junk = _texts()
    rows = [(plain(), "en", "a", True) for _ in range(300)] + [(junk(), "en", "a", False) for _ in range(10)]
    rows += [(plain(), None, None, True) for _ in range(20)] + [(junk(), None, "b", False) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, lang, source, len(t)) for i, (t, lang, source, _) in enumerate(rows)], SCHEMA)
    sent = {r.doc_id: (r.kept, round(r.distance2, 6)) for r in quality_rules.judged(docs).collect()}
    monkeypatch.setattr(quality_rules, "MAX_SENT", 0)
    monkeypatch.setattr(quality_rules, "SALTS", 5)
    dealt = {r.doc_id: (r.kept, round(r.distance2, 6)) for r in quality_rules.judged(docs).collect()}
    assert sent == dealt and {d for d, (kept, _) in sent.items() if kept} == {i for i, row in enumerate(rows) if row[3]}


def test_a_small_table(spark):
    plain, junk = _texts()
    _verdicts(spark, [(plain(), "en", "a", True) for _ in range(60)] + [(junk(), "en", "a", False) for _ in range(5)])


def test_only_ordinary_rows_count(spark):
    rows = [("en", "a", False)] * 300 + [("en", "b", True)] * 250 + [("en", "b", False)] * 5 + [("-", "c", False)] * 3 + [(None, "c", False)] * 3
    pool = quality_rules.pools(spark.createDataFrame(rows, "lang string, source string, bad boolean"))
    g = {(r.lang, r.source): r.g for r in pool.collect()}
    assert g == {("en", "a"): "2:en/1:a", ("en", "b"): "lang 2:en", ("-", "c"): "all", (None, "c"): "all"}
    fed = {(r.lang, r.source, r.g) for r in quality_rules.feeds(pool).collect()}
    assert fed == {(*k, "all") for k in g} | {("en", "a", "2:en/1:a"), ("en", "a", "lang 2:en"), ("en", "b", "lang 2:en")}
