"""One row stays for each component, whatever the ids."""

from featsift.llm import simhash
from tests.llm import brute
from tests.llm.conftest import SCHEMA


def test_each_component_of_the_repeated_rows(repeated):
    got = simhash.keep_one(repeated).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [
        (0, ""), (0, "other words"), (1, "some words that come again and again in this little text of ours")
    ]


def test_ids_shared_by_components(spark):
    """Null ids and one id over many different texts, some of them copies."""
    texts = [" ".join(brute.sha(f"{i} {k}") for k in range(20)) for i in range(40)]
    rows = [(None if i % 2 else 7, t, "en", "a", i) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", 100), (3, texts[1], "en", "a", 101)] + [(3, texts[3], "en", "a", 102)] * 3
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = dict(enumerate(brute.fingerprint(t) for t in texts))
    assert len(got) == len(set(brute.near_groups(prints).values())) == 40
    kept = {r.text: r.doc_id for r in got}
    assert kept == {t: 3 if i in (1, 3) else None if i % 2 else 7 for i, t in enumerate(texts)}
