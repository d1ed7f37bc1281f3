from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowage.llm import mixing

DDL = "doc_id bigint, text string, source string, copy string, __x int"


def _docs(frame):
    rows = [(i, "word " * (1 + i % 7), "hot" if i % 3 else f"s{i % 4}", "old", i) for i in range(900)]
    rows += [(901, None, None, None, None), (902, "", "empty", "a", 1), (None, "no id", "s1", "a", 1),
             (903, "x" * 200_000, None, "a", 1), (904, "twice", "s1", "a", 1), (904, "twice", "s1", "a", 1)]
    return frame(rows, DDL)


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_copies_follow_rates_and_repeat(frame):
    docs = _docs(frame)
    weights = {"hot": 0.5, "s1": 0.25, "": 0.25}
    out = mixing.mix_sources(docs, weights=weights, budget=1_000_000)
    assert out.columns == ["doc_id", "text", "source", "__x", "copy"]
    got = _rows(out)
    assert got == _rows(mixing.mix_sources(docs, weights=weights, budget=1_000_000))
    assert got != _rows(mixing.mix_sources(docs, weights=weights, budget=1_000_000, seed=5))
    rates = {(r["source_key"], r["unnamed"]): r["rate"]
             for r in mixing.source_rates(docs, weights, 1_000_000).collect()}
    assert rates["s0", False] == 0 and rates["empty", False] == 1.0
    found = Counter(k[2] for k in got.elements())
    assert found["s0"] == found["s2"] == 0
    n = Counter("hot" if i % 3 else f"s{i % 4}" for i in range(900))
    mean = rates["hot", False] * n["hot"]
    assert abs(found["hot"] - mean) < 6 * mean**0.5
    # Copies of a document are numbered from 1, and rows of one id draw alike.
    per_doc = {}
    for k in got:
        per_doc.setdefault(k[0], set()).add(k[-1])
    assert all(c == set(range(1, len(c) + 1)) for c in per_doc.values())
    assert all(v % 2 == 0 for k, v in got.items() if k[0] == 904)


def test_many_sources_take_the_other_way(frame):
    docs = _docs(frame)
    one, other = mixing.mix_sources(docs), mixing.mix_sources(docs, max_broadcast_sources=0)
    assert _rows(one) == _rows(other)


@pytest.mark.parametrize("mean", [0.001, 0.7, 5.0, 31.9, 32.0])
def test_distribution(spark, mean):
    import math

    cdf = spark.range(1).select(mixing._distribution(F.lit(mean)).alias("c")).first()["c"]
    p = total = math.exp(-mean)
    for k, value in enumerate(cdf):
        assert value == pytest.approx(total, abs=1e-12)
        p *= mean / (k + 1)
        total += p
    assert cdf[-1] > 1 - 2.0**-40


def test_large_rates_are_sums_of_draws(frame):
    docs = frame([(i, "ab", "a") for i in range(200)], "doc_id bigint, text string, source string")
    n = mixing.mix_sources(docs, budget=400 * 100.0).count()
    assert abs(n - 20_000) < 6 * 20_000**0.5


def test_empty_table(frame):
    assert mixing.mix_sources(frame([], DDL)).collect() == []
