import random

import numpy as np
import pytest

from stowage.llm import maxproduct

DDL = "vec_id bigint, vector array<bigint>, score int, qnum string"


def brute(rows, queries, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v})
    out = {}
    for q, v in good:
        if q in queries:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i)
                           for i, w in good if i != q and len(w) == len(v))
            out.setdefault(q, []).append([(i, -s) for s, i in found[:k]])
    return {q: sorted(x) for q, x in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize(("kind", "scale"), [("clusters", 20), ("lengths", 20), ("small", 1), ("large", 10**7)])
def test_like_all_products(frame, kind, scale):
    rng = np.random.default_rng(len(kind))
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 16))
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, 1500)[:, None]
    rows = [(i * 3 - 900, np.floor(v * scale).astype(int).tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[5][1]) for i in range(300)]
    queries = {r[0] for r in rows[::20]}
    vectors = frame([(*r, 1, "x") for r in rows], DDL)
    asked = vectors.where(vectors.vec_id.isin(sorted(queries)))
    out = maxproduct.top_products(vectors, asked, 7, block_rows=128, group_queries=40)
    assert found(out) == {q: x[0] for q, x in brute(rows, queries, 7).items()}


def test_coordinates_prune_and_agree_with_lengths():
    rng = np.random.default_rng(4)
    centers = np.eye(12)[rng.integers(0, 12, 900)]
    x = np.floor(500 * (centers + 0.05 * rng.normal(size=(900, 12)))).astype(np.int64)
    block = maxproduct._Block(x, [np.array([i]) for i in range(900)])
    beat = np.sort(x[:50] @ x.T, axis=1)[:, -10].astype(float)
    unit = x[:50] / np.linalg.norm(x[:50], axis=1)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, : maxproduct.FOCUS]
    assert block.cutoff(unit, focus) < 0.9
    q, node, score = maxproduct._search(block, x[:50], beat, 9)
    products = x[:50] @ block.vectors.T
    assert sorted(zip(q, node)) == sorted(zip(*np.nonzero(products >= beat[:, None])))
    assert (score == products[q, node]).all()


def test_odd_rows(frame):
    rows = [(1, [1, 2]), (2, [2, 1]), (2, [2, 1]), (3, None), (4, [1, None]), (None, [9, 9]), (5, []), (6, []),
            (7, [0, 0]), (8, [1, 1, 1]), (9, [-1, -2]), (10, [1, 2]), (10, [5, 5])]
    vectors = frame([(*r, None, None) for r in rows], DDL)
    got = {}
    for r in maxproduct.top_products(vectors, vectors, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, set(range(20)), 20)
    assert {q for q, x in want.items() if any(x)} == set(got)
    for q, lists in want.items():
        ranked = [(at + 1, *hit) for one in lists for at, hit in enumerate(one)]
        assert sorted(got.get(q, [])) == sorted(ranked)
    none = vectors.where("vec_id > 99")
    assert maxproduct.top_products(none, vectors, 5).count() == 0
    assert maxproduct.top_products(vectors, none, 5).count() == 0


def test_quantized(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01, 1.999]), (1, None), (2, [1.0, None]), (3, [nan]), (4, [-inf]), (5, []), (6, [-0.0])]
    df = frame(rows, "vec_id bigint, embedding array<float>")
    out = {r["vec_id"]: r["v"] for r in df.select("vec_id", maxproduct.quantized(df.embedding).alias("v")).collect()}
    assert out == {0: [32, -1, 127], 1: None, 2: None, 3: None, 4: None, 5: [], 6: [0]}


def test_ties_go_to_smaller_ids(frame):
    ids = random.Random(1).sample(range(1000), 400)
    vectors = frame([(i, [3, 4], 0, "") for i in ids], DDL)
    out = found(maxproduct.top_products(vectors, vectors.where("vec_id % 20 = 0"), 5, block_rows=50))
    for q, hits in out.items():
        assert hits == [(i, 25) for i in sorted(set(ids) - {q})[:5]]
