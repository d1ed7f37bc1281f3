import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stowage.llm import collocations
from stowage.llm.tables import Scratch

DDL = "doc_id bigint, text string, lang string, block int, m string"


def brute(rows, least, longest, covered, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in kept.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= covered * a and len(q) > len(p)
                         and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in kept.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(n=300, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "𝔘x", "don't", " a"]
    fixed = ["new york city hall", "as a matter of fact", "Ab Cd"]
    rows = []
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for p in parts)
        rows.append((text.upper() if i % 7 == 0 else text, rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" . ,", "fr"), ("go " * 2000, "en"), ("l" * 100_000, "de")]


@pytest.mark.parametrize(("least", "longest", "covered", "top"), [(5, 4, 80, 2000), (3, 4, 60, 20), (8, 2, 80, 5)])
def test_like_all_phrases(frame, least, longest, covered, top):
    rows = texts()
    docs = frame([(i, *r, 1, "x") for i, r in enumerate(rows)], DDL).repartition(5)
    out = collocations.collocations(docs, least, longest, covered, top)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
                 for r in out.collect())
    assert got == brute(rows, least, longest, covered, top)


def test_small_blocks_and_colliding_fingerprints(spark, frame, monkeypatch):
    rows = texts(120, 6)
    docs = frame([(i, *r, 1, "x") for i, r in enumerate(rows)], DDL).coalesce(1)
    batches = docs.select("lang", "text").toArrow().to_batches()
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    monkeypatch.setattr(collocations, "TaskContext", type("T", (), {"get": staticmethod(
        lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    blocks = [b for b in collocations._cut(batches)]
    assert len(blocks) > 20
    one = next(b for b in collocations._blocks(max(blocks, key=lambda b: b.column(2)[0].as_py())))[1]
    # All n-grams share one fingerprint: counts still go by words.
    monkeypatch.setattr(one, "prints", lambda at, m: np.zeros(len(at), np.uint64))
    found, counts, _ = one.phrases(2, np.array([one.starts(2)[0]]))
    want = Counter(" ".join(one.words[int(one.codes[i + j])].as_py() for j in range(2)) for i in one.starts(2))
    assert dict(zip(found.to_pylist(), counts.tolist(), strict=True)) == want


def test_fingerprints_tell_places_apart():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    own = collocations._Polynomial(values)
    at = np.arange(3990)
    for m in (1, 2, 3, 4, 9):
        prints = own.spans(at, at + m)
        grams = [values[i : i + m].tobytes() for i in at]
        assert len(set(zip(prints.tolist(), grams, strict=True))) == len(set(prints.tolist())) == len(set(grams))


def test_empty_and_unfrequent(spark, frame):
    for rows in ([], [(1, "a b c", "en", 0, "")], [(1, None, None, 0, "")]):
        docs = frame(rows, DDL)
        assert collocations.collocations(docs).collect() == []
    phrases, totals = collocations.frequent_phrases(frame([(1, "A a, b", "en", 0, "")], DDL), Scratch(spark, "x"), 1, 3)
    assert sorted((r["phrase"], r["a"]) for r in phrases.collect()) == [("a", 2), ("a a", 1), ("b", 1)]
    assert [tuple(r) for r in totals.collect()] == [("en", 3)]
