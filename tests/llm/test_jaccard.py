import random
import re

import pyarrow as pa
import pytest

from stowage.llm import jaccard
from stowage.llm.components import connected_components
from stowage.llm.tables import Scratch


def brute(rows, size, percent):
    """Set sizes and components by comparing all pairs."""
    sets = {}
    for i, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[i] = ({tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
                   if len(words) >= size else {tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=260, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        if i % 3 == 0:  # near copies of one text, some by few words and some by many
            text = [w if rng.random() > (i % 5) / 60 else rng.choice(words) for w in base]
        elif i % 3 == 1:  # a passage that many share, with little or much around it
            text = passage + [rng.choice(words) for _ in range(rng.choice([1, 5, 40]))]
        else:
            text = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        rows.append((i * 7, " ".join(text).upper() if i % 2 else "\t".join(text)))
    return rows + [(5000 + i, rows[0][1]) for i in range(30)] + [
        (9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "É é"), (9006, "é é"),
        (9007, "word " * 30_000), (9008, "word " * 7), (9009, "l" * 100_000)]


@pytest.mark.parametrize(("size", "percent", "bits"), [(4, 85, 23), (5, 80, 23), (2, 60, 12), (1, 50, 12)])
def test_like_all_pairs(frame, size, percent, bits):
    rows = corpus()
    docs = frame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, gid string")
    out = jaccard.linked_documents(docs, size, percent, max_sketch_bits=bits)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == brute(rows, size, percent)


def test_full_counters_change_nothing(frame, monkeypatch):
    """Lists of frequent shingles are dealt out and still linked."""
    monkeypatch.setattr(jaccard, "FULL", 3)
    rows = corpus(120, 8)
    docs = frame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard.linked_documents(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_rows_of_one_id_and_without_id(frame):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    docs = frame([(1, a), (2, a), (2, b), (3, b), (None, a), (None, "alone here now then")],
                 "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.linked_documents(docs, 4, 85).collect()),
                 key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (3, 2), (None, 1), (None, None)], key=str)


def test_empty_table(frame):
    assert jaccard.linked_documents(frame([], "doc_id bigint, text string")).collect() == []


def test_components_of_chains_and_stars(spark, frame):
    chain = [(i, i + 1) for i in range(200)]
    links = chain + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (3, 150), (2000, 1999)]
    random.Random(2).shuffle(links)
    out = connected_components(frame(links, "a bigint, b bigint"), Scratch(spark, "c"), "t").collect()
    got = {r["node"]: r["component"] for r in out}
    assert got == ({i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {1999: 1999, 2000: 1999})


def test_rounds_end_where_links_are_stars(spark, frame, monkeypatch):
    """Each round is work for the driver: none is there to confirm the one before."""
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    stars = [(i, 100 * (i // 100)) for i in range(300)] + [(205, 200), (None, 4), (4, None)]
    out = connected_components(frame(stars, "a bigint, b bigint"), Scratch(spark, "c"), "t").collect()
    assert sorted(map(tuple, out)) == [(i, 100 * (i // 100)) for i in range(300)]
    assert written == ["t-0"]
    none = connected_components(frame([(3, 3)], "a bigint, b bigint"), Scratch(spark, "c"), "n").collect()
    assert none == [] and written == ["t-0", "n-0"]


def test_later_links_meet_components_only(frame, monkeypatch):
    """Of links found before, one for each node is gone through again, not all."""
    given, connect = [], connected_components

    def seen(links, scratch, name):
        if name == "first":  # leaves links to be found later
            links = links.where("a % 3 > 0 and b % 3 > 0").cache()
        given.append([tuple(r) for r in links.collect()])
        return connect(links, scratch, name)

    monkeypatch.setattr(jaccard, "connected_components", seen)
    rows = corpus(150)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard.linked_documents(frame(rows, "doc_id bigint, text string"), 2, 60).collect()}
    assert got == brute(rows, 2, 60)
    nodes = set(sum(given[0], ()))
    assert len(given) > 1 and len(given[0]) > len(nodes)
    for links in given[1:]:
        assert sum(nodes.issuperset(pair) for pair in links) < len(given[0])


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_several_components_with_any_ids(frame, seed):
    """Sets with one prefix and size that lie in several components, under ids of either sign."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    ids = rng.sample(range(-50, 51), 60)
    rows = []
    for i in ids:
        own = [f"x{rng.randrange(9)}" for _ in range(rng.choice([4, 5, 6]))]
        rows.append((i, " ".join(["rare", *common[: rng.choice([20, 26, 30])], *own])))
    docs = frame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, gid string")
    for size, percent in ((1, 80), (2, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
               for r in jaccard.linked_documents(docs, size, percent).collect()}
        assert got == brute(rows, size, percent)


def test_one_id_with_different_texts(frame):
    a, near, other = "a b c d e f g h i j k l", "a b c d e f g h i j k z", "p q r s t u v w"
    rows = [(3, near), (5, a), (5, other), (5, other), (9, other + " x"), (None, a), (None, "n n n"), (8, "p q r s t u v w x y")]
    out = jaccard.linked_documents(frame(rows, "doc_id bigint, text string"), 1, 70).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in out)
    assert got == [(0, 1, None), (0, 12, 3), (3, 12, 3), (5, 8, 5), (5, 8, 5), (5, 12, 3), (8, 10, 5), (9, 9, 5)]


def test_texts_are_hashed_together():
    """All texts of a batch at once: one number for each shingle, the same wherever the text stands."""
    texts = [text for _, text in corpus()] + [
        "\x0b\x0c a\x0bB\x0cc\r\nD  ", "a\x1cb\x85c\xa0d e f g", "\x00 x\x00y", "a a\x00", "ÀÉ ǅ Aİ", None, "\t",
        " ".join(k * n for n in range(1, 90) for k in "ab"), "l" * 99_999 + "m"]
    for size in (1, 2, 4):
        names = {}
        for some in (pa.array(texts), pa.array(texts).slice(4, 90), pa.array([None, "", " "], pa.string()),
                     pa.array([], pa.string())):
            values, counts = jaccard.shingles(some, size)
            want = []
            for text in some.to_pylist():
                words = (text or "").encode().lower().split()
                want.append([tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else [])
            assert counts.tolist() == [len(w) for w in want]
            for number, shingle in zip(values.tolist(), sum(want, []), strict=True):
                assert names.setdefault(shingle, number) == number
            sets = jaccard.shingle_sets(some, size)
            assert [sorted({names[x] for x in w}) for w in want] == [x.tolist() for x in sets]
        assert len(set(names.values())) == len(names)
    parts = list(jaccard._text_parts(pa.array(texts)))
    assert pa.concat_arrays(parts).to_pylist() == texts
