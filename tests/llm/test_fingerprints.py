import hashlib
import math
import random
from collections import Counter

import numpy as np

from stowage.llm import fingerprints as fp

NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _prose(seed, n=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_entropies():
    data = (_prose(1) + "a" * 80 + "\x00\xff" * 30).encode("latin-1")
    got = fp._entropies(np.frombuffer(data, np.uint8))
    for i in range(0, len(got), 13):
        counts = Counter(data[i : i + fp.WINDOW]).values()
        h = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in counts) / math.log2(fp.WINDOW)
        assert abs(h * 1000 - got[i]) < 2


def test_alone_as_in_a_batch():
    texts = [_prose(i, n).encode() for i, n in enumerate([1, 3, 20, 400, 3000, 50])] + [b"", b"x", b"ab" * 5000]
    together = [fp.as_text(p) for p in fp.fingerprints(texts)]
    assert together == [fp.as_text(fp.fingerprints([t])[0]) for t in texts]
    for text in together:
        assert fp.as_text(fp.from_text(text)) == text


def test_likeness():
    base = _prose(1, 800)
    same, cut, other = base, base[: len(base) * 2 // 3] + _prose(2, 800)[: len(base) // 3], _prose(3, 800)
    a, b, c, d, empty = fp.fingerprints([x.encode() for x in (base, same, cut, other, "")])
    assert fp.likeness(a, b) == 1.0
    assert 0.4 < fp.likeness(a, c) < 0.95
    assert fp.likeness(a, d) < 0.1
    assert fp.likeness(empty, empty) == 1.0 and fp.likeness(a, empty) == 0.0


def test_next_documents_over_parts(frame):
    rng = random.Random(5)
    rows = [(rng.randint(-10**12, 10**12), _prose(i, rng.randint(0, 60))) for i in range(150)]
    rows += [(5, None), (6, ""), (7, "é👩" * 50), (8, _prose(1, 20_000)), (9, _prose(2)), (10, _prose(2))]
    docs = frame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, part string, extra int")
    out = fp.compare_with_next(docs, parts=7)
    assert out.columns == NAMES
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    order = sorted(rows, reverse=True)
    for (i, text), (j, following) in zip(order, order[1:] + order[:1], strict=True):
        changed = fp.edited(text or "", following or "")
        row = got[i]
        assert row["n_chars"] == len(text or "")
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["edited_fingerprint"] == fp.as_text(fp.fingerprints([changed.encode()])[0])
        assert row["near_next"] == fp.likeness(fp.from_text(row["fingerprint"]), fp.from_text(got[j]["fingerprint"]))
    assert got[9]["fingerprint"] == got[10]["fingerprint"] and got[10]["near_next"] == 1.0


def test_one_row_no_row_and_missing_ids(frame):
    ddl = "doc_id bigint, text string"
    one = fp.compare_with_next(frame([(3, "abcdef")], ddl)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fp.compare_with_next(frame([], ddl)).collect() == []
    rows = [(None, "n" * 9), (1, "a" * 9), (2, "b" * 9), (2, "b" * 9)]
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in fp.compare_with_next(frame(rows, ddl)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == Counter([(2, sha("b" * 9)), (2, sha("b" * 6 + "aaa")), (1, sha("a" * 6 + "nnn")),
                           (None, sha("n" * 6 + "bbb"))])


def test_entropy_depends_on_the_window_only():
    """Before, the first window's rounding moved all windows of a batch, whole numbers by one."""
    body = ("0123456789abcdef" * 4 + "aabbccdd" * 8 + _prose(4, 200)).encode()
    alone = fp._entropies(np.frombuffer(body, np.uint8))
    assert alone[0] == 800 and alone[64] == 400
    starts = ["abcdefghijklmnopqrstuvwxyz012345", "a" * 32, "aaabbbcccdddeeefffggghhhiiijjjkk"]
    for start in starts + [_prose(i, 12)[:32] for i in range(30)]:
        data = np.frombuffer(start.encode() + body, np.uint8)
        assert (fp._entropies(data)[32:] == alone).all(), start


def test_long_repetitive_texts():
    """Before, all of these had no feature and so were like each other and like an empty text."""
    raw = ["spam " * 200, "ham eggs" * 100, "ab" * 300, "=" * 500, "-" * 500, "0123456789abcdef" * 40, "a" * 128, ""]
    prints = fp.fingerprints([t.encode() for t in raw])
    for i, a in enumerate(prints):
        assert (a[0] > 0) == (raw[i] != "")
        for j, b in enumerate(prints):
            assert fp.likeness(a, b) == (1.0 if i == j else 0.0), (raw[i][:9], raw[j][:9])
    for text in raw[:-1]:  # two thirds are as before
        own, new = fp.fingerprints([text.encode(), fp.edited(text, _prose(1)).encode()])
        assert fp.likeness(own, new) > 0.9
    texts = [t.encode() for t in raw] + [(_prose(1) + "=" * 400 + _prose(2)).encode()]
    alone = [fp.as_text(fp.fingerprints([t])[0]) for t in texts]
    assert alone == [fp.as_text(p) for p in fp.fingerprints(texts)]
    assert alone == [fp.as_text(p) for p in fp.fingerprints(texts[::-1])][::-1]
