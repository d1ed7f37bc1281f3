"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded; a gated attention, whose
weights are learned from labels of whole documents only, says how much each
passage counts; the weighted mean of the encodings is scored. So a document
with one bad part can be told from a good one without labels of parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stowage.llm.tables import free_name

#: Labelled documents that a model is fitted on, at most.
MAX_TRAINING_DOCS = 6_000
#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 320
#: Bytes turned into features at once; each takes some 70 bytes of memory meanwhile.
BYTES_PER_BATCH = 1_000_000
HIDDEN, GATE = 16, 8
EPOCHS, BAGS_PER_STEP, RATE, DECAY = 30, 128, 0.01, 1e-4

_KINDS = 8
#: Pairs of byte kinds, then: repeated words, words seen two before, mean word length, fill.
FEATURES = _KINDS * _KINDS + 4


def _kind_table() -> np.ndarray:
    """The kind of each byte: letters, digits, spaces, stops, marks, and parts of other letters."""
    kinds = np.full(256, 6, np.uint8)
    kinds[ord("a") : ord("z") + 1] = 0
    kinds[ord("A") : ord("Z") + 1] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[[9, 11, 12, 32]] = 3
    kinds[[10, 13]] = 4
    kinds[[ord(c) for c in ".,;:'?-()\""]] = 5
    kinds[128:] = 7
    return kinds


_KIND = _kind_table()
_MIX = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.int64)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has (one for an empty text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros((int(counts.sum()), FEATURES), np.float32)
    if not len(data):
        return out, counts
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(start, sizes)
    bag = np.repeat(np.cumsum(counts) - counts, sizes) + place // PASSAGE
    kind = _KIND[data].astype(np.int64)
    pair = kind[:-1] * _KINDS + kind[1:]
    inside = bag[:-1] == bag[1:]
    n = len(out)
    width = _KINDS * _KINDS
    found = np.bincount(bag[:-1][inside] * width + pair[inside], minlength=n * width)
    length = np.bincount(bag, minlength=n).astype(np.float32)
    out[:, :width] = np.sqrt(found.reshape(n, width) / np.maximum(length, 1)[:, None])
    # Words as sums of random numbers of their bytes: equal words have equal sums.
    blank = (kind == 3) | (kind == 4)
    opens = ~blank
    opens[1:] &= blank[:-1] | (place[1:] == 0)
    first = np.flatnonzero(opens)
    home = bag[first]
    total = np.maximum(np.bincount(home, minlength=n), 1)
    if len(first):
        word = np.add.reduceat(np.where(blank, 0, _MIX[data]), first)
        for feature, back in ((width, 1), (width + 1, 2)):
            same = (word[back:] == word[:-back]) & (home[back:] == home[:-back])
            out[:, feature] = np.bincount(home[back:][same], minlength=n) / total
    out[:, width + 2] = np.log1p(length / total) / 3
    out[:, width + 3] = length / PASSAGE
    return out, counts


@dataclass
class QualityModel:
    """Parameters by name; ``None`` for a model that only knows the share of good labels."""

    parameters: dict[str, np.ndarray] | None
    base: float

    def score(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.parameters is None:
            return np.full(len(counts), self.base)
        return _forward(self.parameters, features, counts)[0]


def _forward(p: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray):
    """Scores of bags; also what the gradient needs."""
    x = (x - p["mean"]) / p["scale"]
    h = np.tanh(x @ p["encode"] + p["encode_b"])
    v = np.tanh(h @ p["value"])
    u = 1 / (1 + np.exp(-(h @ p["gate"])))
    raw = (v * u) @ p["attend"]
    first = np.cumsum(counts) - counts
    raw = raw - np.repeat(np.maximum.reduceat(raw, first), counts)
    e = np.exp(raw)
    a = e / np.repeat(np.add.reduceat(e, first), counts)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    score = 1 / (1 + np.exp(-(z @ p["out"] + p["out_b"])))
    return score, x, h, v, u, a, z, first


def _gradient(p, x, counts, labels):
    score, x, h, v, u, a, z, first = _forward(p, x, counts)
    d = (score - labels) / len(labels)
    g = {"out": z.T @ d, "out_b": np.array([d.sum()])}
    dz = np.repeat(d[:, None] * p["out"], counts, axis=0)
    da = (dz * h).sum(axis=1)
    draw = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
    g["attend"] = (v * u).T @ draw
    dvu = draw[:, None] * p["attend"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    g["value"], g["gate"] = h.T @ dv, h.T @ du
    dh = (a[:, None] * dz + dv @ p["value"].T + du @ p["gate"].T) * (1 - h * h)
    g["encode"], g["encode_b"] = x.T @ dh, dh.sum(axis=0)
    return g


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Fits by Adam on bags of passages; the order of bags doesn't matter to the caller."""
    base = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 2 or labels.min() == labels.max():
        return QualityModel(None, base)
    rng = np.random.default_rng(3)
    p = {
        "mean": features.mean(axis=0), "scale": features.std(axis=0) + 0.02,
        "encode": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "encode_b": np.zeros(HIDDEN),
        "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "attend": rng.normal(0, GATE**-0.5, GATE),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "out_b": np.array([np.log(base / (1 - base))]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    learned = [k for k in p if k not in ("mean", "scale")]
    m = {k: np.zeros_like(p[k]) for k in learned}
    s = {k: np.zeros_like(p[k]) for k in learned}
    first = np.cumsum(counts) - counts
    step = 0
    epochs = max(EPOCHS, -(-400 * BAGS_PER_STEP // len(labels)))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BAGS_PER_STEP):
            bags = order[at : at + BAGS_PER_STEP]
            rows = np.concatenate([np.arange(first[b], first[b] + counts[b]) for b in bags])
            g = _gradient(p, features[rows], counts[bags], labels[bags])
            step += 1
            for k in learned:
                grad = g[k].astype(np.float32) + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(p, base)


def _batches(texts: list[str | None]):
    """Slices of the texts as bytes, of bounded size; a single text may be larger."""
    start, size, out = 0, 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if out and size + len(data) > BYTES_PER_BATCH:
            yield start, out
            start, size, out = i, 0, []
        out.append(data)
        size += len(data)
    if out:
        yield start, out


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = MAX_TRAINING_DOCS,
) -> QualityModel:
    """Fits on the texts of labelled documents, a sample by a hash of the id of at most ``max_docs``.

    A document labelled twice takes its smallest label; NULL labels and labels
    of unknown documents count for nothing. Labels of one class, or none, give a
    model that scores every text with the share of good labels (0.5 for none).
    """
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg((F.min(label_col) > 0).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_docs)
    )
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(ids), "__id"
    )

    def encode(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = batch.column(1).to_pylist()
            for start, part in _batches(texts):
                features, counts = passages(part)
                ends = np.cumsum(counts)
                rows = [
                    features[e - c : e].astype(np.float16).tobytes()
                    for e, c in zip(ends, counts, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.binary()), pa.array(marks[start : start + len(part)], pa.int32())],
                    names=["features", "label"],
                )

    bags = chosen.select("__text", F.col("__label").cast("int").alias("label")).mapInArrow(
        encode, "features binary, label int"
    ).collect()
    bags.sort(key=lambda r: (bytes(r["features"]), r["label"]))
    each = [
        np.frombuffer(r["features"], np.float16).reshape(-1, FEATURES).astype(np.float32)
        for r in bags
    ]
    features = np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32)
    counts = np.array([len(x) for x in each], np.int64)
    return fit(features, counts, np.array([float(r["label"]) for r in bags], np.float32))


def score_quality(
    docs: DataFrame,
    model: QualityModel,
    text_col: str = "text",
    keep: list[str] | None = None,
    result_col: str = "score",
) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) and the score of each whole text, 0 to 1.

    Defined cases: a NULL text counts as an empty one, which is a bag of one
    empty passage; equal texts have equal scores; an input column with the
    result's name is replaced.
    """
    columns = [
        c for c in (docs.columns if keep is None else keep) if c.lower() != result_col.lower()
    ]
    source = docs.select(*columns, F.col(text_col).alias(free_name("text", columns)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = np.zeros(len(texts))
            for start, part in _batches(texts):
                scores[start : start + len(part)] = model.score(*passages(part))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.clip(scores, 0, 1), pa.float64())],
                names=[*columns, result_col],
            )

    schema = StructType([docs.schema[c] for c in columns]).add(result_col, "double")
    return source.mapInArrow(run, schema)
