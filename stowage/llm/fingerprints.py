"""Document fingerprints from improbable features.

Every byte window of a text is ranked by how improbable its entropy is. A
window that is the most improbable one of many neighbourhoods is a feature; its
hash sets bits in a Bloom filter, and full filters are chained. Where a
long stretch has no feature, such as a repeated word or a run of one character,
its repeated windows are features; a text without any feature gives all its
windows. Two
fingerprints are compared filter by filter, by the overlap of bits beyond what
chance gives.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

#: Bytes of a window, windows of a neighbourhood, and neighbourhoods that a feature must win.
WINDOW, NEIGHBOURS, WINS = 32, 32, 8
#: Texts of fewer bytes give all windows of ``SHORT_WINDOW`` bytes, or themselves.
SHORT_TEXT, SHORT_WINDOW = 128, 8
#: Bytes without a feature that give their repeated windows: what ``edited`` leaves of the shortest long text.
STRETCH = SHORT_TEXT * 2 // 3
#: Bits of a filter, features it takes, and bits that a feature sets.
BITS, FEATURES, HASHES = 2048, 160, 5
#: Part of the way from chance to the largest overlap that counts as no likeness.
CUTOFF = 0.3
#: Entropy, of 1000, that windows of plain text have most often, and below which they say nothing.
COMMON, WEAK = 700, 150
_BYTES = 3_000_000
_PIECE = 1 << 17
_SCALE = 1 << 16


def _gains() -> np.ndarray:
    """What one more of c equal bytes adds to the sum of c log2 c, in units of 1 / _SCALE."""
    c = np.arange(WINDOW + 2, dtype=np.float64)
    values = c * np.log2(np.maximum(c, 1)) * _SCALE
    return np.rint(values[1:] - values[:-1]).astype(np.int64)


_GAIN = _gains()
#: The steps' sums: what c equal bytes add.
_SUM = np.concatenate([[0], np.cumsum(_GAIN)])


def _entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, 0 to 1000, of the window that begins at each byte."""
    n = len(data)
    later = np.zeros(n, np.uint8)  # equal bytes among the next ones of a window
    earlier = np.zeros(n, np.uint8)
    for at in range(0, n, _PIECE):
        part = data[at : at + _PIECE + WINDOW - 1]
        size = min(_PIECE, n - at)
        own_later, own_earlier = later[at:], earlier[at:]
        for d in range(1, WINDOW):
            m = min(size, len(part) - d)
            if m > 0:
                same = (part[d : d + m] == part[:m]).view(np.uint8)
                own_later[:m] += same
                own_earlier[d : d + m] += same
    # Sums of the same steps for every window, so that a window's entropy depends on its bytes only.
    first = np.unique(data[:WINDOW], return_counts=True)[1]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _SUM[first].sum()
    total[1:] = _GAIN[earlier[WINDOW:]] - _GAIN[later[: n - WINDOW]]
    np.cumsum(total, out=total)
    most = np.log2(WINDOW)
    return ((most - total / (_SCALE * WINDOW)) * (1000 / most)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows at the places."""
    windows = data[places[:, None] + np.arange(width)]
    words = np.ascontiguousarray(windows).view("<u8")
    out = np.full(len(places), width, np.uint64)
    for i in range(words.shape[1]):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return out


def _selected(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the features of texts that lie one after the other."""
    n = len(data)
    if n < WINDOW + NEIGHBOURS:
        return np.zeros(0, np.int64)
    entropy = _entropies(data)
    rank = 1000 - np.abs(entropy - COMMON)  # the most improbable first
    rank[entropy < WEAK] = 2000
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    m = len(rank)
    inside = text[:m] == text[WINDOW - 1 : WINDOW - 1 + m]
    best = np.where(inside, rank, 3000) << 32 | np.arange(m)
    reach = 1
    while reach < NEIGHBOURS:  # the leftmost least one of 2, 4, ... windows
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    k = len(best)
    whole = text[:k] == text[WINDOW + NEIGHBOURS - 2 : WINDOW + NEIGHBOURS - 2 + k]
    won = best[whole & (best >> 32 < 2000)] & 0xFFFFFFFF
    return np.flatnonzero(np.bincount(won, minlength=1) >= WINS)


def _repeated(
    data: np.ndarray, places: np.ndarray, owner: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and place of the windows that stand for stretches without a feature."""
    rows = np.flatnonzero(np.diff(bounds) >= SHORT_TEXT)
    marks = np.concatenate([bounds[rows] - 1, places, bounds[rows + 1] - WINDOW + 1])
    of = np.concatenate([rows, owner, rows])
    order = np.lexsort((marks, of))
    marks, of = marks[order], of[order]
    wide = np.flatnonzero((np.diff(marks) > STRETCH - WINDOW + 1) & (of[1:] == of[:-1]))
    sizes = marks[wide + 1] - marks[wide] - 1
    ends = np.cumsum(sizes)
    stretch = np.repeat(np.arange(len(wide)), sizes)
    at = np.arange(len(stretch)) + (marks[wide] + 1 - ends + sizes)[stretch]
    found = np.empty(len(at), np.uint64)
    for i in range(0, len(at), _PIECE):
        found[i : i + _PIECE] = _hashed(data, at[i : i + _PIECE], WINDOW)
    order = np.lexsort((found, stretch))  # stable: a window's first place comes first
    stretch, found, at = stretch[order], found[order], at[order]
    fresh = np.ones(len(at) + 1, bool)
    fresh[1:-1] = (stretch[1:] != stretch[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(fresh)
    times, first = np.diff(first), first[:-1]
    text = of[wide][stretch[first]]
    bare = np.bincount(owner, minlength=len(bounds))[text] == 0
    kept = bare | (times > 1)
    return text[kept], found[first][kept], at[first][kept]


def fingerprints(texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Number of features, and filters (a row of bytes each), of every text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    places = _selected(data, bounds)
    owner = np.searchsorted(bounds, places, side="right") - 1
    long = sizes[owner] >= SHORT_TEXT
    owners, hashes, order = [owner[long]], [_hashed(data, places[long], WINDOW)], [places[long]]
    for rows, new in zip((owners, hashes, order), _repeated(data, places[long], owner[long], bounds), strict=True):
        rows.append(new)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHORT_TEXT)):
        if sizes[i] < SHORT_WINDOW:
            digest = hashlib.blake2b(texts[i], digest_size=8).digest()
            found, at = np.frombuffer(digest, np.uint64), bounds[i : i + 1]
        else:
            at = np.arange(bounds[i], bounds[i + 1] - SHORT_WINDOW + 1)
            found = _hashed(data, at, SHORT_WINDOW)
        owners.append(np.full(len(at), i))
        hashes.append(found)
        order.append(at)
    owner, feature, at = (np.concatenate(x) for x in (owners, hashes, order))
    # Each feature of a text once, where it occurs first.
    rows = np.lexsort((at, feature, owner))
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (owner[rows][1:] != owner[rows][:-1]) | (feature[rows][1:] != feature[rows][:-1])
    rows = rows[fresh]
    rows = rows[np.lexsort((at[rows], owner[rows]))]
    owner, feature = owner[rows], feature[rows]
    counts = np.bincount(owner, minlength=len(texts))
    filters = -(-counts // FEATURES)
    first_row, first_filter = np.cumsum(counts) - counts, np.cumsum(filters) - filters
    home = first_filter[owner] + (np.arange(len(owner)) - first_row[owner]) // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for i in range(HASHES):
        bits[home, (feature >> np.uint64(11 * i)) & np.uint64(BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [
        (int(c), packed[f : f + k]) for c, f, k in zip(counts, first_filter, filters, strict=True)
    ]


def as_text(print_: tuple[int, np.ndarray]) -> str:
    return f"{print_[0]}:{base64.b64encode(print_[1].tobytes()).decode()}"


def from_text(text: str) -> tuple[int, np.ndarray]:
    count, _, filters = text.partition(":")
    return int(count), np.frombuffer(base64.b64decode(filters), np.uint8).reshape(-1, BITS // 8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: per filter of the shorter chain its best overlap with the other's, weighed by bits.

    Texts without features, which are the empty ones, are like each other only.
    """
    x, y = (a[1], b[1]) if len(a[1]) <= len(b[1]) else (b[1], a[1])
    if not len(x):
        return 1.0 if not len(y) else 0.0
    nx = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    ny = np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    common = np.empty((len(x), len(y)))
    for i in range(len(x)):
        common[i] = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
    most = np.minimum(nx[:, None], ny)
    chance = nx[:, None] * ny / BITS
    least = chance + CUTOFF * (most - chance)
    score = np.clip((common - least) / np.maximum(most - least, 1e-9), 0, 1)
    return float((score.max(axis=1) * nx).sum() / nx.sum())


def edited(text: str, following: str) -> str:
    """A text whose last third is replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _with_followers(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows dealt to parts by ranges of descending ids; each part ends with the first row of the
    next one (``extra``), the last part with the first row of all."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ids = rows.select("id")
    cuts = ids.where("id is not null").approxQuantile(
        "id", [i / parts for i in range(1, parts)], 0.2 / parts)
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]

    def dealt(df: DataFrame) -> DataFrame:
        found = Bucketizer(splits=splits, inputCol="__as_double", outputCol="__bucket").transform(
            df.withColumn("__as_double", F.coalesce(F.col("id").cast("double"), F.lit(0.0)))
        )
        part = F.when(F.col("id").isNull(), len(splits)).otherwise(
            F.lit(len(splits)) - 1 - F.col("__bucket"))
        return found.withColumn("part", part.cast("int")).drop("__as_double", "__bucket")

    firsts = {r["part"]: r["id"] for r in
              dealt(ids).groupBy("part").agg(F.max("id").alias("id")).collect()}
    order = sorted(firsts)
    follow = [(p, firsts[order[(i + 1) % len(order)]]) for i, p in enumerate(order)]
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(follow, "part int, wanted bigint"))  # a row per part
    by_part = W.partitionBy("part").orderBy("h")
    extra = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted"))).withColumn(
        "n", F.row_number().over(by_part)).where("n = 1").select(
        "id", "text", "h", "part", F.lit(1).alias("extra"))
    return dealt(rows).withColumn("extra", F.lit(0)).unionByName(extra).repartition("part").sortWithinPartitions(
        "part", "extra", F.col("id").desc_nulls_last(), "h")


def compare_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how near they are.

    The next document is the one with the next smaller id, after the smallest
    the one with the largest. ``near_edited`` compares a fingerprint with that
    of the edited text, ``near_next`` with that of the next document.

    Defined cases: a NULL text counts as an empty one, without features; rows
    with a NULL id come after all others; rows with one id follow each other by
    a hash of their texts and lie in one task; a single row is its own next;
    other columns of ``docs`` don't matter.
    """
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _with_followers(docs, id_col, text_col, parts)

    def results(held: list) -> pa.RecordBatch:
        """Rows of all but the last of the held ones, which follow each other."""
        texts, changed = [r[1] for r in held], []
        for one, other in zip(held, held[1:], strict=False):
            changed.append(edited(one[1], other[1]))
        raw = [t.encode("utf-8", "surrogatepass") for t in changed]
        own = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
        new = fingerprints(raw)
        out = []
        for i, text in enumerate(changed):
            if held[i][2] != held[i + 1][2] or held[i][3]:
                continue
            out.append((held[i][0], len(texts[i]), hashlib.sha256(raw[i]).hexdigest(),
                        as_text(own[i]), as_text(new[i]), likeness(own[i], new[i]),
                        likeness(own[i], own[i + 1])))
            del text
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                 "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[1])
                if size > _BYTES and len(held) > 1:
                    yield results(held)
                    held = held[-1:]
                    size = len(held[0][1])
        if len(held) > 1:
            yield results(held)

    return rows.select("id", "text", "part", "extra").mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
