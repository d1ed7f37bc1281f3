"""Language identification of whole texts and of their spans.

A text is cut into words, that is, runs of letters. The script of a word leaves
only the languages written in it. Each of these gives the word a score from its
letter trigrams, and the best path over the words, in which every change of
language costs a penalty, labels spans of mixed text (Viterbi).
"""

from __future__ import annotations

import re
import sys
from unicodedata import category
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stowage.llm.tables import free_name

UNDETERMINED = "und"
#: Documents of a language that a model is fitted on, on average.
MAX_DOCS_PER_LANG = 2_000
#: What a change of language costs, in natural logarithms of a likelihood.
SWITCH_PENALTY = 9.0
#: A script holding at least this part of a language's letters is one of its scripts.
SCRIPT_SHARE = 0.02
#: Words whose scores a worker remembers; others are scored again when they return.
REMEMBERED_WORDS = 400_000
#: Words labelled at once, taking a word for five bytes; a single text may have more.
WORDS_PER_BATCH = 300_000

_WORD = re.compile(r"[^\W\d_]+")
#: Numbers such as fractions and circled digits, which count as word characters but are no letters;
#: only texts that hold some are gone through for them.
_NUMBERS = {i: " " for i in range(0x110000) if category(chr(i)) in ("Nl", "No")}


def _found(text: str) -> list[str]:
    """The runs of letters of a text."""
    words = _WORD.findall(text)
    if words and not "".join(words).isalpha():
        return _WORD.findall(text.translate(_NUMBERS))
    return words


def _starts(text: str) -> list[int]:
    """Where the runs of letters begin."""
    whole = "".join(_WORD.findall(text))
    return [m.start() for m in _WORD.finditer(text if whole.isalpha() else text.translate(_NUMBERS))]


#: First and last code points of scripts (fixed values of the Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)],
}


def script_of(letter: str) -> str:
    point = ord(letter)
    for name, ranges in SCRIPTS.items():
        if any(first <= point <= last for first, last in ranges):
            return name
    return "other"


@dataclass
class LanguageModel:
    """Trigram log likelihoods per language, and each language's scripts."""

    languages: list[str]
    grams: dict[str, int]
    weights: np.ndarray  # a row per trigram and a last one for unknown trigrams
    scripts: dict[str, list[int]]  # script -> languages written in it
    prior: list[float] = field(default_factory=list)

    def word_scores(self, word: str) -> np.ndarray:
        """One score per language; zeros if no learned language uses the script."""
        usable = self.scripts.get(script_of(word[0]))
        if not usable:
            return np.zeros(len(self.languages), np.float32)
        padded = f"^{word}$"
        last = len(self.weights) - 1
        get = self.grams.get
        rows = [get(padded[i : i + 3], last) for i in range(len(padded) - 2)]
        scores = self.weights[rows].sum(axis=0)
        if len(usable) < len(self.languages):
            other = np.ones(len(scores), bool)
            other[usable] = False
            scores[other] = scores[usable].min() - 4 * SWITCH_PENALTY
        return scores


class _Words(dict):
    """Numbers the words seen and holds their scores."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.scores = np.zeros((1024, len(model.languages)), np.float32)
        self.length = np.zeros(1024, np.float32)
        self.known = np.zeros(1024, bool)

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.scores[number] = self.model.word_scores(word)
        self.length[number] = len(word)
        self.known[number] = script_of(word[0]) in self.model.scripts
        self[word] = number
        return number


def _text_batches(batches: Iterator[pa.RecordBatch], names: list[str]):
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        yield from zip(*columns, strict=True)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose last column, a text, has about ``WORDS_PER_BATCH`` words."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + 5 * WORDS_PER_BATCH, "right")))
        yield batch.slice(at, end - at)
        at = end


def train(
    rows: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs_per_lang: int = MAX_DOCS_PER_LANG,
    max_grams_per_lang: int | None = None,
) -> LanguageModel:
    """Fits a model on rows with a text and a language.

    A bounded sample by a hash of the id is used, about ``max_docs_per_lang``
    documents of each language; texts are used whole, and all their trigrams
    are learned unless ``max_grams_per_lang`` says how many of the most frequent
    ones. Without any such row the model has no language and every prediction
    is ``und``.
    """
    named = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
    )
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs_per_lang / count))).otherwise(
            share
        )
    point = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = named.where(point < share).select("lang", "text")

    def count_grams(batches):
        grams: Counter = Counter()
        letters: Counter = Counter()
        for lang, text in _text_batches(batches, ["lang", "text"]):
            for word in _found(text.lower()):
                letters[lang, script_of(word[0])] += len(word)
                padded = f"^{word}$"
                for i in range(len(padded) - 2):
                    grams[lang, padded[i : i + 3]] += 1
        for kind, counter in (("gram", grams), ("script", letters)):
            if counter:
                yield pa.RecordBatch.from_pydict({
                    "kind": [kind] * len(counter), "lang": [k[0] for k in counter],
                    "item": [k[1] for k in counter], "n": list(counter.values()),
                })

    counted = (
        sample.mapInArrow(count_grams, "kind string, lang string, item string, n bigint")
        .groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    # Kinds and languages are few, so all rows share their texts.
    few = [map(sys.intern, counted.column(name).to_pylist()) for name in ("kind", "lang")]
    rows = zip(*few, counted.column("item").to_pylist(), counted.column("n").to_pylist(), strict=True)
    return _fit(counts, rows, max_grams_per_lang)


def _fit(
    docs: dict[str, int], counted: Iterable[tuple[str, str, str, int]], max_grams: int | None = None
) -> LanguageModel:
    languages = sorted(docs)
    at = {lang: i for i, lang in enumerate(languages)}
    by_lang: dict[str, list] = {lang: [] for lang in languages}
    letters: Counter = Counter()
    for kind, lang, item, n in counted:
        if kind == "gram":
            by_lang[lang].append((-n, item))
        else:
            letters[lang, item] += n
    kept = {item for rows in by_lang.values() for _, item in sorted(rows)[:max_grams]}
    grams = {item: i for i, item in enumerate(sorted(kept))}
    weights = np.full((len(grams) + 1, max(1, len(languages))), 0.5)
    for lang, rows in by_lang.items():
        for n, item in rows:
            if item in grams:
                weights[grams[item], at[lang]] -= n
    weights = np.log(weights / weights.sum(axis=0))
    weights -= weights.max(axis=1, keepdims=True)
    total = Counter()
    for (lang, _), n in letters.items():
        total[lang] += n
    scripts: dict[str, list[int]] = {}
    for (lang, script), n in sorted(letters.items()):
        if n >= SCRIPT_SHARE * total[lang]:
            scripts.setdefault(script, []).append(at[lang])
    every = sum(docs.values()) or 1
    return LanguageModel(
        languages, grams, weights.astype(np.float32), scripts, [docs[x] / every for x in languages]
    )


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, texts one after the other in ``scores``.

    All texts of the batch take a step together, longest first, so a step is
    one array operation over the texts that have a word left.
    """
    n, k = scores.shape
    path = np.zeros(n, np.int32)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    long = lengths[order]
    if not len(long) or long[0] == 0:
        return path
    # Texts with more than t words, for every t.
    active = len(long) - np.searchsorted(long[::-1], np.arange(long[0]), side="right")
    kind = np.int8 if k < 128 else np.int32  # one cell for each word and language
    arrived = np.zeros((n, k), kind)
    best = scores[first[: active[0]]].astype(np.float32)
    final = np.zeros(len(long), np.int32)
    states = np.arange(k, dtype=kind)
    for t in range(1, int(long[0])):
        m = active[t]
        if m < len(best):
            final[m : len(best)] = best[m:].argmax(axis=1)
            best = best[:m]
        at = first[:m] + t
        top = best.argmax(axis=1)
        switched = best[np.arange(m), top][:, None] - penalty
        stay = best >= switched
        arrived[at] = np.where(stay, states, top[:, None].astype(kind))
        best = np.where(stay, best, switched) + scores[at]
    final[: len(best)] = best.argmax(axis=1)
    state = final.copy()
    for t in range(int(long[0]) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = arrived[at, state[:m]]
    return path


def _label(model: LanguageModel, words: _Words, texts: list[str | None], penalty: float):
    """Per text: language, score and spans."""
    found = [_found(t.lower()) if t else [] for t in texts]
    lengths = np.array([len(f) for f in found], np.int64)
    numbers = np.fromiter(
        (words[w] for f in found for w in f), np.int32, count=int(lengths.sum())
    )
    path = best_paths(words.scores[numbers], lengths, penalty)
    size = words.length[numbers].astype(np.float64)
    known = words.known[numbers]
    k = len(model.languages)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(doc, size, len(texts))
    share = np.bincount(doc * k + path, size * known, len(texts) * k).reshape(-1, k)
    choice = (share + np.array(model.prior) * 1e-9).argmax(axis=1)
    score = share[np.arange(len(texts)), choice] / np.maximum(letters, 1)
    out = []
    for i, text in enumerate(texts):
        if not lengths[i]:
            out.append((UNDETERMINED, 0.0, []))
            continue
        own = path[ends[i] - lengths[i] : ends[i]]
        turns = np.flatnonzero(own[1:] != own[:-1]) + 1
        spans = _spans(text, own, turns, model.languages)
        out.append((model.languages[choice[i]], min(1.0, float(score[i])), spans))
    return out


def _spans(text: str, path: np.ndarray, turns: np.ndarray, languages: list[str]) -> list[dict]:
    if not len(turns):
        return [{"start": 0, "end": len(text), "lang": languages[path[0]]}]
    lowered = text.lower()
    if len(lowered) != len(text):  # a few capitals grow: places then hold for the lower-cased text
        text = lowered
    starts = _starts(lowered)
    cuts = [0, *(starts[t] for t in turns), len(text)]
    firsts = [0, *turns]
    return [
        {"start": a, "end": b, "lang": languages[path[f]]}
        for a, b, f in zip(cuts, cuts[1:], firsts, strict=False)
    ]


SPANS = "array<struct<start: int, end: int, lang: string>>"


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    keep: list[str] | None = None,
    penalty: float = SWITCH_PENALTY,
    prefix: str = "",
) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``), ``lang_pred``, ``score`` and ``spans``.

    ``lang_pred`` is the language with most letters on the best path, ``score``
    its part of the text's letters, where letters in a script of no learned
    language count for none. ``spans`` cover the text, in characters.

    Defined cases: NULL, empty and letterless texts are ``und`` with score 0 and
    no spans; equal scores go to the first language in sorted order, or the more
    frequent one if no letter counts; repeated rows have equal results; input
    columns with a result's name are replaced. ``prefix`` stands before result names.
    """
    from pyspark.sql.types import StructType

    results = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}spans"]
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    source = docs.select(*columns, F.col(text_col).alias(free_name("text", columns)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        words = _Words(model)
        for part in (part for batch in batches for part in _parts(batch)):
            if len(words) > REMEMBERED_WORDS:
                words = _Words(model)
            texts = part.column(part.num_columns - 1).to_pylist()
            if model.languages:
                rows = _label(model, words, texts, penalty)
            else:
                rows = [(UNDETERMINED, 0.0, [])] * len(texts)
            arrays = [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.list_(pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))),
            ]
            yield pa.RecordBatch.from_arrays(
                part.columns[:-1] + arrays, names=[*columns, *results]
            )

    schema = StructType([docs.schema[c] for c in columns])
    kinds = ["string", "double", SPANS]
    ddl = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(results, kinds, strict=True)))
    return source.mapInArrow(run, StructType(schema.fields + ddl.fields))
