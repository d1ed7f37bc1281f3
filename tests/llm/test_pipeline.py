"""Each stage on its own input, against plain versions of its decision."""

from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
import tiktoken
from test_jaccard import brute

from stowage.llm import bpe, langid
from stowage.llm.tables import Scratch

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
BROADCASTS = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_duplicates", "mix_sources", "byte_bpe"]
    first = pipeline.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == docs.count()  # all given texts are clear
    good = pipeline.quality_classifier(spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all((r["doc_id"] in kept) == (r["quality"] == 1) for r in labels)
    single = pipeline.near_duplicates(spark, docs, SF)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}
    mixed = pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and set(_rows(mixed)) <= set(_rows(docs))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    tokens = {r["doc_id"]: r["n_tokens"] for r in pipeline.byte_bpe(spark, docs, SF).collect()}
    assert tokens == {r["doc_id"]: len(library.encode_ordinary(r["text"])) for r in docs.collect()}


def test_odd_rows(spark, frame):
    text = "der und mit haus wasser morgen diese"
    rows = [(1, text, "de", "a", 1), (2, None, None, None, None), (3, "", "de", "a", 0), (4, "12 34", "de", None, 5),
            (5, "漢字 漢字", None, "a", 5), (1, text, "de", "a", 1), (None, text, "de", "a", 1), (6, text, "de", "b", 1)]
    docs = frame(rows, DDL)
    kept = _rows(pipeline.language_id(spark, docs, SF))
    assert {k[0] for k in kept} == {1, None, 6} and kept[rows[0]] == 2
    kept = _rows(pipeline.near_duplicates(spark, docs, SF))
    # The row without an id has the words of document 1.
    assert kept == Counter([rows[0], rows[1], rows[2], rows[3], rows[4]])
    none = frame([], DDL)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_rows_of_one_id_and_rows_without(spark, frame):
    """A near copy goes and a clean text of the same id stays; rows without an id form no group of their own."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join([*words[:-1], "x"]), " ".join(reversed(words))
    rows = [(3, near), (5, " ".join(words)), (5, other), (5, other), (None, other), (None, "q r s"), (None, "q r s"),
            (7, ""), (7, "alone here"), (None, None)]
    docs = frame([(*r, "en", "s", i, "own") for i, r in enumerate(rows)], DDL + ", text_key string")
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and {r["text_key"] for r in kept.collect()} == {"own"}
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(3, near), (5, other), (None, "q r s"), (7, ""), (7, "alone here"), (None, None)])


def test_whole_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)
    assert langid.UNDETERMINED == "und"


def test_duplicates_plan_their_links_once(spark, frame, monkeypatch):
    """Each shuffle and broadcast costs the driver memory: the long plans have few and none that small inputs add."""
    seen, write = {}, Scratch.write

    def watched(self, df, name):
        out = write(self, df, name)
        if "/jaccard-" in self.folder:
            seen[name] = df
        return out

    monkeypatch.setattr(Scratch, "write", watched)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[i % 5 :], f"x{i}"]), "en", "s", i) for i in range(60)]
    before = spark.conf.get(BROADCASTS, None)
    kept = pipeline.near_duplicates(spark, frame(rows, DDL), SF)
    assert spark.conf.get(BROADCASTS, None) == before
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("bitmap") <= 1
    joins = {name: df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for name, df in seen.items()}
    assert joins["links"] <= 5 and joins["more-0"] <= 6 and joins["more-1"] <= 8


def test_writes_without_adaptive_broadcasts(spark, frame):
    """A join of two shuffled sides stays a join of shuffled sides, and the session keeps its own setting."""
    for given, want in ((True, None), (False, "-1")):
        scratch, seen = Scratch(spark, "x", adaptive_broadcasts=given), []

        class Watched:
            schema = frame([(1,)], "a int").schema

            @property
            def write(self):
                seen.append(spark.conf.get(BROADCASTS, None))
                return frame([(1,)], "a int").write

        assert [r["a"] for r in scratch.write(Watched(), "t").collect()] == [1]
        assert seen == [want] and spark.conf.get(BROADCASTS, None) is None
