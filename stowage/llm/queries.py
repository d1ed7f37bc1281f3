"""One query per operator over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm import (
    alignment, ann, bpe, chat, collocations, fingerprints, html, jaccard, langid, maxproduct, mixing,
    quality, records,
)
from stowage.llm.tables import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Appended to every document's token ids.
END_ID = 2
GOOD_FROM = 0.3


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _remainder(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string")) % n


@query
def op1_mix_sources(spark, sf):
    """Documents repeated so that sources get parts of the mix by the root of their size."""
    return mixing.mix_sources(table(spark, sf, "documents"))


@query
def op2_token_records(spark, sf):
    folder = Scratch(spark, "records").folder
    path = public_tokenizers.path(WORD_TOKENIZER)
    records.write_records(table(spark, sf, "documents"), folder, path, END_ID, special_as_text=False)
    return records.index_records(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))


@query
def op4_chat_format(spark, sf):
    said = "</s>[INST] ok [/INST]"
    example = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    made = chat.format_conversations(rows.unionByName(example))
    read = made.select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op5_jaccard_join(spark, sf):
    return jaccard.linked_documents(table(spark, sf, "documents"), size=4, percent=85)


@query
def op6_fingerprints(spark, sf):
    return fingerprints.compare_with_next(table(spark, sf, "documents"))


@query
def op7_html_text(spark, sf):
    found = html.extract(table(spark, sf, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op8_quality(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs, table(spark, sf, "labels").where(~held_out))
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@query
def op9_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    path = public_tokenizers.path(BPE_RANKS)
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return bpe.decode(tokens, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.little_endian(F.col("ids"), path), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_byte_bpe(spark, sf):
    return bpe_digests(table(spark, sf, "documents"))


@query
def op11_top_products(spark, sf):
    """The 20 largest inner products of quantized vectors, for every twentieth vector."""
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", maxproduct.quantized(F.col("embedding")).alias("vector"))
    return maxproduct.top_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query
def op12_token_alignment(spark, sf):
    """Groups and links of two tokenizers' tokens in every document, scored by counts of id pairs."""
    return alignment.align_tokenizers(
        table(spark, sf, "documents"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL))


@query
def op13_collocations(spark, sf):
    """The 2,000 phrases of each language whose words belong together most."""
    return collocations.collocations(table(spark, sf, "documents"))


# Documents' sizes per source, the parts of the mix, and for each draw of a document's count
# the number of values k whose P(value <= k) its hash has passed.
SQL["op1_mix_sources"] = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
parts AS (
  SELECT source, chars, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, 0.5) ELSE 0.0 END AS part
  FROM sizes),
totals AS (SELECT sum(part) AS parts, sum(chars)::DOUBLE AS chars FROM parts),
rates AS (
  SELECT source, CASE WHEN p.chars > 0 THEN (t.chars * (part / t.parts)) / p.chars::DOUBLE
    ELSE 1.0 END AS rate FROM parts p, totals t),
draws AS (
  SELECT source, greatest(ceil(rate / 32.0), 1)::BIGINT AS draws,
    rate / greatest(ceil(rate / 32.0), 1) AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM draws
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
  FROM cdf WHERE k < 130 AND c <= 1 - 1e-13),
drawn AS (
  SELECT d.doc_id, w.source, i.n AS draw, ('0x' || substr(md5('11:' ||
    coalesce(d.doc_id::VARCHAR, '') || ':' || i.n), 1, 10))::BIGINT / pow(2.0, 40) AS u
  FROM documents d JOIN draws w ON d.source IS NOT DISTINCT FROM w.source,
    unnest(range(1, w.draws + 1)) AS i(n)),
counts AS (
  SELECT doc_id, draw, count(*) AS n FROM drawn JOIN cdf
    ON drawn.source IS NOT DISTINCT FROM cdf.source AND u >= c GROUP BY doc_id, draw),
copies AS (SELECT doc_id, sum(n)::BIGINT AS n FROM counts GROUP BY doc_id)
SELECT d.*, i.copy::INTEGER AS copy FROM documents d JOIN copies c ON d.doc_id = c.doc_id,
  unnest(range(1, c.n + 1)) AS i(copy)
"""

# Turns in order; formatted texts are measured by their parts.
SQL["op4_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
    (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, lag(role) OVER w AS last, lead(role) OVER w AS next, row_number() OVER w AS place,
    length(regexp_replace(replace(role, '\', '\\'), c, '\1\\\2', 'g')) AS role_chars,
    length(regexp_replace(replace(text, '\', '\\'), c, '\1\\\2', 'g')) AS text_chars
  FROM turns, (SELECT '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_turn\|>|\|im_end\|>|\|endoftext\|>|' ||
    'INST\]|/INST\]|<SYS>>|</SYS>>|s>|/s>)' AS c)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN last IS DISTINCT FROM role THEN 12 + role_chars + 10 ELSE 11 END
    + CASE WHEN next IS DISTINCT FROM role THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

# Sets of shingles, all pairs that share one, and the links' closure.
SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4
    THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

# Every query against every other row.
SQL["op11_top_products"] = """
WITH vectors AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
products AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM products
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""

# All n-grams by their texts.
SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS w FROM words, unnest(range(1, 5)) AS ms(m),
    unnest(range(1, len(w) - m + 2)) AS places(i)),
counts AS (SELECT lang, m, w, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.w, c.a, k, l.a AS l, r.a AS r,
    ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM counts c, unnest(range(1, c.m)) AS ks(k)
  JOIN counts l ON l.lang = c.lang AND l.w = c.w[1:k]
  JOIN counts r ON r.lang = c.lang AND r.w = c.w[k + 1:]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (
  SELECT lang, w[i:i + size - 1] AS w, max(a) AS longer FROM counts, unnest(range(2, m)) AS sizes(size),
    unnest(range(1, m - size + 2)) AS places(i) GROUP BY ALL),
free AS (
  SELECT s.*, array_to_string(s.w, ' ') AS phrase FROM weakest s LEFT JOIN inside i ON i.lang = s.lang AND i.w = s.w
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT f.lang, row_number() OVER v AS rank, phrase, a, l, r, n, score
FROM free f JOIN totals t ON t.lang = f.lang
WINDOW v AS (PARTITION BY f.lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY row_number() OVER v <= 2000
"""
