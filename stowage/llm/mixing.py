"""Mixing sources to target weights by Poisson replication.

Every document is repeated a number of times that follows a Poisson
distribution with its source's target repetition rate as mean, and the copies
are shuffled globally. The number comes from inverting the distribution at a
point that a seeded hash of the document id gives, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.llm.tables import Scratch, appended, free_prefix

#: Up to so many sources the table of rates, a few hundred bytes a row, is broadcast.
MAX_BROADCAST_SOURCES = 20_000
#: Beyond that, a source's documents meet its rate in so many tasks.
PIECES = 64
#: Largest mean of one draw; a larger rate is the sum of several draws.
MEAN_PER_DRAW = 32.0
#: More values than a draw of that mean takes at the resolution of a hash of 40 bits.
MAX_VALUES = 130
RESOLUTION = 2.0**40


def _uniform(seed: int, id_col: str, draw: Column) -> Column:
    """A number from 0 to below 1 for each document and draw."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                       draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("double") / F.lit(RESOLUTION)


def _distribution(mean: Column) -> Column:
    """P(value <= k) for k = 0, 1, ... up to 1, as far as a hash can tell."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"),
                     F.array(F.exp(-mean)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k.cast("double")
        longer = F.struct(p.alias("p"), (state["c"] + p).alias("c"),
                          F.concat(state["cdf"], F.array(state["c"] + p)).alias("cdf"))
        return F.when(state["c"] > F.lit(1 - 1e-13), state).otherwise(longer)

    values = F.sequence(F.lit(1), F.lit(MAX_VALUES))
    return F.aggregate(values, start, step, lambda state: state["cdf"])


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float | None = None,
    exponent: float = 0.5,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Per source (NULL is a source of its own): ``source_key``, characters, and its rate.

    ``weights`` gives each source's part of the mix (``""`` names NULL; sources
    not named get 0); without it, a part follows ``chars ** exponent``. A rate
    is the mean number of copies: ``budget`` characters times the part, over
    the source's characters. ``budget`` is the corpus's size unless given.
    Sources without characters have rate 1.
    """
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sizes = docs.groupBy(key.alias("source_key"), F.col(source_col).isNull().alias("unnamed")).agg(
        F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")).alias("chars")
    )
    if weights is None:
        part = F.pow(F.col("chars").cast("double"), F.lit(float(exponent)))
    else:
        part = F.lit(0.0)
        for name, weight in weights.items():
            part = F.when(F.col("source_key") == name, F.lit(float(weight))).otherwise(part)
    sizes = Scratch(docs.sparkSession, "mix").write(
        sizes.withColumn("part", F.when(F.col("chars") > 0, part).otherwise(0.0)), "sizes"
    )
    total = sizes.agg(F.sum("part").alias("parts"), F.sum("chars").alias("chars")).first()
    chars = float(budget if budget is not None else total["chars"] or 0)
    mix = F.lit(chars) * (F.col("part") / F.lit(total["parts"] or 1.0))
    return sizes.withColumn(
        "rate", F.when(F.col("chars") > 0, mix / F.col("chars").cast("double")).otherwise(1.0)
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float | None = None,
    exponent: float = 0.5,
    seed: int = 11,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_broadcast_sources: int = MAX_BROADCAST_SOURCES,
) -> DataFrame:
    """All columns of ``docs`` and ``copy`` (from 1), in an order that mixes all sources.

    The shuffle deals the copies out by a hash and sorts each part by it, which
    is a random order of the whole and cannot be skewed by a source.

    Defined cases: a NULL source is a source of its own; NULL and empty texts
    have no characters and take part with their source's rate; a NULL id draws
    like an empty one; rows with one id draw the same number; an empty table
    gives an empty one; an input column ``copy`` is replaced.
    """
    p = free_prefix("__mix_", docs.columns)
    rates = source_rates(docs, weights, budget, exponent, source_col, text_col)
    draws = F.greatest(F.ceil(F.col("rate") / MEAN_PER_DRAW), F.lit(1)).cast("int")
    rates = rates.select(
        F.col("source_key").alias(f"{p}key"), F.col("unnamed").alias(f"{p}null"),
        draws.alias(f"{p}draws"), _distribution(F.col("rate") / draws).alias(f"{p}cdf"),
    )
    few = rates.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources
    rows = appended(docs, "copy").withColumns({
        f"{p}key": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        f"{p}null": F.col(source_col).isNull(),
    })
    keys = [f"{p}key", f"{p}null"]
    if few:
        rows = rows.join(F.broadcast(rates), keys)
    else:
        piece = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(PIECES)).cast("int")
        pieces = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))
        rows = rows.withColumn(f"{p}piece", piece).join(
            rates.withColumn(f"{p}piece", pieces), [*keys, f"{p}piece"]
        )

    def drawn(i: Column) -> Column:
        u = _uniform(seed, id_col, i)
        return F.size(F.filter(f"{p}cdf", lambda c: u >= c))

    copies = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col(f"{p}draws")), drawn), F.lit(0), lambda a, b: a + b
    )
    rows = rows.withColumn(f"{p}copies", copies).where(f"{p}copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies"))))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy"), F.col(text_col))
    return (
        rows.withColumn(f"{p}order", order)
        .repartition(f"{p}order")
        .sortWithinPartitions(f"{p}order")
        .select(*appended(docs, "copy").columns, "copy")
    )
