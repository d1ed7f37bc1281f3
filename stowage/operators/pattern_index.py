"""Many patterns against many texts, by an index of short pieces.

A pattern mostly has plain texts that each of its matches must contain. The one
with the rarest piece is looked up by that piece of a few characters: a text
meets only the patterns whose piece it holds, in an equi-join; these pairs are
then tested for all plain texts and for the pattern itself. Alternatives count as
patterns of their own. Only pieces that
some pattern is looked up by leave the task that reads a text: a bitmap of them,
of bounded size, sorts out the others there. Patterns without a plain text are
tested one by one against every text; their number is bounded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import grams
from stowage.functions.literals import literals_of
from stowage.session import shared_folder

#: Characters of the shortest piece.
PIECE = grams.LENGTHS[0]
#: Patterns without a plain text, at most: each is tested on every text.
MAX_OPEN_PATTERNS = 1000


def pieces(text: str) -> Column:
    """The distinct pieces of a text; none if it is shorter than one."""
    of_length = lambda n: F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, n),
    )).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of_length(n) for n in grams.LENGTHS]))


def with_literals(patterns: DataFrame) -> DataFrame:
    """Distinct ``regex``es that Java accepts, with their alternatives and the plain texts that each needs, or NULL.

    Broken patterns are left out; they are tried on the executors, where they will run.
    """
    tried = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("regex"))
    return patterns.where("regex is not null").distinct().where(tried.isNotNull()).select(
        "regex", literals_of(F.col("regex"), PIECE).alias("literals"))


def open_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns that the index can't hold, since no plain text is known that they need."""
    return with_literals(patterns).where("literals is null").select("regex")


def pattern_index(values: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (piece, literal, regex, others): per distinct alternative the needed text whose piece fewest values hold.

    An alternative is a pattern of its own here, so one that many patterns share is
    tested once; ``others`` are the other texts it needs. One with a piece that no
    value holds has no match and is left out.
    """
    needed = known.where("literals is not null").select(F.explode("literals").alias("a")).select(
        "a.regex", "a.texts").distinct().select("regex", "texts", F.explode("texts").alias("literal"))
    parts = grams.with_slots(
        needed.select("literal").distinct().select("literal", F.explode(pieces("literal")).alias("piece")),
        "piece", grams.COUNTER_BITS, 1)
    counts = grams.slot_counts(values, grams.bitmap_of(parts, grams.COUNTER_BITS))
    rarest = parts.withColumn("slot", F.get("slots", F.lit(0))).join(counts, "slot", "left").groupBy("literal").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.length("piece"), "piece")).alias("best"))
    best = needed.join(rarest, "literal").groupBy("regex", "texts").agg(
        F.min(F.struct("best", "literal")).alias("b"))
    return best.where("b.best.n > 0").select(
        "b.best.piece", "b.literal", "regex", F.array_remove("texts", F.col("b.literal")).alias("others"))


def _stored(table: DataFrame) -> DataFrame:
    folder = f"{shared_folder(table.sparkSession)}/patterns-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def matched_values(values: DataFrame, patterns: DataFrame, tested: Column) -> DataFrame:
    """The ``value``s of which one text in the array ``tested`` has a match of some pattern.

    ``tested`` is an array over ``value`` whose texts are parts of it. The index
    is made when this is called, and kept in the shared folder.
    """
    value = F.col("value")
    known = _stored(with_literals(patterns))
    index = _stored(pattern_index(values, known))
    found = index.select("piece").distinct()
    bits = min(grams.MOST_BITS, max(16, (128 * found.count()).bit_length()))
    bitmap = grams.bitmap_of(grams.with_slots(found, "piece", bits, 2), bits)
    rows = grams.with_runs(values, bitmap, bits, 2)
    pairs = rows.join(index, "piece").where(
        F.contains("value", "literal") & F.forall("others", lambda text: F.contains(value, text)))
    hit = lambda regex: F.exists(tested, lambda t: F.regexp_like(t, regex))
    indexed = pairs.where(hit(F.col("regex"))).select("value")
    rest = known.where("literals is null").agg(
        F.when(F.count("regex") > MAX_OPEN_PATTERNS, F.raise_error(F.concat(
            F.lit(f"more than {MAX_OPEN_PATTERNS} patterns need no plain text, for example "),
            F.min("regex")))).otherwise(F.collect_list("regex")).alias("regexes"))
    single = values.withColumn("_open", rest.scalar()).where(
        F.exists("_open", hit)).select("value")
    return indexed.unionByName(single).distinct()
