"""A training mix: sources to target weights over time.

Every source has a share of all words and a ramp, the rate at which it is taken at
the start and at the end. The ramp, integrated and scaled to the target, is the
cumulative demand of the source at time ``t`` from 0 to 1. A document's words
before it in its source (in an order fixed by a hash of its id, epoch after epoch)
are a demand; the time at which the source's demand gets there is its position.

A document is taken in an epoch if its middle word lies within the target, so the
words taken differ from the target by half a document at most. Sums within a source come
from one range shuffle, so that one source, or rows without an id, may be most of all.
Sums over the sources are taken in the same way, as these may be many.

Defined cases: a NULL text has size 0; a NULL source is a source of its own and
comes last; a NULL id is hashed as an empty text. Texts of size 0 are never taken.
Documents of a source are ordered by the hash of their id, their size, the hash of their
text and their place in the input, so repeated rows are documents of their own and a task that
is run again gives the same. Further columns are carried along, under any name. Empty
tables give empty mixes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.ranks import ranked, running
from planar.llm.scratch import written
from planar.llm.words import word_array

WEIGHTS = (5, 2, 1)
# Rates at the start and the end: from early to late, level, from late to early.
RAMPS = ((3, 1), (1, 1), (1, 3))
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` (from a scan) with ``source_rank, target``: shares by weight,
    none above ``most`` times the source, the excess shared by weight among the others.

    The sources in order of ``cap / weight`` reach their caps one after the other,
    so the level at which the others stay is found by running sums."""
    spark = sizes.sparkSession
    columns = {"_all": F.lit(0), "_none": F.col("source").isNull()}
    ranks = ranked(sizes.withColumns(columns), "_all", ["_none", "source"], "sources").drop("_none")
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    out = ranks.withColumn("source_rank", (F.col("pos") + 1).cast("int")).drop("pos")
    out = out.withColumns({"w": F.get(cycle, (F.col("source_rank") - 1) % len(weights)), "cap": F.col("source_size") * most})
    out = written(spark, out.withColumn("at", F.col("cap") / F.col("w")), "source-caps")
    out = running(out, "_all", ["at", "source_rank"], {"capped": "cap", "before": "w"}, "source-levels")
    sums = out.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w")).first()
    total, all_w = (F.lit(v or 0).cast("bigint") for v in sums)
    out = out.withColumn("level", (total - F.col("capped")) / (all_w - F.col("before")))
    # The first source that does not reach its cap has the level of all behind it.
    first = out.where(F.col("level") * F.col("w") <= F.col("cap")).agg(
        F.min(F.struct("at", "source_rank", "level"))["level"].alias("level")).first()
    target = F.least(F.col("cap").cast("double"), F.lit(first.level).cast("double") * F.col("w"))
    return out.select("source", "source_size", "source_rank", target.alias("target"))


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[tuple[float, float]] = RAMPS,
    most: int = MOST_EPOCHS, text: str = "text", source: str = "source", id: str = "doc_id",  # noqa: A002
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row per document: ``doc`` (the columns in ``carry``, or all), ``size``,
    ``source_size``, ``target``, ``copies``, ``before`` (words of its source before
    it in an epoch), ``source_rank``, ``positions`` (of each copy, from 0 to 1) and the
    order ``h``."""
    spark = docs.sparkSession
    doc = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    order = F.md5(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")))
    sized = docs.select(
        doc.alias("doc"), _source_key(F.col(f"`{source}`").cast("string")).alias("key"), order.alias("h"),
        F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.size(word_array(F.col(f"`{text}`"))).cast("bigint").alias("size"))
    rows = running(sized, "key", ["h", "size", "tie"], {"before": "size"}, "mix").drop("tie")
    name = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size")).select(name.alias("source"), "source_size")
    targets = source_targets(written(spark, sources, "source-sizes"), weights, most)
    targets = written(spark, targets.withColumn("key", _source_key("source")).drop("source"), "targets")
    out = attach(rows, targets, "key", "inner")
    left = F.col("target") - F.col("before") - F.col("size") / 2
    epochs = F.floor(F.try_divide(left, F.col("source_size"))) + 1
    copies = F.when(F.col("size") > 0, F.least(F.greatest(epochs, F.lit(0)), F.lit(most))).otherwise(0)

    def ramp(side: int) -> Column:
        rates = F.array(*[F.lit(float(r[side])) for r in ramps])
        return F.get(rates, (F.col("source_rank") - 1) % len(ramps))

    def place(epoch: Column) -> Column:
        demand = F.least((epoch * F.col("source_size") + F.col("before")) / F.col("target"), F.lit(1.0))
        return position(demand, ramp(0), ramp(1))

    out = out.withColumn("copies", copies.cast("bigint"))
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    return out.select(
        "doc", "size", "source_size", "target", "copies", "before", "source_rank", "h",
        F.coalesce(F.transform(epochs, place), F.array().cast("array<double>")).alias("positions"))


def position(demand: Column, start: Column, end: Column) -> Column:
    """The time at which a source with this ramp has met a share ``demand`` of its
    target. The share met at t is (start t + (end - start) t^2 / 2) / ((start + end) / 2);
    this is its inverse, in a form that holds for level ramps, too."""
    u = demand * (start + end) / 2
    return 2 * u / (start + F.sqrt(F.greatest(start * start + 2 * (end - start) * u, F.lit(0.0))))


def in_order(mixed: DataFrame) -> DataFrame:
    """The documents of a mix in training order, a row per epoch in which one is
    taken, with ``epoch`` and ``position``; a range shuffle sorts them."""
    rows = mixed.select("doc", "source_rank", "h", F.posexplode("positions").alias("epoch", "position"))
    rows = rows.withColumn("epoch", F.col("epoch").cast("bigint")).orderBy("position", "source_rank", "epoch", "h")
    extra = {"epoch": F.col("epoch"), "position": F.col("position")}
    taken = {f.name for f in mixed.schema["doc"].dataType.fields}
    return rows.select("doc.*", *[c.alias(n if n not in taken else f"mix_{n}") for n, c in extra.items()])
