"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source; the mixture's size is shared among the sources by weight, no source beyond a multiple of
its own size; the ratio of target to size is the source's repetition rate. A document is taken floor(rate) times and
once more with the probability of the fraction, drawn from a hash of its id and a seed, so reruns agree.

A null text has no words; a null source is a source of its own, the last one; rows with the same id draw alike, rows
without an id draw by their text. Very long texts only count. Empty tables give empty results. Extra columns are kept by :func:`mixed` and ignored by :func:`shares`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"
#: The table of sources is broadcast up to so many rows (a few MB at most), else joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: str = "text") -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """sizes: source, source_size (a row per source). Adds weight, target and rate.

    Water filling: in order of cap by weight, a source is capped while its fair share of what the sources before it
    leave reaches its cap; the others share the rest by weight. One row per source passes one task here.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", pick.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    table = table.withColumn("level", left / F.sum("weight").over(from_here)).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    table = table.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return table.withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def draw(id_column: str = "doc_id", seed: str = SEED, text: str = "text") -> Column:
    """A number in [0, 1) from a hash of seed and id (without one, of seed and text): 48 bits of an md5."""
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), unnamed))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _rates(sized: DataFrame, size: str, work: Workspace, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """The table of sources, for a join: broadcast while its counted rows are few."""
    table = work.write(source_targets(sized.groupBy("source").agg(F.sum(size).alias("source_size")), weights, share, most), "sources")
    rates = table.withColumnRenamed("source", "_source").withColumnRenamed("rate", "_rate")
    return F.broadcast(rates) if table.count() <= BROADCAST_SOURCES else rates


def _copies(chance: Column) -> Column:
    return F.floor("_rate") + (chance < F.col("_rate") - F.floor("_rate")).cast("long")


def shares(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """A row per document: the columns doc_id, source, size, source_size, target, rate, copies and taken.

    Words are counted once; the sizes, with each row's draw, are a table of their own.
    """
    work = Workspace(documents.sparkSession, "mixing")
    sized = work.write(documents.select("doc_id", "source", word_count().alias("size"), draw(seed=seed).alias("_draw")), "sizes")
    joined = sized.join(_rates(sized, "size", work, weights, share, most), F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("copies", _copies(F.col("_draw")).cast("long")).select("doc_id", "source", "size", "source_size", "target", F.col("_rate").alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixture itself: every document's row as often as it is taken, columns unchanged."""
    sized = documents.select("source", word_count().alias("_size"))
    rates = _rates(sized, "_size", Workspace(documents.sparkSession, "mixing"), weights, share, most).select("_source", "_rate")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "source", draw(seed=seed).alias("_draw"))
    counted = rows.join(rates, F.col("source").eqNullSafe(F.col("_source"))).select("row", _copies(F.col("_draw")).cast("int").alias("copies"))
    repeated = counted.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*(F.col(f"row.`{c}`") for c in documents.columns))


def op9(documents: DataFrame) -> DataFrame:
    """The contract's columns, through :func:`shares`."""
    return shares(documents).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS named FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), filled AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM filled
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (floor(r.rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || d.named)), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
