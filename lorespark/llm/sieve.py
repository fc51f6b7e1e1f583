"""A bitmap of hashed keys that thins a large table before a join which few of its rows pass.

Where such a join goes by shuffle, Spark moves every row of the large table. The bitmap is small enough to be broadcast;
it lets all rows through that the join keeps, and few others, so the join after it moves little and finds the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key: about one in so many of the other rows passes too.
BITS_A_KEY = 16
#: A part of the bitmap, as Spark's bitmap functions make it.
PART = 1 << 15
#: The bitmap has so many parts (8 MB) at most; with more keys than fit it lets more rows through.
MOST_PARTS = 2048


def thinned(rows: DataFrame, keys: list[Column], few: DataFrame, few_keys: list[Column]) -> DataFrame:
    """``rows`` without most of those whose keys (nulls are values like others) are not among the keys of ``few``.

    ``few`` is read twice, so it should be a table that is written already. A join on the keys must follow.
    """
    parts = min(MOST_PARTS, max(1, -(-few.count() * BITS_A_KEY // PART)))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(parts * PART))
    set_bits = few.select(place(few_keys).alias("_at")).groupBy((F.col("_at") / PART).cast("int").alias("_part"))
    bitmap = set_bits.agg(F.bitmap_construct_agg(F.col("_at") % PART).alias("_bits"))
    placed = rows.withColumn("_at", place(keys)).withColumn("_part", (F.col("_at") / PART).cast("int"))
    byte = F.substring("_bits", (F.col("_at") % PART / 8).cast("int") + 1, F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("_at") % 8).cast("int")) == 1
    return placed.join(F.broadcast(bitmap), "_part").where(found).select(*rows.columns)
