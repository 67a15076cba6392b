"""Contiguous shards of near-equal bytes, by global prefix sums. DataFrame functions only.

The rows in key order form one line of bytes. They are dealt out over ranges of that line, each range gets its total,
totals get a running sum, and each row gets its place on the line; the line is cut at equal targets. No task holds more
than one range: rows of one key, or without one, are told apart by size, crc and a number of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, materialize

#: Rows that a range of keys should hold, and the fewest and most ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 17, 32, 1 << 17


def byte_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, size, text_crc32, shard and slot.

    A row weighs its text's UTF-8 bytes plus 1 (null text: 1). A row goes to the shard in which its middle byte falls,
    so a shard misses its target by less than one row at either cut. Rows are ordered by key, null first; equal keys
    by crc and size; repeated rows stay, each with a slot of its own. A text longer than a target leaves the shards
    under it empty. Other columns are ignored; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("k"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("crc"), F.monotonically_increasing_id().alias("row"))
    with Scratch(docs.sparkSession, "shards") as s:
        narrow = s.write(narrow, "rows")  # the texts are read once, and a row keeps its number
        n = min(MOST_RANGES, max(LEAST_RANGES, narrow.count() // RANGE_ROWS))
        # Written again, so that the rows of a range are the same ones wherever they are read.
        ranges = s.write(narrow.repartitionByRange(n, "k", "crc", "size", "row").withColumn("part", F.spark_partition_id()), "ranges")
        placed = materialize(_placed(ranges, n_shards), "placed")
    return placed.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    within = Window.partitionBy("part").orderBy("k", "crc", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"upto": F.sum("size").over(within), "nth": F.count(F.lit(1)).over(within)})
    # One row per range, MOST_RANGES at most: small enough for one task and for a broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (
        rows.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
        .select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_bytes").over(whole).alias("all_bytes"))
    )
    twice_middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = rows.join(F.broadcast(totals), "part").select(
        "k", "size", "crc", (F.col("rows_before") + F.col("nth") - 1).alias("at"), F.floor(twice_middle * n_shards / (2 * F.col("all_bytes"))).cast("int").alias("shard")
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first"))
