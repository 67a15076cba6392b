"""As-of join: to each row the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.shared import Scratch, materialize


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str | None = None, strict: bool = False, forward: bool = False, tolerance=None, suffix: str = "_right") -> DataFrame:
    """All rows and columns of ``left`` with the columns of the ``right`` row of the same ``by`` that is the last one not after
    its ``on``; null where there is none. Right columns whose names are taken get ``suffix``; ``by`` appears once.

    ``strict`` wants an earlier row, ``forward`` the first one not before. Of right rows of one time that with the largest
    ``tie`` counts, without it any. ``tolerance`` (a number, or a Column such as an interval) is how far the row may be.
    Null keys and times match nothing. Repeated left rows stay as they are; an empty table on either side is no error.

    Both tables are sorted together over Spark's own ranges of key and time, so a key with many rows has many ranges. What
    a range needs from those before it is a single row, the last right one, which is sent into it.
    """
    gone = [c for c in right.columns if c not in by]
    names = {c: c + suffix if c in left.columns else c for c in gone}
    clash = [n for n in names.values() if list(names.values()).count(n) > 1 or (n in left.columns)]
    if clash:
        raise ValueError(f"columns {', '.join(sorted(set(clash)))} would appear twice; choose another suffix")
    whole = F.lit(True)
    for c in [*by, on]:
        whole = whole & F.col(f"`{c}`").isNotNull()
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)]
    at = F.col(f"`{on}`").alias("_t")
    row = lambda df: F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    none = lambda df: F.lit(None).cast(df.select(row(df).alias("r")).schema["r"].dataType)
    tied = F.col(f"`{tie}`") if tie else F.lit(0)
    tie_type = right.select(tied.alias("x")).schema["x"].dataType
    # At equal times the side that comes first is seen by the other one.
    a = left.where(whole).select(*keys, at, F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), row(left).alias("_l"), none(right).alias("_r"))
    b = right.where(whole).select(*keys, at, F.lit(1 if strict else 0).alias("_side"), tied.alias("_tie"), none(left).alias("_l"), row(right).alias("_r"))
    own = [f"_k{i}" for i in range(len(by))]
    order = [*(F.col(k) for k in own), F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_side"), F.col("_tie").asc_nulls_first(), F.col("_n")]
    with Scratch(left.sparkSession, "asof") as s:
        rows = a.unionByName(b).withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int")).drop("_side", "_tie", "_n")
        rows = s.write(rows, "ranges")
        carried = _carried(rows, own)
        if carried is not None:
            rows = rows.unionByName(carried.select(rows.columns))
        until = Window.partitionBy("_part", *own).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(until)).where("_l IS NOT NULL")
        met = F.col(f"_r.c{right.columns.index(on)}")
        if tolerance is not None:
            far = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
            near = met <= F.col("_t") + far if forward else met >= F.col("_t") - far
            found = found.withColumn("_r", F.when(near, F.col("_r")))
        mine = [F.col(f"_l.c{i}").alias(c) for i, c in enumerate(left.columns)]
        theirs = [F.col(f"_r.c{right.columns.index(c)}").alias(n) for c, n in names.items()]
        out = found.select(*mine, *theirs)
        alone = left.where(~whole).select(*[F.col(f"`{c}`") for c in left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in names.items()])
        return materialize(out.unionByName(alone), "asof")


def _carried(rows: DataFrame, own: list[str]) -> DataFrame | None:
    """The last right row before each range whose first key it has, as the first row of that range; at most one a range.

    The driver gets a row of numbers for each range. Keys are compared by a hash: a row of another key does no harm.
    """
    key = F.xxhash64(*own) if own else F.lit(0)
    ends = rows.groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max(F.when(F.col("_r").isNotNull(), F.struct("_at", key.alias("key")))).alias("last"))
    last, moves = None, []
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        if last and last["key"] == r["first"]:
            moves.append((last["_at"], r["_part"]))
        last = r["last"] or last
    if not moves:
        return None
    to = rows.sparkSession.createDataFrame(moves, "_at long, _to int")
    return rows.where("_r IS NOT NULL").join(F.broadcast(to), "_at").withColumns({"_part": F.col("_to"), "_at": F.lit(-1).cast("long")}).drop("_to")
