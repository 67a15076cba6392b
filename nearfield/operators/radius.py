"""All pairs of vectors within a radius, by cells around pivots and the triangle inequality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import between, norm2, pairwise
from nearfield.operators.knn import matrix, prepared
from nearfield.shared import Scratch, materialize

#: Pivots and their bytes at most (all executors have them, tasks their distances from each other), vectors of a block, visitors of a block that one task takes, rows at a time.
PIVOTS, PIVOT_BYTES, BLOCK, VISITORS, ROWS = 2048, 8 << 20, 4096, 32 * 4096, 2048
#: Distances that a task holds at once, and pairs of vectors gathered at once.
VALUES, PAIRS = 1 << 19, 8192
#: Sampled vectors by which the number of pivots is chosen, and how many comparisons cost as much as sending a vector once more.
PROBES, SENDING = 1024, 2000


@dataclass
class Within:
    """``pairs`` (vec_id, other_id, dist) of classes, vec_id < other_id and dist squared; ``members`` (vec_id, class_id): a class
    is all equal vectors, named by its smallest id; ``compared``: how many pairs of classes were compared, of ``classes``."""

    pairs: DataFrame
    members: DataFrame
    compared: int
    classes: int

    def links(self) -> DataFrame:
        """(vec_id, class_id, n_links): the other vectors within the radius of each."""
        size = self.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
        both = self.pairs.select("vec_id", "other_id").unionByName(self.pairs.select(F.col("other_id").alias("vec_id"), F.col("vec_id").alias("other_id")))
        near = both.join(size.withColumnRenamed("class_id", "other_id"), "other_id").groupBy(F.col("vec_id").alias("class_id")).agg(F.sum("n").alias("near"))
        total = size.join(near, "class_id", "left").select("class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
        return self.members.join(total, "class_id").select("vec_id", "class_id", "n_links")


def within(vectors: DataFrame, radius: float, key: str = "vec_id", vector: str = "embedding") -> Within:
    """All pairs of different vectors at most ``radius`` apart (Euclidean, not squared).

    Rows without a key or a vector, or with components that are null, no numbers or infinite, take no part. Equal vectors
    are one class, so copies cost nothing and lose no link; ids are taken to be distinct. Vectors of different lengths raise.

    A vector lives in the cell of its nearest pivot, in a ring by its distance from it. It visits other cells and rings that
    the triangle inequality and the plane between two pivots do not rule out, one of two cells visiting the other. Rings of
    many vectors are split into blocks, their visitors into turns, so a task holds a block and reads visitors in batches.

    The number of pivots is that of the least estimated work, the root of n and PIVOTS at most; the pairs are the same with any. Where
    vectors have no structure pivots rule nothing out: there are few, and nearly all pairs are compared, block by block.
    """
    if not radius >= 0 or radius == float("inf"):
        raise ValueError("the radius must be a finite number of at least 0")
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = prepared(vectors, "l2", key, vector).where(finite)
    spark = vectors.sparkSession
    with Scratch(spark, "radius") as s:
        # Grouping takes -0.0 for 0.0; so does the distance.
        groups = rows.groupBy("v").agg(F.min("key").alias("class_id"))
        classes = s.write(groups, "classes")
        members = materialize(rows.join(classes, "v").select(F.col("key").alias("vec_id"), "class_id"), "members")
        size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w"), F.max(norm2("v")).alias("most")).first()
        n, most = size["n"], size["most"] or 0.0
        if not n:
            return Within(spark.createDataFrame([], "vec_id long, other_id long, dist double"), members, 0, 0)
        count = max(1, min(int(n**0.5), PIVOTS, PIVOT_BYTES // (8 * max(1, size["w"]))))
        sample = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(min(n, count + PROBES)).select("v").toArrow().combine_chunks()
        sample = matrix(sample["v"].chunk(0), "l2")
        count = _pivots(sample[:count], sample[count:], n, radius)
        pivots = spark.sparkContext.broadcast(sample[:count])
        homes = s.write(classes.mapInArrow(_homes(pivots), "class_id long, v array<double>, cell int, far double"), "homes")
        reach, blocks = np.zeros(count), np.ones(count)
        for r in homes.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
            reach[r["cell"]], blocks[r["cell"]] = r["far"], -(-r["n"] // BLOCK)
        # Distances from pivots come from a matrix product: they are off by so much at most.
        off = 8e-11 * most
        ring = np.maximum(np.maximum(radius, reach / blocks), 1e-5 * most**0.5 + 1e-300)
        shared = spark.sparkContext.broadcast((pivots.value, reach, ring, radius + 4 * off**0.5, off))
        placed = s.write(homes.mapInArrow(_visits(shared), "class_id long, v array<double>, cell int, ring long, visitor boolean"), "placed")
        held = placed.groupBy("cell", "ring").agg(F.count(F.when(~F.col("visitor"), 1)).alias("r"), F.count(F.when(F.col("visitor"), 1)).alias("g")).where("r > 0")
        held = s.write(held, "held")
        compared = held.agg(F.sum(F.expr("r * (r - 1) div 2 + r * g"))).first()[0]
        parts = F.ceil(F.col("r") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("r")) / VISITORS)).cast("int").alias("turns")
        met = placed.join(held.select("cell", "ring", *parts), ["cell", "ring"])
        hashed = F.xxhash64("class_id")
        met = met.withColumns({"own": F.pmod(hashed, F.col("blocks")).cast("int"), "turn": F.pmod(F.shiftright(hashed, 20), F.col("turns")).cast("int")})
        here = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.struct(F.col("own").alias("block"), t.alias("turn"), F.lit(False).alias("visitor")))
        later = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("visitor") | (b > F.col("own")))
        there = F.transform(later, lambda b: F.struct(b.alias("block"), F.col("turn").alias("turn"), F.lit(True).alias("visitor")))
        dealt = met.select("class_id", "v", "cell", "ring", F.explode(F.when(F.col("visitor"), there).otherwise(F.concat(here, there))).alias("to"))
        dealt = dealt.select("cell", "ring", "to.block", "to.turn", "to.visitor", "class_id", "v")
        at = ["cell", "ring", "block", "turn"]
        pairs = dealt.repartition(*at).sortWithinPartitions(*at, "visitor").mapInArrow(_compare(radius * radius), "vec_id long, other_id long, dist double")
        return Within(materialize(pairs, "pairs"), members, compared, n)


def _pivots(pivots: np.ndarray, probes: np.ndarray, n: int, radius: float) -> int:
    """How many of the pivots to use, by the visits that the probes would make."""
    if len(probes) < 2:
        return len(pivots)
    d = np.sqrt(np.maximum(between("l2", probes, pivots)[0], 0))
    best, least = len(pivots), np.inf
    count = len(pivots)
    while count:
        some = d[:, :count]
        home = some.argmin(1)
        far = some[np.arange(len(d)), home]
        reach = np.zeros(count)
        np.maximum.at(reach, home, far)
        apart = np.sqrt(np.maximum(between("l2", pivots[:count], pivots[:count])[0], 0))
        met = (some - reach[None] <= radius) & (some**2 - (far**2)[:, None] <= 2 * apart[home] * radius)
        visits = met.sum(1).mean() / 2  # one of two cells visits the other, or itself
        sent = 1 + visits * max(1, n / count / BLOCK)
        work = SENDING * sent + visits * n / count
        if work < least:
            best, least = count, work
        count //= 4
    return best


def _step(others: np.ndarray) -> int:
    """Rows whose distances from all ``others`` are VALUES at most."""
    return max(1, min(ROWS, VALUES // max(1, len(others))))


def _homes(pivots):
    """Each vector's nearest pivot and about its distance."""

    def run(batches):
        step = _step(pivots.value)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.select(["class_id", "v"]).slice(at, step)
                m = matrix(part.column("v"), "l2")
                if m.shape[1] != pivots.value.shape[1]:
                    raise ValueError(f"vectors have {m.shape[1]} and {pivots.value.shape[1]} components; all must have the same number")
                d = np.maximum(between("l2", m, pivots.value)[0], 0)
                cell = d.argmin(1)
                far = np.sqrt(d[np.arange(len(d)), cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["class_id", "v", "cell", "far"])

    return run


def _visits(shared):
    """Each vector as a resident of its ring and as a visitor of every ring where others may be within the radius."""

    def run(batches):
        pivots, reach, ring, radius, off = shared.value
        apart = np.sqrt(np.maximum(between("l2", pivots, pivots)[0], 0))
        numbers, step = np.arange(len(pivots)), _step(pivots)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                home, far = part.column(2).to_numpy(), part.column(3).to_numpy()
                d2 = np.maximum(between("l2", matrix(part.column(1), "l2"), pivots)[0], 0)
                d = np.sqrt(d2)
                turn = (numbers[None] > home[:, None]) == ((numbers[None] + home[:, None]) % 2 == 0)
                open_ = turn & (numbers[None] != home[:, None]) & (d - reach[None] <= radius)
                open_ &= d2 - (far**2)[:, None] - off <= 2 * apart[home] * radius
                x, c = np.nonzero(open_)
                first = np.maximum(0, np.floor((d[x, c] - radius) / ring[c])).astype(np.int64)
                last = np.floor(np.minimum(d[x, c] + radius, reach[c]) / ring[c]).astype(np.int64)
                own = np.floor(far / ring[home]).astype(np.int64)
                # At home only the rings farther out; those within come the other way.
                x, c = np.concatenate((x, np.arange(len(home)))), np.concatenate((c, home))
                first = np.concatenate((first, own + 1))
                last = np.concatenate((last, np.floor(np.minimum(far + radius, reach[home]) / ring[home]).astype(np.int64)))
                n = np.maximum(0, last - first + 1)
                to = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.concatenate((np.arange(len(home)), np.repeat(x, n)))
                cell = np.concatenate((home, np.repeat(c, n))).astype(np.int32)
                rings = np.concatenate((own, to))
                guest = np.arange(len(row)) >= len(home)
                for i in range(0, len(row), ROWS):
                    j = slice(i, i + ROWS)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row[j])) for k in (0, 1)), pa.array(cell[j]), pa.array(rings[j]), pa.array(guest[j])], names=["class_id", "v", "cell", "ring", "visitor"])

    return run


def _compare(most: float):
    """Pairs within reach, from rows in order of their groups in which residents come before visitors."""

    def pairs(a_ids, a, b_ids, b, own: bool):
        for at in range(0, len(a), step := _step(b)):
            about, off = between("l2", a[at : at + step], b)
            x, y = np.nonzero(about <= (most + 2 * off)[:, None])
            x += at
            if own:
                x, y = x[x < y], y[x < y]
            for i in range(0, len(x), PAIRS):
                p, q = x[i : i + PAIRS], y[i : i + PAIRS]
                d = pairwise("l2", a[p], b[q])
                near = d <= most
                one, other = a_ids[p[near]], b_ids[q[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(d[near])], names=["vec_id", "other_id", "dist"])

    def run(batches):
        now, ids, rows, turn = None, [], [], 0

        def residents():
            nonlocal ids, rows
            if len(ids) > 1:
                ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
            return ids, rows

        def among():
            if ids and turn == 0:  # every turn has the residents; the first compares them with each other
                i, m = (x[0] for x in residents())
                for at in range(0, len(i), ROWS):
                    yield from pairs(i[at : at + ROWS], m[at : at + ROWS], i[at : at + ROWS], m[at : at + ROWS], True)
                    for to in range(at + ROWS, len(i), ROWS):
                        yield from pairs(i[at : at + ROWS], m[at : at + ROWS], i[to : to + ROWS], m[to : to + ROWS], False)

        for b in batches:
            group = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], 1)
            edge = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1), [True])))
            for start, stop in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                at, guest = tuple(group[start, :4].tolist()), bool(group[start, 4])
                if at != now:
                    yield from among()
                    now, ids, rows, turn = at, [], [], at[3]
                for i in range(start, stop, ROWS):
                    part = b.slice(i, min(ROWS, stop - i))
                    key, m = part.column(5).to_numpy(), matrix(part.column(6), "l2")
                    if not guest:
                        ids.append(key)
                        rows.append(m)
                    elif ids:
                        own_ids, own = (x[0] for x in residents())
                        for j in range(0, len(own), ROWS):
                            yield from pairs(key, m, own_ids[j : j + ROWS], own[j : j + ROWS], False)
        yield from among()

    return run
