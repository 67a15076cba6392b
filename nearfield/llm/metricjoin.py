"""Exact near-duplicates of vectors: a metric range join within groups of one label.

Vectors of one direction and length apart by a cosine of at least ``t`` are unit vectors at most ``eps = sqrt(2 - 2t)``
apart, and that distance is a metric. Pivots cut each label into balls: a vector's home is its nearest pivot, near it
(``eps / 2``) the pivot's core, else its shell. By the triangle inequality

* a vector meets a ball only if it is no farther from its pivot than the ball's radius and eps, no nearer than its inner
  radius less eps, and no more than eps behind the plane between the two pivots: it is sent there as a visitor;
* a ball that lies within eps of a vector as a whole is linked with it unseen, and so is a core with itself, which
  settles large groups of near copies by counts;
* balls are in an order, and only the lower one's vectors visit.

A ball of many vectors is split into cells of bounded size, which visit each other, and visitors of a cell are dealt out
over tasks, each with the cell's own vectors. Equal vectors are one class with a weight. Every link is counted at both
ends, and only those that connect what was not connected in the same task are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, map_batches, materialize
from nearfield.llm.components import components

#: Bytes (as doubles) of a cell's own vectors, cells of visitors to a task, bytes of all pivots, sampled vectors a pivot.
CELL_BYTES, VISITORS, PIVOT_BYTES, SAMPLE = 4 << 20, 8, 8 << 20, 4
#: Values of a block of cosines, rows of a table that is sent to all executors, and more than the rounding of a distance.
BLOCK_VALUES, SENT_ROWS, SLACK = 1 << 20, 1 << 18, 1e-9


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices, row by row; the same wherever a pair meets."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def away(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ v.T)))


# --- pivots and balls ----------------------------------------------------------------------------


def pivots_of(sample: np.ndarray, most: int, eps: float) -> np.ndarray:
    """At most ``most`` directions more than eps apart, each moved to the middle of the sample near it."""
    u = unit(sample)
    free, picked = np.ones(len(u), bool), []
    while len(picked) < most and free.any():
        i = int(free.argmax())
        picked.append(i)
        free &= away(u, u[i : i + 1])[:, 0] > eps
    p = u[picked]
    for _ in range(2):
        d = away(u, p)
        near = d.argmin(1)
        inside = np.flatnonzero(d[np.arange(len(u)), near] <= eps)
        middle = np.zeros_like(p)
        np.add.at(middle, near[inside], u[inside])
        some = np.sqrt((middle * middle).sum(1)) > 0.5
        p[some] = unit(middle[some])
    return p


class Balls:
    """Pivots by group, and of the two balls of each, core and shell, what is known of their members."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.first, n = {}, 0
        for g, p in pivots.items():
            self.first[g] = n
            n += 2 * len(p)
        self.n = n
        self.count, self.visits = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.weight, self.least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.outer, self.inner = np.full(n, -np.inf), np.full(n, np.inf)

    def home(self, g: int, u: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """Ball and distance from its pivot."""
        d = away(u, self.pivots[g])
        near = d.argmin(1)
        d = d[np.arange(len(u)), near]
        return self.first[g] + 2 * near + (d > eps / 2 - SLACK), d

    def meets(self, g: int, u: np.ndarray, ball: np.ndarray, own: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """Two matrices, rows by later balls of the group: those to visit, and those within eps as a whole."""
        p, at = self.pivots[g], self.first[g]
        mine = slice(at, at + 2 * len(p))
        later = (np.arange(at, at + 2 * len(p)) > ball[:, None]) & (self.count[mine] > 0)
        d = away(u, p)
        d2 = np.repeat(d, 2, axis=1)
        within = later & (d2 + self.outer[mine] <= eps - SLACK)
        plane = np.repeat(d * d - (own * own)[:, None] <= 2 * eps * away(p, p)[(ball - at) // 2] + SLACK, 2, axis=1)
        near = (d2 - self.outer[mine] <= eps + SLACK) & (d2 + eps + SLACK >= self.inner[mine]) & plane
        return later & near & ~within, within


# --- cells ---------------------------------------------------------------------------------------


class Cell:
    """The vectors of a cell, which meet each other and visitors; collects links (c, n, to)."""

    def __init__(self, c: np.ndarray, w: np.ndarray, x: np.ndarray, t: float):
        self.c, self.w, self.x, self.t, self.u = c, w, x, t, unit(x)
        self.root, self.n = np.arange(len(c)), np.zeros(len(c), np.int64)
        self.out: list[tuple[int, int, int]] = []

    def among(self) -> None:
        step = max(1, BLOCK_VALUES // max(1, len(self.c)))
        for i in range(0, len(self.c), step):
            hit = self._hits(self.x[i : i + step], self.u[i : i + step])
            hit &= np.arange(len(self.c)) > np.arange(i, i + len(hit))[:, None]
            self._take(self.c[i : i + step], self.w[i : i + step], hit, i)

    def visited(self, c: np.ndarray, w: np.ndarray, x: np.ndarray) -> None:
        step = max(1, BLOCK_VALUES // max(1, len(self.c)))
        for i in range(0, len(c), step):
            self._take(c[i : i + step], w[i : i + step], self._hits(x[i : i + step], unit(x[i : i + step])), None)

    def _hits(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        s = u @ self.u.T
        hit = s >= self.t
        a, b = np.nonzero(np.abs(s - self.t) <= SLACK)
        if len(a):  # so near that rounding could decide: by the one formula
            hit[a, b] = cosine(x[a], self.x[b]) >= self.t
        return hit

    def _take(self, c: np.ndarray, w: np.ndarray, hit: np.ndarray, at: int | None) -> None:
        self.n += w @ hit
        n = hit @ self.w
        for r in np.flatnonzero(n).tolist():
            to = np.flatnonzero(hit[r])
            if at is not None:
                to = np.append(to, at + r)
            roots, first = np.unique(self.root[to], return_index=True)
            self.out += [(int(c[r]), int(n[r]) if k == 0 else 0, int(self.c[to[f]])) for k, f in enumerate(first.tolist())]
            for root in roots[1:].tolist():
                self.root[self.root == root] = roots[0]

    def links(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.n)
        c, n, to = (np.array(x, np.int64) for x in zip(*self.out, strict=True)) if self.out else (np.zeros(0, np.int64),) * 3
        to = pa.array(np.append(to, np.zeros(len(some), np.int64)), mask=np.append(np.zeros(len(c), bool), np.ones(len(some), bool)))
        return pa.RecordBatch.from_arrays([pa.array(np.append(c, self.c[some])), pa.array(np.append(n, self.n[some])), to], names=["c", "n", "to"])


_LINKS = "c long, n long, to long"


def _cells(batches, t: float):
    """Links of rows (g, ball, cell, turn, visits, inside, c, w, v) sorted by the first five; a cell's own rows come before its visitors."""
    key, own, held = None, None, []

    def opened() -> Cell:
        rows = pa.Table.from_batches(held).combine_chunks()
        cell = Cell(rows["c"].to_numpy(), rows["w"].to_numpy(), _matrix(rows["v"].chunk(0)), t)
        if rows["inside"][0].as_py():
            cell.among()
        return cell

    for b in batches:
        keys = np.stack([b.column(k).to_numpy() for k in range(5)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            at, visits = tuple(keys[:4, i].tolist()), keys[4, i]
            if at != key:
                if held or own:
                    yield (own or opened()).links()
                key, own, held = at, None, []
            part = b.slice(i, j - i)
            if not visits:
                held.append(part)
                continue
            if held:
                own, held = opened(), []
            if own:  # a cell without vectors of its own has nothing to visit
                own.visited(part.column(6).to_numpy(), part.column(7).to_numpy(), _matrix(part.column(8)))
    if held or own:
        yield (own or opened()).links()


# --- the join ------------------------------------------------------------------------------------


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, v, g, d1, d2, fit): g tells labels and lengths apart, d1 and d2 are a digest of the vector; ``fit`` rows can link."""
    x = F.col(vector)
    fit = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))) & F.exists(x, lambda c: c != 0)
    g = F.concat(F.size(x).cast("string"), F.lit(" "), F.col(label).cast("string"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("v"), g.alias("g"), F.coalesce(fit, F.lit(False)).alias("fit"))
    return rows.withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(31), "v", F.lit(17))})


def _groups(classes: DataFrame, s: Scratch) -> DataFrame:
    """(g, gid, n, cells, pivots): labels with their classes, cells where they have no pivots, and pivots: a quarter of the root of n.

    Pivots of all labels hold PIVOT_BYTES; where there are too many labels for that the largest have pivots, by powers of two.
    """
    groups = classes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"))
    want = F.least(F.ceil(F.sqrt("n") / 4), F.greatest(F.lit(1), F.floor(F.lit(PIVOT_BYTES) / (8 * F.col("dim"))))).cast("long")
    groups = s.write(groups.withColumns({"gid": F.monotonically_increasing_id(), "pivots": want, "size": F.floor(F.log2("n")).cast("int")}), "groups")
    room, least = PIVOT_BYTES, 0
    for r in sorted(groups.groupBy("size").agg(F.sum(F.col("pivots") * F.col("dim") * 8).alias("b")).collect(), reverse=True):
        room -= r["b"]
        if room < 0:
            least = r["size"] + 1
            break
    cells = F.ceil(F.col("n") * F.col("dim") * 8 / CELL_BYTES).cast("long")
    return groups.select("g", "gid", "n", cells.alias("cells"), F.when(F.col("size") >= least, F.col("pivots")).otherwise(0).alias("pivots"))


def _by_group(gid: np.ndarray):
    order = np.argsort(gid, kind="stable")
    ids, start = np.unique(gid[order], return_index=True)
    return zip(ids.tolist(), np.split(order, start[1:]) if len(ids) else [], strict=True)


def _homes(classes: DataFrame, balls: Balls, eps: float) -> DataFrame:
    """Add ball (-1 where a label has no pivots) and distance ``d`` from its pivot."""
    shared = classes.sparkSession.sparkContext.broadcast(balls)

    def make():
        def run(b: pa.RecordBatch):
            ball, d = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            for g, rows in _by_group(b.column("gid").to_numpy()):
                if g in shared.value.pivots:
                    ball[rows], d[rows] = shared.value.home(g, unit(_matrix(b.column("v").take(pa.array(rows)))), eps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), pa.array(d)], names=[*b.schema.names, "ball", "d"])

        return run

    return map_batches(classes, make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", ball long, d double")


def _described(homes: DataFrame, balls: Balls) -> Balls:
    """Count, weight, radii and least member of each ball: as many rows as there are balls."""
    stats = homes.where("ball >= 0").groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("c").alias("c"), F.max("d").alias("far"), F.min("d").alias("near"))
    for r in stats.collect():
        i = r["ball"]
        balls.count[i], balls.weight[i], balls.least[i], balls.outer[i], balls.inner[i] = r["n"], r["w"], r["c"], r["far"], r["near"]
    return balls


def _settled(homes: DataFrame, balls: Balls, eps: float, s: Scratch) -> tuple[list[DataFrame], dict[int, int]]:
    """Links that need no comparison, and the number of visitors of each ball.

    A core's members are linked with each other, a vector with all members of a ball within eps.
    """
    shared = homes.sparkSession.sparkContext.broadcast(balls)

    def run(batches):
        b_, visits = shared.value, np.zeros(balls.n, np.int64)
        weight, least = np.zeros(balls.n, np.int64), np.full(balls.n, np.iinfo(np.int64).max)
        for b in batches:
            c, w, ball, d = (b.column(k).to_numpy() for k in ("c", "w", "ball", "d"))
            for g, rows in _by_group(b.column("gid").to_numpy()):
                if g not in b_.pivots:
                    continue
                mine = slice(b_.first[g], b_.first[g] + 2 * len(b_.pivots[g]))
                visit, within = b_.meets(g, unit(_matrix(b.column("v").take(pa.array(rows)))), ball[rows], d[rows], eps)
                visits[mine] += visit.sum(0)
                r, j = np.nonzero(within)
                np.add.at(weight, mine.start + j, w[rows[r]])
                np.minimum.at(least, mine.start + j, c[rows[r]])
                core = rows[ball[rows] % 2 == 0]
                one = [np.append(c[rows[r]], c[core]), np.append(b_.weight[mine.start + j], b_.weight[ball[core]] - w[core]), np.append(b_.least[mine.start + j], b_.least[ball[core]])]
                yield _settled_rows(np.full(len(one[0]), -1, np.int64), *one, np.zeros(len(one[0]), np.int64))
        some = np.flatnonzero(visits + weight)
        yield _settled_rows(some, least[some], weight[some], np.zeros(len(some), np.int64), visits[some])

    rows = s.write(homes.select("gid", "c", "w", "ball", "d", "v").where("ball >= 0").mapInArrow(run, "ball long, c long, n long, to long, visits long"), "settled")
    own = rows.where("ball = -1").select("c", "n", "to")
    met = rows.where("ball >= 0").groupBy("ball").agg(F.min("c").alias("to"), F.sum("n").alias("n"), F.sum("visits").alias("visits"))
    met = s.write(met, "met")  # one row for each ball at most
    back = homes.select("c", "ball").join(F.broadcast(met.where("n > 0").drop("visits")), "ball").select("c", "n", "to")
    return [own, back], {r["ball"]: r["visits"] for r in met.select("ball", "visits").collect()}


def _settled_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ball", "c", "n", "to", "visits"])


def _dealt(homes: DataFrame, balls: Balls, cell_rows: int, eps: float) -> DataFrame:
    """Rows of cells (g, ball, cell, turn, visits, inside, c, w, v): each vector in its own cell and wherever it visits.

    A ball has a cell for every ``cell_rows`` of its vectors; one with many visitors has them in turns, each a task's
    work with the cell's own vectors. Vectors of a cell visit the later cells of their ball, but for a core's.
    """
    shared = homes.sparkSession.sparkContext.broadcast(balls)
    names = ["g", "ball", "cell", "turn", "visits", "inside", "c", "w", "v"]

    def make():
        b_ = shared.value
        n_cells = -(-np.maximum(b_.count, 1) // cell_rows)
        n_turns = np.maximum(1, -(-(b_.visits + (np.arange(b_.n) % 2) * b_.count) // (VISITORS * cell_rows)))

        def run(b: pa.RecordBatch):
            gid, c, ball, d, n = (b.column(k).to_numpy() for k in ("gid", "c", "ball", "d", "n"))
            h = (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
            alone = ball < 0
            cells = np.where(alone, -(-n // cell_rows), n_cells[ball] if b_.n else 1)
            turns = np.where(alone, np.maximum(1, -(-n // (VISITORS * cell_rows))), n_turns[ball] if b_.n else 1)
            cell, pick = h % cells, h // cells
            core = ~alone & (ball % 2 == 0)
            row = np.arange(b.num_rows)
            # Own vectors, in every turn; only in the first they meet each other.
            rep = np.repeat(row, turns)
            turn = np.arange(len(rep)) - np.repeat(np.cumsum(turns) - turns, turns)
            yield from rows_of(b, gid, rep, ball[rep], cell[rep], turn, 0, (turn == 0) & ~core[rep])
            # Later cells of the same ball.
            left = np.where(core, 0, cells - 1 - cell)
            rep = np.repeat(row, left)
            later = cell[rep] + 1 + np.arange(len(rep)) - np.repeat(np.cumsum(left) - left, left)
            yield from rows_of(b, gid, rep, ball[rep], later, pick[rep] % turns[rep], 1, np.zeros(len(rep), bool))
            # Later balls.
            for g, rows in _by_group(gid):
                if g not in b_.pivots:
                    continue
                visit, _ = b_.meets(g, unit(_matrix(b.column("v").take(pa.array(rows)))), ball[rows], d[rows], eps)
                r, j = np.nonzero(visit)
                to, rep = b_.first[g] + j, rows[r]
                to, rep = np.repeat(to, n_cells[to]), np.repeat(rep, n_cells[to])
                size = n_cells[b_.first[g] + j]
                at = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
                yield from rows_of(b, gid, rep, to, at, pick[rep] % n_turns[to], 1, np.zeros(len(rep), bool))

        def rows_of(b, gid, rep, to, cell, turn, visits, inside):
            for i in range(0, len(rep), 4096):
                k = slice(i, i + 4096)
                at = pa.array(rep[k])
                yield pa.RecordBatch.from_arrays([pa.array(gid[rep[k]]), pa.array(to[k]), pa.array(cell[k]), pa.array(turn[k]), pa.array(np.full(len(at), visits, np.int64)), pa.array(inside[k]), b.column("c").take(at), b.column("w").take(at), b.column("v").take(at)], names=names)

        return run

    v = homes.schema["v"].dataType.simpleString()
    return map_batches(homes.select("gid", "n", "c", "w", "ball", "d", "v"), make, f"g long, ball long, cell long, turn long, visits long, inside boolean, c long, w long, v {v}")


def linked(classes: DataFrame, t: float, s: Scratch) -> DataFrame:
    """(c, n, to) of classes (c, g, w, v): n is the weight of vectors linked with c, ``to`` one of them or null.

    A class has several rows, whose n add up; the links (c, to) connect all that links connect.
    """
    eps = float(np.sqrt(2 - 2 * t))
    groups = _groups(classes, s)
    classes = s.write(classes.join(_sent(groups), "g").select("c", "gid", "n", "cells", "pivots", "w", "v"), "grouped")
    picked = classes.where(F.pmod(F.xxhash64("c", F.lit(3)), F.col("n")) < SAMPLE * F.col("pivots")).select("gid", "pivots", "v").toArrow().combine_chunks()
    pivots = {}
    if picked.num_rows:
        for g, rows in _by_group(picked["gid"].to_numpy()):
            part = picked.take(pa.array(rows)).combine_chunks()
            pivots[g] = pivots_of(_matrix(part["v"].chunk(0)), part["pivots"][0].as_py(), eps)
    balls = Balls(pivots)
    homes = s.write(_homes(classes.drop("cells", "pivots"), balls, eps), "homes")
    _described(homes, balls)
    settled, visits = _settled(homes, balls, eps, s)
    for ball, n in visits.items():
        balls.visits[ball] = n
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    keys = ["g", "ball", "cell", "turn"]
    dealt = _dealt(homes, balls, max(1, CELL_BYTES // (8 * width)), eps)
    met = dealt.repartition(*keys).sortWithinPartitions(*keys, "visits").mapInArrow(lambda batches: _cells(batches, t), _LINKS)
    return s.write(met.unionByName(settled[0]).unionByName(settled[1]), "links")


def near_duplicates(vectors: DataFrame, cosine_at_least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null, their vectors are as long as each other and the cosine in doubles
    is at least ``cosine_at_least`` (over -1). Rows without a key, label or vector, with a null or non-finite component
    or all zeros link with nothing. n_links counts the other rows linked; component_id is the least key reached through
    links, kept whether that is the row's own (true without a key). Repeated rows are rows each for itself and link with
    each other; rows of one key with different vectors are one vertex. An empty table has no rows; other columns are left out.
    """
    with Scratch(vectors.sparkSession, "metricjoin") as s:
        rows = usable(vectors, key, vector, label)
        digests = s.write(rows.drop("v"), "rows")
        inside = digests.where("fit")
        classes = rows.where("fit").groupBy("g", "d1", "d2").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
        classes = s.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
        found = linked(classes.select("c", "g", "w", "v"), cosine_at_least, s)
        n = s.write(found.groupBy("c").agg(F.sum("n").alias("n")), "counts")
        edges = found.where("to IS NOT NULL").select(F.col("c").alias("a"), F.col("to").alias("b"))
        repeated = inside.groupBy("vec_id").agg(F.count(F.lit(1)).alias("r")).where("r > 1").select("vec_id")
        names = classes.select("g", "d1", "d2", "c")
        if not repeated.isEmpty():
            same = inside.join(repeated, "vec_id").join(names, ["g", "d1", "d2"]).select("vec_id", "c").distinct()
            edges = edges.unionByName(same.join(same.groupBy("vec_id").agg(F.min("c").alias("b")), "vec_id").select(F.col("c").alias("a"), "b"))
        root = components(edges, s).withColumnRenamed("v", "c")
        least = root.join(classes.select("c", "least"), "c").groupBy("component").agg(F.min("least").alias("component_id"))
        known = classes.select("g", "d1", "d2", "c", "w", "least").join(n, "c", "left").join(root.join(least, "component"), "c", "left")
        known = known.where("w > 1 OR n > 0 OR component_id IS NOT NULL")
        known = s.write(known.select("g", "d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
        of_rows = inside.join(_sent(known), ["g", "d1", "d2"], "left").unionByName(digests.where("NOT fit"), allowMissingColumns=True)
        component = F.coalesce("component_id", "vec_id")
        out = of_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
        return materialize(out, "near")
