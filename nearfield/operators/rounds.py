"""Graph search over one graph of any size, in rounds of joins.

Each query's search is a row: its frontier, its best so far, what it has visited. A round joins the vertices that the
queries want to expand with the edges, leaves out what a query has visited (an anti-join), joins the rest with the
vectors, and brings neighbours and distances back to the queries, whose searches go on until they want a vertex that is
not there yet. The steps of a search are those of the one in memory, one vertex after the other, so the rows found are
the same; as a query asks for the next few of its frontier at once, a round takes it several steps on.

Edges and vectors are written once, in buckets of the key by which they are joined: a round shuffles what the queries
ask for and not the index. Where the shared folder has files that tasks map, the vectors are in those, and only ids are
shuffled. What a round explodes looks as small as the table it comes from, so all its joins are merges: none is sent.
"""

from __future__ import annotations

import uuid
from bisect import insort
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import distance, to_rows
from nearfield.operators.mapped import Mapped, _places, mapped
from nearfield.shared import Scratch, materialize

#: Vertices that a query asks for in a round, queries of a task's group, bytes of a bucket of the index.
AHEAD, GROUP, BUCKET_BYTES = 8, 64, 64 << 20
#: Greedy walks that meet the neighbours of one vertex together, give or take a hash's unevenness.
WALKS = 4096


class Search:
    """The state of one query's search."""

    def __init__(self, o, front, top, met, stops=0, expanded=0, ready=None):
        self.o, self.front, self.top, self.met, self.stops, self.expanded = o, front, top, met, stops, expanded
        self.ready = ready or {}  # vertex: (neighbours in order of rank, distances, nan where visited for good)

    def go(self) -> int | None:
        """Expand until a vertex is wanted that is not ready, and return it; None at the end."""
        o = self.o
        while self.front:
            d, x = self.front[0]
            if len(self.top) == o.pq and (self.top[-1][0] <= d if o.bounded else self.top[-1][0] < d):
                self.front.pop(0) if o.bounded else heappop(self.front)
                if o.forget:
                    self.met.discard(x)
                self.stops += 1
                if self.stops >= o.finish or not o.bounded:
                    self.front = []
                continue
            if x not in self.ready:
                return x
            # Where visits are forgotten, the last of the best is visited no more as soon as x comes in.
            gone = max(self.top[-1], (d, x))[1] if o.forget and len(self.top) == o.pq else None
            near: list[tuple[float, int]] = []
            fresh: set[int] = set()
            for y, e in zip(*self.ready[x], strict=True):
                if y in self.met and y != gone or y in fresh:
                    continue
                near.append((e, y))
                if not o.on_insert:
                    fresh.add(y)
            self._step(d, x, near)
            del self.ready[x]
        return None

    def _step(self, d: float, x: int, near: list[tuple[float, int]]) -> None:
        o = self.o
        self.front.pop(0) if o.bounded else heappop(self.front)
        insort(self.top, (d, x))
        if o.forget:
            self.met.add(x)
        if len(self.top) > o.pq:
            gone = self.top.pop()[1]
            if o.forget:
                self.met.discard(gone)
        self.expanded += 1
        if not o.on_insert:
            self.met.update(y for _, y in near)
        for item in near:
            if not o.bounded:
                if o.on_insert:
                    self.met.add(item[1])
                heappush(self.front, item)
                continue
            if len(self.front) >= o.pq and self.front[-1][0] < item[0]:
                continue
            insort(self.front, item)
            if o.on_insert:
                self.met.add(item[1])
            if len(self.front) > o.pq:
                gone = self.front.pop()[1]
                if o.forget:
                    self.met.discard(gone)

    def wanted(self, first: int, most: int) -> list[int]:
        """The vertex that is wanted and the nearest of the frontier after it."""
        return [first, *[y for _, y in sorted(self.front) if y != first and y not in self.ready]][:most]


def _state_type(kind: str) -> str:
    return f"part int, query_id long, v array<{kind}>, fd array<double>, fy array<long>, td array<double>, tx array<long>, met array<long>, stops int, n_expanded long, rs array<long>, rn array<int>, ry array<long>, rd array<double>, ask array<long>"


def _lists(rows: list, kind) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _rows_of(keys, vectors: pa.Array, searches: list[Search], asks: list[list[int]], part) -> pa.Table:
    pairs = lambda x, k: [[p[k] for p in own] for own in x]
    fronts, tops = [s.front for s in searches], [s.top for s in searches]
    ready = [list(s.ready.items()) for s in searches]
    i64, f64 = pa.int64(), pa.float64()
    return pa.table({
        "part": pa.array(part, pa.int32()), "query_id": pa.array(keys, i64), "v": vectors, "fd": _lists(pairs(fronts, 0), f64), "fy": _lists(pairs(fronts, 1), i64), "td": _lists(pairs(tops, 0), f64), "tx": _lists(pairs(tops, 1), i64),
        "met": _lists([list(s.met) for s in searches], i64), "stops": pa.array([s.stops for s in searches], pa.int32()), "n_expanded": pa.array([s.expanded for s in searches], i64),
        "rs": _lists([[x for x, _ in r] for r in ready], i64), "rn": _lists([[len(y) for _, (y, _) in r] for r in ready], pa.int32()), "ry": _lists([[y for _, (ys, _) in r for y in ys] for r in ready], i64), "rd": _lists([[float(d) for _, (_, ds) in r for d in ds] for r in ready], f64),
        "ask": _lists(asks, i64),
    })


def _searches(state: pa.Table, o) -> list[Search]:
    out = []
    for r in state.select(["fd", "fy", "td", "tx", "met", "stops", "n_expanded", "rs", "rn", "ry", "rd"]).to_pylist():
        ready, at = {}, 0
        for x, n in zip(r["rs"], r["rn"], strict=True):
            ready[x], at = (r["ry"][at : at + n], r["rd"][at : at + n]), at + n
        out.append(Search(o, list(zip(r["fd"], r["fy"], strict=True)), list(zip(r["td"], r["tx"], strict=True)), set(r["met"]), r["stops"], r["n_expanded"], ready))
    return out


def _vectors(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _further(o, kind, ahead: int, index: Mapped | None):
    """Take the searches of a part on with what came back: rows (query_id, src, pos, to, dst, w), a vertex's neighbours with
    pos -1, those not visited with their places, and their vectors if these are not mapped."""

    def run(left, right):
        state, came = left.combine_chunks(), right.combine_chunks()
        if not state.num_rows:
            return state
        keys = state["query_id"].to_numpy()
        place = {k: i for i, k in enumerate(keys.tolist())}
        searches = _searches(state, o)
        if came.num_rows:
            at = came["pos"].to_numpy() < 0
            whole, near = came.filter(pa.array(at)), came.filter(pa.array(~at)).combine_chunks()
            if index:
                ids, rows = index.rows()
                places, there = _places(ids, near["dst"].to_numpy())
                near, places = near.filter(pa.array(there)), places[there]
            for q, x, to in zip(whole["query_id"].to_pylist(), whole["src"].to_pylist(), whole["to"].to_pylist(), strict=True):
                searches[place[q]].ready[x] = (to, [float("nan")] * len(to))
            if near.num_rows:
                own, v = _vectors(state["v"].chunk(0), kind), rows[places] if index else _vectors(near["w"].combine_chunks(), kind)
                by_key = np.argsort(keys, kind="stable")
                of = by_key[np.searchsorted(keys, near["query_id"].to_numpy(), sorter=by_key)]
                order = np.argsort(of, kind="stable")
                src, pos, cut = near["src"].to_numpy()[order].tolist(), near["pos"].to_numpy()[order].tolist(), np.flatnonzero(np.diff(of[order], prepend=-1))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                    i = int(of[order[a]])
                    for k, d in zip(range(a, b), to_rows(o.metric, own[i], v[order[a:b]]).tolist(), strict=True):
                        searches[i].ready[src[k]][1][pos[k]] = d
            for q, x in zip(whole["query_id"].to_pylist(), whole["src"].to_pylist(), strict=True):
                # What was visited has its distance in the frontier or among the best, unless it is visited for good; a
                # neighbour that is neither visited nor among the vectors is none.
                s = searches[place[q]]
                known = {y: d for d, y in (*s.front, *s.top)}
                kept = [(y, d if d == d else known.get(y, d)) for y, d in zip(*s.ready[x], strict=True) if d == d or y in s.met]
                s.ready[x] = [y for y, _ in kept], [d for _, d in kept]
        asks = [[] if (x := s.go()) is None else s.wanted(x, ahead) for s in searches]
        return _rows_of(keys, state["v"].chunk(0), searches, asks, state["part"].to_numpy())

    return run


class Index:
    """Edges and vectors in buckets, for as long as searches need them.

    A vertex is a row of ``to``, its neighbours in order of rank; vertices without edges have none.
    """

    def __init__(self, vectors: DataFrame, edges: DataFrame, scratch: Scratch, only_edges: bool = False):
        spark = vectors.sparkSession
        self.names = [f"nearfield_{uuid.uuid4().hex}" for _ in range(2)]
        size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
        n = max(2, min(4096, -(-(size["n"] or 0) * (size["w"] or 1) * 8 // BUCKET_BYTES)))
        ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"])
        self.to = self._bucketed(edges.groupBy("src").agg(ranked.alias("to")), "src", n, self.names[0], scratch, spark)
        self.vectors = None if only_edges else self._bucketed(vectors.select(F.col("key").alias("dst"), F.col("v").alias("w")), "dst", n, self.names[1], scratch, spark)

    @staticmethod
    def _bucketed(df: DataFrame, key: str, n: int, name: str, scratch: Scratch, spark) -> DataFrame:
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{scratch.path}/{name}").saveAsTable(name)
        return spark.table(name)

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.to.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def search_rounds(asked: DataFrame, vectors: DataFrame, edges: DataFrame, o, ahead: int = AHEAD) -> DataFrame:
    """(query_id, vec_id, dist, n_expanded) of prepared queries and vectors (key, v) and edges (src, rank, dst).

    For exact visited sets and one vertex expanded at a time. The rows are those of the search in memory. Each round is
    written, so a lost executor costs a part of one; queries that are done leave the rounds.
    """
    if o.visited != "exact" or o.probes > 1:
        raise ValueError("a graph over the size that is searched in memory has exact visited sets and one probe")
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    found = F.explode(F.arrays_zip(F.col("tx").alias("vec_id"), F.col("td").alias("dist"))).alias("x")
    files = mapped(vectors)
    further = _further(o, np.int64 if kind == "bigint" else np.float64, ahead, files)
    with Scratch(vectors.sparkSession, "rounds") as s, Index(vectors, edges, s, files is not None) as index:
        state, done = s.next(_started(asked, vectors, o.metric, kind), "state"), []
        while True:
            done.append(s.write(state.where(F.size("ask") == 0).select("query_id", "n_expanded", found).select("query_id", "x.vec_id", "x.dist", "n_expanded"), "found"))
            state = state.where(F.size("ask") > 0)
            wanted = state.select("part", "query_id", F.explode("ask").alias("src"))
            if wanted.isEmpty():
                return materialize(_union(done), "rounds")
            met = s.next(wanted.join(index.to.hint("merge"), "src", "left").withColumn("to", F.coalesce("to", F.array().cast("array<long>"))), "wanted")
            known = state.select("query_id", F.explode("met").alias("dst"))
            each = met.select("part", "query_id", "src", F.posexplode("to").alias("pos", "dst"))
            # What is known, and what is met, is exploded from a table that may look small enough to be sent; it is not.
            new, none = each.join(known.hint("merge"), ["query_id", "dst"], "left_anti"), F.lit(None).cast(f"array<{kind}>").alias("w")
            new = new.withColumn("w", none) if files else new.join(index.vectors.hint("merge"), "dst")
            came = met.select("part", "query_id", "src", F.lit(-1).alias("pos"), "to", F.lit(None).cast("long").alias("dst"), none)
            came = came.unionByName(new.select("part", "query_id", "src", "pos", F.lit(None).cast("array<long>").alias("to"), "dst", "w"))
            state = s.next(state.groupBy("part").cogroup(came.groupBy("part")).applyInArrow(further, _state_type(kind)), "state")


def _union(frames: list[DataFrame]) -> DataFrame:
    every, *more = frames
    for f in more:
        every = every.unionByName(f)
    return every


def _started(asked: DataFrame, vectors: DataFrame, metric: str, kind: str) -> DataFrame:
    """Every query at the first vertex, the one of the least id."""
    first = vectors.orderBy("key").limit(1).collect()
    parts = max(1, -(-asked.count() // GROUP))
    none = lambda t: F.array().cast(f"array<{t}>")
    start = F.array(F.lit(first[0]["key"])) if first else none("long")
    empty = {c: none(t).alias(c) for c, t in (("td", "double"), ("tx", "long"), ("rs", "long"), ("rn", "int"), ("ry", "long"), ("rd", "double"))}
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    dim = np.array(first[0]["v"]) if first else None

    def far(batches):  # by the kernel that all other distances come from
        for b in batches:
            if b.num_rows:
                d = [to_rows(metric, q, dim[None].astype(q.dtype)) for q in _vectors(b.column(1), np.int64 if kind == "bigint" else np.float64)] if first else [[]] * b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, _lists([list(map(float, x)) for x in d], pa.float64())], names=["key", "v", "fd"])

    asked = asked.select("key", "v").mapInArrow(far, f"key long, v array<{kind}>, fd array<double>")
    return asked.select(part, F.col("key").alias("query_id"), "v", "fd", start.alias("fy"), empty["td"], empty["tx"], start.alias("met"), F.lit(0).alias("stops"), F.lit(0).cast("long").alias("n_expanded"), *[empty[c] for c in ("rs", "rn", "ry", "rd")], start.alias("ask"))


def walk_rounds(asked: DataFrame, vectors: DataFrame, edges: DataFrame, metric: str) -> DataFrame:
    """(query_id, vec_id, dist, n_expanded) of greedy walks: each round every walk that still moves meets its vertex's neighbours.

    Vectors of walks and of neighbours meet in one join; only the nearest of a task goes on to the walk.
    """
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    with Scratch(vectors.sparkSession, "walks") as s, Index(vectors, edges, s) as index:
        started = _started(asked, vectors, metric, kind).where(F.size("fy") > 0)
        at = s.next(started.select("query_id", "v", F.col("fy")[0].alias("vec_id"), F.col("fd")[0].alias("dist"), F.lit(0).cast("long").alias("n_expanded")), "walks")
        turns = max(1, -(-at.count() // WALKS))
        ended = [s.write(at.limit(0).drop("v"), "ended")]
        while not at.isEmpty():
            # Many walks may be at one vertex, all are at first: they meet its neighbours in turns, each of a bounded number.
            here = at.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)))
            to = here.select("vec_id", "turn").distinct().join(index.to.withColumnRenamed("src", "vec_id"), "vec_id").select("vec_id", "turn", F.posexplode("to").alias("pos", "dst"))
            near = here.join(to.join(index.vectors, "dst"), ["vec_id", "turn"])
            best = near.withColumn("d", distance(metric, "v", "w").cast("double")).groupBy("query_id").agg(F.min_by(F.struct("dst", "d"), F.struct("d", "pos")).alias("to"))
            both = s.next(at.join(best, "query_id", "left").withColumn("moves", F.coalesce(F.col("to.d") < F.col("dist"), F.lit(False))), "moves")
            ended.append(s.write(both.where("NOT moves").select("query_id", "vec_id", "dist", "n_expanded"), "ended"))
            at = s.next(both.where("moves").select("query_id", "v", F.col("to.dst").alias("vec_id"), F.col("to.d").alias("dist"), (F.col("n_expanded") + 1).alias("n_expanded")), "walks")
        return materialize(_union(ended), "walks")
