"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Documents with one shingle set form a class, known by a number of its own and standing for all its rows. A class has
TOKENS minwise tokens of one byte. In each of several independent trees the classes go down from the root: every node
chooses BRANCHES of the minwise functions, and a class moves to the child that its own token names under each. Two sets
of similarity s part at a choice with probability 1 - s, so a pair at 0.8 stays together down a tree with probability
0.94 or more, at any depth. A node of NODE classes at most is compared exhaustively by its tokens; a larger one branches
on. A node whose members are mostly like its first one would not be parted by branching and is compared at once.

The first level is dealt out over tasks; a task goes down its own nodes in memory. Nodes too large for one task branch
before they are dealt out, and if their members are alike, those nearest to the first one need go no further: whatever
is similar to them has tokens in common with the first one as well.

What looks similar is a candidate only: candidates are gathered into clusters, and links are confirmed on full sets
within each cluster, where pairs that are connected already are passed over. Every link therefore needs no more than one
common node in any tree. A cluster too large for one task is first met with a few of its own members; what these
connect needs no more comparison with itself, only with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, map_batches, materialize, mix, shingle_sets, utf8
from nearfield.llm.components import components

#: Minwise functions, trees, and choices of a node.
TOKENS, TREES, BRANCHES = 64, 4, 2
#: Classes of a node compared exhaustively, of a node that one task takes, and the deepest level.
NODE, TASK_NODE, DEEPEST = 16, 32_768, 24
#: How far below the threshold an estimate may be: five standard deviations of TOKENS draws.
SLACK = 5.0
#: Shingles of the sets, and sets, that one task compares at once.
CLUSTER_SHINGLES, CLUSTER = 4 << 20, 1024
#: Rounds in which a large cluster is met with some of its members, how many of them, and bytes of theirs sent to all.
PIVOT_ROUNDS, PIVOTS, PIVOT_BYTES = 4, 8, 64 << 20
#: Members of clusters that are sent to all executors (some 50 bytes each); beyond, texts are dealt out to meet them.
BROADCAST_MEMBERS = 500_000
#: Pairs of tokens that are compared at once, and rows of nodes that a task goes down with at once.
PAIRS, ROWS = 1 << 15, 1 << 18

_A = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, TOKENS, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """A byte of the minimum of each function over a set that isn't empty."""
    out = np.full(TOKENS, ~np.uint64(0))
    for i in range(0, len(shingles), 4096):
        np.minimum(out, (_A[:, None] * shingles[None, i : i + 4096]).min(1), out=out)
    return (mix(out) >> np.uint64(56)).astype(np.uint8)


def children(tokens: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For members (rows of ``tokens``) of ``nodes``, their nodes one level below, n x BRANCHES."""
    row, out = np.arange(len(tokens)), []
    first = mix(nodes) % np.uint64(TOKENS)
    for k in range(BRANCHES):
        c = first if k == 0 else (first + np.uint64(1) + mix(nodes + np.uint64(k)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
        out.append(mix(nodes * _ODD + (c << np.uint64(32) | tokens[row, c.astype(np.intp)].astype(np.uint64))))
    return np.stack(out, 1)


def first_nodes(tokens: np.ndarray) -> np.ndarray:
    """The nodes under the roots of all trees, n x (TREES * BRANCHES)."""
    roots = mix(np.arange(1, TREES + 1, dtype=np.uint64) * _ODD)
    return np.concatenate([children(tokens, np.full(len(tokens), r)) for r in roots], 1)


def _least_matches(percent: int) -> int:
    j = percent / 100
    return max(1, int(np.floor(TOKENS * (j - SLACK * np.sqrt(j * (1 - j) / TOKENS)))))


def _sized(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be so similar."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _matches(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens the members ``a`` and ``b`` have in common, pair by pair."""
    out = np.empty(len(a), np.uint8)
    for i in range(0, len(a), PAIRS):
        j = i + PAIRS
        out[i:j] = (tokens[a[i:j]] == tokens[b[i:j]]).sum(1, dtype=np.uint8)
    return out


def stars(own: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what looks similar among the members ``own``.

    From each member the others that have no component yet are looked at, so members all alike take one look each.
    """
    least, free = _least_matches(percent), own
    while len(free):
        todo, free = [free[0]], free[1:]
        while len(free) and todo:
            x = todo.pop()
            near = ((tokens[free] == tokens[x]).sum(1, dtype=np.uint8) >= least) & _sized(sizes[free], sizes[x], percent)
            if near.any():
                yield free[near], np.full(int(near.sum()), x)
                todo += free[near].tolist()
                free = free[~near]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))[: len(x)]
    return start, np.diff(np.append(start, len(x)))


def links_below(nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int, level: int = 1) -> np.ndarray:
    """Pairs (2 x m) of members that look similar in some node at or below ``nodes``, a node for each row.

    The nodes of a level are handled together, ROWS of them or one node at a time, the deepest first.
    """
    least, found = _least_matches(percent), [np.zeros((2, 0), np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        fit = _sized(sizes[a], sizes[b], percent)
        a, b = a[fit], b[fit]
        near = _matches(tokens, a, b) >= least
        found.append(np.stack([a[near], b[near]]))

    work = [(*_ordered(nodes, np.arange(len(nodes))), level)]
    while work:
        nodes, member, level = work.pop()
        start, size = _runs(nodes)
        of = np.repeat(np.arange(len(start)), size)
        end, at = (start + size)[of], np.flatnonzero((size <= NODE)[of])
        for d in range(1, NODE):  # each with the one after it in its node, with the next but one and so on
            at = at[at + d < end[at]]
            if not len(at):
                break
            keep(member[at], member[at + d])
        large = size > NODE
        if not large.any():
            continue
        at = np.flatnonzero(large[of])
        m = np.bincount(of[at], weights=_matches(tokens, member[at], member[start[of[at]]]), minlength=len(size))
        alike = large & ((2 * m >= size * TOKENS) | (level >= DEEPEST))
        for s, n in zip(start[alike].tolist(), size[alike].tolist(), strict=True):
            found += [np.stack(x) for x in stars(member[s : s + n], sizes, tokens, percent)]
        at = np.flatnonzero((large & ~alike)[of])
        below = children(tokens[member[at]], nodes[at])
        nodes, member = _ordered(below.ravel(), np.repeat(member[at], BRANCHES))
        cuts, start = [0], _runs(nodes)[0]
        while cuts[-1] < len(nodes):
            upto = int(np.searchsorted(start, cuts[-1] + ROWS, "right")) - 1
            nth = int(np.searchsorted(start, cuts[-1]))
            cuts.append(int(start[max(upto, nth + 1)]) if max(upto, nth + 1) < len(start) and cuts[-1] + ROWS < len(nodes) else len(nodes))
        work += [(nodes[x:y], member[x:y], level + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate(found, 1)


def _ordered(nodes: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order with their members, each once in a node; what is alone in its node goes."""
    order = np.lexsort((member, nodes))
    nodes, member = nodes[order], member[order]
    once = np.concatenate(([True], (nodes[1:] != nodes[:-1]) | (member[1:] != member[:-1])))[: len(nodes)]
    nodes, member = nodes[once], member[once]
    same = nodes[1:] == nodes[:-1]
    shared = np.concatenate((same, [False]))[: len(nodes)] | np.concatenate(([False], same))[: len(nodes)]
    return nodes[shared], member[shared]


def _features(docs: DataFrame, words: int) -> DataFrame:
    """Per row with shingles or without: doc_id, n, two halves of the set's digest, and its tokens."""

    def make():
        def run(b: pa.RecordBatch):
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                sets = shingle_sets(utf8(part.column(1)), words)
                d = np.array([_digest(s) if len(s) else (0, 0) for s in sets], np.uint64).view(np.int64)
                tokens = [minwise(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(tokens, pa.binary())], names=["doc_id", "n", "d1", "d2", "tokens"])

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n long, d1 long, d2 long, tokens binary")


def _digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(shingles).sum(dtype=np.uint64), mix(shingles ^ _ODD).sum(dtype=np.uint64)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), TOKENS)


_ROW = "node long, c long, n long, tokens binary"


def _nodes(rows: DataFrame, below) -> DataFrame:
    """Rows (node, c, n, tokens) of the nodes that ``below(tokens, nodes)`` gives for rows (c, n, tokens, node or null)."""

    def make():
        def run(b: pa.RecordBatch):
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                nodes = below(_tokens(part.column(2)), part.column(3))
                again = np.repeat(np.arange(len(nodes)), nodes.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), *[part.column(k).take(pa.array(again)) for k in range(3)]], names=["node", "c", "n", "tokens"])

        return run

    return map_batches(rows, make, _ROW)


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first ``n_keys`` long columns as one batch for each run of whole keys: the last key of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(n_keys)])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != keys[k, 0] for k in range(n_keys)):
            cut = np.append(0, cut)
        if len(cut):
            if held or cut[-1]:
                yield _whole([*held, b.slice(0, int(cut[-1]))])
            held = [b.slice(int(cut[-1]))]
        else:
            held.append(b)
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _compare(rows: DataFrame, percent: int, level: int, keys: list[str]) -> DataFrame:
    """Rows of whole nodes to links, nodes dealt out by ``keys``."""
    n = len(keys)

    def run(batches):
        for b in _grouped(batches, n):
            key = np.stack([b.column(k).to_numpy().view(np.uint64) for k in range(n)])
            node = key[0] if n == 1 else mix(mix(mix(key[0]) + key[1]) + key[2])
            c = b.column(n).to_numpy()
            a, z = links_below(node, b.column(n + 1).to_numpy(), _tokens(b.column(n + 2)), percent, level)
            pair = np.unique(np.sort(np.stack([c[a], c[z]]), axis=0), axis=1)
            if pair.size:
                yield pa.RecordBatch.from_arrays([pa.array(pair[1]), pa.array(pair[0])], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "c", "n", "tokens").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, block, blocks) -> DataFrame:
    """Each row goes to all pairs of blocks that hold its own: (i, j), i <= j; of one block that is (0, 0)."""
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    return rows.select("*", block.alias("own"), other).withColumns({"i": F.least("own", "other").cast("long"), "j": F.greatest("own", "other").cast("long")}).drop("own", "other")


def _candidates(classes: DataFrame, percent: int, s: Scratch) -> DataFrame:
    """Links between classes that look similar in some node of some tree."""
    rows = _nodes(classes.select("c", "n", "tokens", F.lit(None).cast("long").alias("node")), lambda tokens, _: first_nodes(tokens))
    found, level, many = [], 1, classes.count() > TASK_NODE  # no node has more members than there are classes
    while many:
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("c").alias("first"))
        large = s.write(counts.where(F.col("members") > TASK_NODE), "large")
        if large.isEmpty():
            break
        found.append(_compare(rows.join(_sent(large.select("node")), "node", "left_anti"), percent, level, ["node"]))
        met = s.write(_met(rows, large, classes), "met")
        alike = met.groupBy("node").agg((2 * F.avg("m") >= (TOKENS if level < DEEPEST else 0)).alias("alike"))
        met = met.join(_sent(s.write(alike, "alike")), "node")
        found += _alike(met.where("alike"), classes, percent, s)
        level += 1
        below = _nodes(met.where("NOT alike").select("c", "n", "tokens", "node"), lambda tokens, node: children(tokens, node.to_numpy().view(np.uint64)))
        rows = s.write(below, "rows")
    return _union([s.write(f, "candidates") for f in [*found, _compare(rows, percent, level, ["node"])]])


def _sent(df: DataFrame) -> DataFrame:
    """``df`` for a join, sent to all executors if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS else df


def _met(rows: DataFrame, first: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the nodes in ``first`` (node, first), with ``m``, the tokens that they share with the first member."""

    def make():
        def run(b: pa.RecordBatch):
            m = (_tokens(b.column(3)) == _tokens(b.column(5))).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(m, pa.int64())], names=["node", "c", "n", "tokens", "first", "m"])

        return run

    tokens = classes.select(F.col("c").alias("first"), F.col("tokens").alias("t1")).join(_sent(first.select("first", "node")), "first")
    return map_batches(rows.join(_sent(tokens), "node").select("node", "c", "n", "tokens", "first", "t1"), make, _ROW + ", first long, m long")


def _alike(met: DataFrame, classes: DataFrame, percent: int, s: Scratch) -> list[DataFrame]:
    """Links within large nodes whose members are much alike.

    Members near the first one need no more than a link with it: what looks similar to them shares so many tokens with
    the first one, too, that it has a link of its own. The rest have a new first one, PIVOT_ROUNDS times; what is left
    then is compared block by block.
    """
    found = []
    if met.isEmpty():
        return found
    # Unlike tokens of two steps add up: those of the two that look similar, and those of one and the first.
    near = percent * TOKENS // 100
    loose = max(1, near + _least_matches(percent) - TOKENS)
    for r in range(PIVOT_ROUNDS):
        linked = met.where((F.col("m") >= loose) & (F.col("c") != F.col("first")))
        found.append(linked.select(F.greatest("c", "first").alias("a"), F.least("c", "first").alias("b")))
        rest = s.write(met.where(F.col("m") < near).select("node", "c", "n", "tokens"), "rest")
        if rest.isEmpty():
            return found
        if r + 1 < PIVOT_ROUNDS:
            met = s.write(_met(rest, rest.groupBy("node").agg(F.min("c").alias("first")), classes), "met")
    blocks = rest.groupBy("node").agg(F.ceil(F.count(F.lit(1)) * 2 / TASK_NODE).cast("int").alias("blocks"))
    rest = rest.join(_sent(s.write(blocks, "blocks")), "node")
    found.append(_compare(_blocks(rest, F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"), F.col("blocks")), percent, DEEPEST, ["node", "i", "j"]))
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out, *rest = frames
    for f in rest:
        out = out.unionByName(f)
    return out


def confirmed(ids: np.ndarray, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs whose full sets are similar.

    All pairs are looked at but those of sizes or minwise tokens too far apart and those connected already; members
    marked by ``joined`` are connected from the start.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = ids[order], [sets[i] for i in order]
    n, least = np.array([len(s) for s in sets]), _least_matches(percent)
    tokens = np.stack([minwise(s) for s in sets]) if len(ids) > NODE else None
    label, out = np.arange(len(ids)), []
    if joined is not None:
        label[joined[order]] = len(ids)
    for i in range(len(ids)):
        upto = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        j = i + 1 + np.flatnonzero(label[i + 1 : upto] != label[i])
        if tokens is not None and len(j):
            j = j[(tokens[j] == tokens[i]).sum(1) >= least]
        for k in j.tolist():
            if label[k] != label[i] and _linked(sets[i], sets[k], percent):
                label[label == label[k]] = label[i]
                out.append((int(ids[i]), int(ids[k])))
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _pairs(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        x = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x.max(1)), pa.array(x.min(1))], names=["a", "b"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _confirm(docs: DataFrame, classes: DataFrame, candidates: DataFrame, words: int, percent: int, s: Scratch) -> list[DataFrame]:
    """Links (a, b of classes) confirmed on full sets, which are made anew for one row of each class in a cluster."""
    cluster = components(candidates, s).withColumnRenamed("v", "c").join(classes.drop("tokens"), "c")
    cluster = s.write(cluster, "clusters")
    size = cluster.groupBy("component").agg(((F.count(F.lit(1)) > CLUSTER) | (F.sum("n") > CLUSTER_SHINGLES)).alias("large"))
    member = s.write(cluster.join(size, "component").select(F.col("v").alias("doc_id"), "component", "c", "large", "d1", "d2"), "members")
    text = docs.select("doc_id", "text").join(_sent(member), "doc_id")

    def make():
        def run(b: pa.RecordBatch):
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sets = shingle_sets(utf8(part.column(4)), words)
                # Of rows of one doc_id those count that have the class's text.
                own = np.array([_digest(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                own = (own[:, 0] == part.column(2).to_numpy()) & (own[:, 1] == part.column(3).to_numpy())
                part, at = part.filter(pa.array(own)), np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sets[k].tobytes() for k in at], pa.binary())], names=["component", "c", "shingles"])

        return run

    def of(large: bool) -> DataFrame:
        own = text.where("large" if large else "NOT large")
        return map_batches(own.select("component", "c", "d1", "d2", "text"), make, "component long, c long, shingles binary")

    def compare(batches):
        for g in _grouped(batches, 1):
            start, size = _runs(g.column(0).to_numpy())
            for i, n in zip(start.tolist(), size.tolist(), strict=True):
                yield from _pairs(_confirmed_once(g.slice(i, n), percent))

    small = of(False).repartition("component").sortWithinPartitions("component").mapInArrow(compare, "a long, b long")
    if member.where("large").isEmpty():
        return [small]
    return [small, *_confirm_large(s.write(of(True).dropDuplicates(["c"]), "sets"), percent, s)]


def _confirmed_once(rows: pa.RecordBatch, percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Of rows (component, c, shingles), where a class may come twice if its row does."""
    c, at = np.unique(rows.column(1).to_numpy(), return_index=True)
    sets = _sets(rows.column(2).take(pa.array(at)))
    return confirmed(c, sets, percent, None if joined is None else joined[at])


def _confirm_large(sets: DataFrame, percent: int, s: Scratch) -> list[DataFrame]:
    """Links within large clusters (component, c, shingles).

    Those that one member connects are kin and need no comparison with each other. In PIVOT_ROUNDS the rest meet some of
    the kin; whoever links becomes kin. Then the rest, in blocks, meet each other and all kin.
    """

    def meet(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, p = part.column(0).to_pylist(), part.column(2).to_pylist()
                rows = zip(x, _sets(part.column(1)), p, _sets(part.column(3)), strict=True)
                yield from _pairs([(c, q) for c, a, q, z in rows if c != q and _linked(a, z, percent)])

    links, rest, kin = [], sets, None
    for r in range(PIVOT_ROUNDS):
        if kin is None:
            pivots = sets.groupBy("component").agg(F.min("c").alias("pivot"))
        else:
            turn = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("c", F.lit(r))))
            pivots = kin.withColumn("turn", turn).where(F.col("turn") <= PIVOTS).select("component", F.col("c").alias("pivot"))
        pivots = s.write(pivots.join(sets.select(F.col("c").alias("pivot"), F.col("shingles").alias("other")), "pivot"), "pivots")
        few = (pivots.agg(F.sum(F.octet_length("other")).alias("b")).first()["b"] or 0) <= PIVOT_BYTES
        met = rest.join(F.broadcast(pivots) if few else pivots, "component").select("c", "shingles", "pivot", "other")
        links.append(s.write(met.mapInArrow(meet, "a long, b long"), "met"))
        ends = links[-1].select(F.col("a").alias("c")).unionByName(links[-1].select(F.col("b").alias("c"))).unionByName(pivots.select(F.col("pivot").alias("c")))
        kin = s.write(sets.select("component", "c").join(ends.distinct(), "c"), "kin") if kin is None else s.write(kin.unionByName(rest.select("component", "c").join(ends.distinct(), "c")), "kin")
        rest = s.write(rest.join(kin.select("c"), "c", "left_anti"), "rest")
        if rest.isEmpty():
            return links
    half = lambda: F.ceil(F.greatest(F.count(F.lit(1)) * 2 / CLUSTER, F.sum(F.octet_length("shingles")) / (4 * CLUSTER_SHINGLES))).cast("int")
    rest_blocks, kin = rest.groupBy("component").agg(half().alias("rest")), sets.join(kin.select("c"), "c")
    blocks = s.write(rest_blocks.join(kin.groupBy("component").agg(half().alias("kin")), "component"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    to = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    of_rest = F.concat(each("rest", lambda o: to(F.least(o, F.col("own")), F.greatest(o, F.col("own")))), each("kin", lambda o: to(F.col("own"), F.col("rest") + o)))
    of_kin = each("rest", lambda o: to(o, F.col("rest") + F.col("own")))
    dealt = [
        rows.join(_sent(blocks), "component").withColumn("own", own(n)).select("component", "c", "shingles", F.lit(n == "kin").alias("joined"), F.explode(where).alias("x")).select("component", "x.i", "x.j", "c", "joined", "shingles")
        for rows, n, where in ((rest, "rest", of_rest), (kin, "kin", of_kin))
    ]

    def compare(batches):
        for g in _grouped(batches, 3):
            key = np.stack([g.column(k).to_numpy() for k in range(3)])
            start, size = _runs(mix(mix(mix(key[0].view(np.uint64)) + key[1].view(np.uint64)) + key[2].view(np.uint64)))
            for i, n in zip(start.tolist(), size.tolist(), strict=True):
                part = g.slice(i, n)
                yield from _pairs(_confirmed_once(part.select(["component", "c", "shingles"]), percent, part.column(4).to_numpy(zero_copy_only=False)))

    keys = ["component", "i", "j"]
    return [*links, _union(dealt).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A set holds the distinct shingles of ``words`` words (runs without ASCII white space, A-Z in lower case); a text
    with fewer words has its whole sequence as one shingle; null texts and texts without words have an empty set and
    link with nothing. Sets link at ``percent`` of Jaccard similarity, in integers. component_id is the least doc_id
    reached, kept whether that is the row's own. Repeated rows of one doc_id are one vertex, whatever their texts, and
    keep their rows; a null doc_id links with nothing. An empty table gives no rows; other columns are left out.
    """
    with Scratch(docs.sparkSession, "neardup") as s:
        rows = s.write(_features(docs, words), "features")
        inside = rows.where("n > 0 AND doc_id IS NOT NULL")
        classes = inside.groupBy("d1", "d2").agg(F.min("doc_id").alias("v"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        classes = s.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
        links = [s.write(x, "links") for x in _confirm(docs, classes, _candidates(classes, percent, s), words, percent, s)]
        texts = inside.groupBy("doc_id").agg(F.count(F.lit(1)).alias("r")).where("r > 1").select("doc_id")
        if not texts.isEmpty():  # rows of one doc_id with different texts are in classes of their own, joined by that doc_id
            same = inside.join(texts, "doc_id").join(classes.select("d1", "d2", "c"), ["d1", "d2"]).select("doc_id", "c").distinct()
            links.append(same.join(same.groupBy("doc_id").agg(F.min("c").alias("b")), "doc_id").select(F.col("c").alias("a"), "b"))
        root = components(_union(links), s).withColumnRenamed("v", "c")
        least = root.join(classes.select("c", "v"), "c").groupBy("component").agg(F.min("v").alias("component_id"))
        of_class = classes.select("d1", "d2", "v", "c").join(root.join(least, "component"), "c", "left").select("d1", "d2", F.coalesce("component_id", "v").alias("component_id"))
        linked = inside.join(of_class, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return materialize(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the least of their near copies.

    Of repeated rows of one doc_id a single one stays; rows without a doc_id stay.
    """
    found = near_duplicates(docs, words, percent)
    out = docs
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("r")).where("r > 1").isEmpty():
        out = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))
    return out.join(_sent(found.where("NOT kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
