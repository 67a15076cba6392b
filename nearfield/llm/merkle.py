"""A Merkle manifest of a table: a tree for each group, a tree over their roots, a proof for each row.

Leaves are numbered in each group; number / fanout^k is a leaf's superblock. ``applyInPandas`` collapses k levels of a
superblock to one node; these nodes are numbered already and are collapsed in the same way until each group has a single
one. From the top down each node's proof is that within its superblock, then that of the superblock; only at the bottom,
where a proof is a row's own, is it hashed and folded at once and never written.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, materialize

#: Rows of a range in which leaves are numbered, the fewest and most ranges, and rows of a table that is sent to all executors.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SENT_ROWS = 1 << 17, 16, 1 << 16, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass
class Block:
    """Some nodes in a row, which begin a run, and the levels above them up to ``levels`` or to a single node."""

    rows: list[list[str]]
    fanout: int

    @classmethod
    def of(cls, nodes: list[str], fanout: int, levels: int) -> Block:
        rows = [nodes]
        for _ in range(levels):
            low = rows[-1]
            rows.append([h(*low[i : i + fanout]) for i in range(0, len(low), fanout)])
        return cls(rows, fanout)

    def proof(self, at: int) -> list[tuple[str, str]]:
        """For each level what stands left and right of the node's way up in its run."""
        out = []
        for row in self.rows[:-1]:
            first = at - at % self.fanout
            out.append(("".join(row[first:at]), "".join(row[at + 1 : first + self.fanout])))
            at //= self.fanout
        return out


def fold(node: str, proof: list[tuple[str, str]]) -> str:
    for left, right in proof:
        node = h(left, node, right)
    return node


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


_NODE = "g string, at long, n long, node string"
_PROOF = "g string, at long, proof array<struct<l:string,r:string>>"


def _up(nodes: DataFrame, fanout: int, k: int) -> DataFrame:
    """The nodes k levels above, at most to a single one."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        n = int(part["n"].iat[0])
        block = Block.of(part["node"].tolist(), fanout, min(k, height(n, fanout)))
        return pd.DataFrame({"g": [part["g"].iat[0]], "at": [int(part["at"].iat[0]) // fanout**k], "n": [-(-n // fanout**k)], "node": [block.rows[-1][0]]})

    return nodes.withColumn("block", F.expr(f"at div {fanout**k}")).groupBy("g", "block").applyInPandas(run, _NODE)


def _down(nodes: DataFrame, above: DataFrame | None, fanout: int, k: int) -> DataFrame:
    """(g, at, proof) of nodes, whose superblocks have the proofs ``above``; without any, they are single ones."""

    def run(part: pd.DataFrame, upper: list) -> pd.DataFrame:
        part = part.sort_values("at")
        block = Block.of(part["node"].tolist(), fanout, min(k, height(int(part["n"].iat[0]), fanout)))
        proofs = [[{"l": a, "r": b} for a, b in block.proof(i)] + upper for i in range(len(part))]
        return pd.DataFrame({"g": part["g"].tolist(), "at": part["at"].tolist(), "proof": proofs})

    own = nodes.withColumn("block", F.expr(f"at div {fanout**k}"))
    if above is None:
        return own.groupBy("g", "block").applyInPandas(lambda p: run(p, []), _PROOF)
    return own.groupBy("g", "block").cogroup(above.groupBy("g", "at")).applyInPandas(lambda p, u: run(p, [{"l": x["l"], "r": x["r"]} for x in u["proof"].iat[0]]), _PROOF)


def _tree(leaves: DataFrame, fanout: int, k: int, s: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes from the superblocks of ``leaves`` (g, at, n, node) up, and the last one: a root for each g."""
    levels, most = [], leaves.agg(F.max("n")).first()[0] or 0
    below, n = leaves, most
    while True:
        below, n = s.write(_up(below, fanout, k), "nodes"), -(-n // fanout**k)
        levels.append(below)
        if n <= 1:
            return levels, below


def _proofs(levels: list[DataFrame], fanout: int, k: int, above: DataFrame, s: Scratch) -> DataFrame:
    """Proofs of the first of ``levels``; ``above`` has those of the last one's."""
    for nodes in reversed(levels[:-1]):
        above = s.write(_down(nodes, above, fanout, k), "proofs")
    return above


def numbered(leaves: DataFrame, s: Scratch) -> DataFrame:
    """Add ``at``, a leaf's number in its group, and ``n``, their count, to leaves (g, key, node, ...) in order of (g, key, node).

    Rows are dealt out by Spark's own ranges over (g, key, node, row), so equal keys are split as well; each range is
    sorted, and the ranges' counts, a row for each range and group, give the numbers at which they begin.
    """
    rows = s.write(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")  # texts are read once
    order = ["g", F.asc_nulls_first("key"), "node", "row"]
    parts = min(MOST_RANGES, max(LEAST_RANGES, rows.count() // RANGE_ROWS))
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ranges = s.write(ranges.withColumns({"part": F.shiftright("id", 33).cast("int"), "id": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("row"), "ranges")
    counts = ranges.groupBy("g", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = s.write(counts.select("g", "part", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("g")).alias("n")), "starts")
    both = ranges.join(_sent(starts), ["g", "part"])
    return both.withColumn("at", F.col("before") + F.col("id") - F.col("first")).drop("part", "id", "first", "before")


def _sent(df: DataFrame) -> DataFrame:
    """``df`` for a join, sent to all executors if it has few rows."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def manifest(leaves: DataFrame, fanout: int = 8, k: int = 4) -> DataFrame:
    """(key, node, subroot, root, proof_sha256, folded_root, verified) of leaves (g string, key, node, offered).

    ``node`` is a leaf's digest. ``offered`` is the digest that is put to the test: it is folded up along the leaf's
    proof, and verified says whether that ends at the root. Leaves of a group stand in order of key (null first), equal keys by digest; repeated rows
    are leaves each for itself. Groups stand in order of g: null first, then bytewise. The proof's digest is that of all
    siblings, level by level and left to right; a single leaf in a single group has none and is its own root. An empty
    table has no rows.
    """
    with Scratch(leaves.sparkSession, "merkle") as s:
        # A null group comes first, and no key of a join is null.
        own = numbered(leaves.withColumn("g", F.coalesce(F.concat(F.lit("+"), "g"), F.lit(""))), s)
        levels, subroots = _tree(own.select("g", "at", "n", "node"), fanout, k, s)
        # The subroots are the leaves of one more tree, whose rows are in order of g.
        top = subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "node")
        top = s.write(numbered(top, s), "top")
        top_levels, root = _tree(top.select("g", "at", "n", "node"), fanout, k, s)
        none = F.array().cast("array<struct<l:string,r:string>>")
        above = _proofs(top_levels, fanout, k, root.select("g", "at", none.alias("proof")), s)
        of_top = s.write(_down(top.select("g", "at", "n", "node"), above, fanout, k), "proofs")
        of_group = top.select(F.col("key").alias("g"), F.col("node").alias("subroot"), "at").join(of_top.drop("g"), "at")
        of_group = s.write(of_group.select("g", F.lit(0).cast("long").alias("at"), "subroot", "proof"), "subroots")
        upper = s.write(_proofs(levels, fanout, k, of_group.select("g", "at", "proof"), s), "upper")
        top_root = root.first()
        return materialize(_rows(own, upper, of_group, top_root["node"] if top_root else "", fanout, k), "manifest")


def _rows(own: DataFrame, upper: DataFrame, of_group: DataFrame, root: str, fanout: int, k: int) -> DataFrame:
    key = own.schema["key"].dataType.simpleString()
    schema = f"g string, key {key}, node string, proof_sha256 string, folded_root string"

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        upper = [(x["l"], x["r"]) for x in above["proof"].iat[0]]
        nodes = part["node"].tolist()
        block = Block.of(nodes, fanout, min(k, height(int(part["n"].iat[0]), fanout)))
        tail, digests, folded = "".join(a + b for a, b in upper), [], []
        for i, offered in enumerate(part["offered"].tolist()):
            lower = block.proof(i)
            digests.append(h(*[a + b for a, b in lower], tail))
            folded.append(fold(offered, lower + upper))
        return pd.DataFrame({"g": part["g"], "key": part["key"], "node": part["node"], "proof_sha256": digests, "folded_root": folded})

    mine = own.withColumn("block", F.expr(f"at div {fanout**k}")).groupBy("g", "block")
    rows = mine.cogroup(upper.groupBy("g", "at")).applyInPandas(run, schema)
    rows = rows.join(_sent(of_group.select("g", "subroot")), "g")
    return rows.select("key", "node", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_manifest(docs: DataFrame, fanout: int = 8, k: int = 4) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, by lang.

    The leaf offered is the document's own, but where 3 divides the crc32 of its doc_id its text has A-Z in lower case.
    A null doc_id has no crc and is offered as it is. Nulls in any column are a ``-`` of the leaf; other columns take no part.
    """
    small = F.translate("text", UPPER, LOWER)
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    own = leaf(fields(F.col("text")))
    leaves = docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("key"), own.alias("node"), F.when(tampered, leaf(fields(small))).otherwise(own).alias("offered"))
    return manifest(leaves, fanout, k).select(F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")
