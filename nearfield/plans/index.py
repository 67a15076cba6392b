"""An index over vectors: build, search, save, load."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.distance import checked
from nearfield.functions.hashing import codes
from nearfield.operators import graph, route
from nearfield.operators.knn import knn, ranked
from nearfield.operators.search import Options, bounded, greedy_walk, search, unbounded
from nearfield.shared import materialize
from nearfield.sources.vectors import read_raw_graph, read_raw_vectors

#: Bytes of vectors and edges that a shard should hold where the number of shards is not given.
SHARD_BYTES = 64 << 20


@dataclass
class VectorIndex:
    """Vectors (vec_id, embedding, shard), edges and the metric that both building and searching use.

    With ``bits`` the index is over hyperplane codes of so many bits and the metric is hamming: vectors and queries are
    coded on the way in.
    """

    vectors: DataFrame
    edges: DataFrame
    metric: str
    shards: int = 1
    bits: int | None = None
    routes: route.Routes | None = None

    @classmethod
    def build(cls, vectors: DataFrame, metric: str = "l2", degree: int = graph.DEGREE, budget: int = graph.BUDGET, shards: int | None = None, bulk: bool = False, bits: int | None = None, descent: bool = False) -> VectorIndex:
        """Vertex by vertex within each shard, with ``bulk`` from exact neighbours in each, or with ``descent`` one graph of any
        size from neighbours found by descent, in which every vertex is reached from the first one.

        Without ``shards`` there are as many as hold SHARD_BYTES each.
        """
        checked(metric)
        if (metric == "hamming") != bool(bits):
            raise ValueError("an index of codes has the metric hamming and a number of bits, others have neither")
        vectors = _coded(vectors.select("vec_id", "embedding"), bits)
        if descent:
            if (shards or 1) > 1 or bulk:
                raise ValueError("a graph by descent has no shards and is not of exact neighbours")
            edges = graph.bridged(vectors, graph.build_descent(vectors, metric, degree), metric, degree)
            return cls(vectors.withColumn("shard", F.lit(0)), edges.withColumn("shard", F.lit(0)), metric, 1, bits)
        if shards is None:
            size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("w")).first()
            shards = max(1, -(-(size["n"] or 0) * ((size["w"] or 1) * 8 + (2 * degree + 1) * 16) // SHARD_BYTES))
        own = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
        edges = graph.build_bulk_shards(vectors, metric, degree, shards) if bulk else graph.build_sequential(vectors, metric, degree, budget, shards)
        return cls(own, materialize(edges, "edges"), metric, shards, bits)

    @classmethod
    def routed(cls, vectors: DataFrame, centroids: int, capacity: int, metric: str = "l2", degree: int = graph.DEGREE, budget: int = graph.BUDGET) -> VectorIndex:
        """An index in shards of near vectors, none of more than ``capacity``; ``search_batch`` sends a query to the shards of
        the ``visit`` nearest of so many centroids. The routes are not saved with the index."""
        own, routes = route.deal(vectors, centroids, capacity, metric)
        own = materialize(own, "vectors")
        edges = graph.build_sequential(own, metric, degree, budget, shard="shard")
        return cls(own, materialize(edges, "edges"), metric, int(routes.count.sum()), None, routes)

    @classmethod
    def from_raw(cls, spark: SparkSession, data: str, edges: str, dim: int, metric: str = "l2") -> VectorIndex:
        """An index of a user's own raw files: ``data`` of n x dim float32, ``edges`` of 32 ids of eight bytes a vertex."""
        checked(metric)
        vectors, near = read_raw_vectors(spark, data, dim), read_raw_graph(spark, edges)
        far = near.join(graph.edge_distances(near, vectors, metric), ["src", "dst"])
        own = far.select(F.lit(0).alias("shard"), "src", "rank", "dst", "dist")
        return cls(vectors.withColumn("shard", F.lit(0)), materialize(own, "edges"), metric)

    def add(self, more: DataFrame) -> VectorIndex:
        """The index with further vectors as a shard of their own; their ids must be new."""
        more = _coded(more.select("vec_id", "embedding"), self.bits)
        edges = graph.build_sequential(more, self.metric).withColumn("shard", F.lit(self.shards))
        vectors = self.vectors.unionByName(more.withColumn("shard", F.lit(self.shards)))
        return replace(self, routes=None, vectors=vectors, edges=materialize(self.edges.unionByName(edges), "edges"), shards=self.shards + 1)

    def delete(self, ids: DataFrame) -> VectorIndex:
        """The index without the vectors of ``ids`` (vec_id); ids that it doesn't have do nothing.

        Lists that lose a neighbour are repaired from its own neighbours, and in an index of one graph vertices that are
        no longer reached are bridged. Vectors and edges are written anew, so nothing of what goes is kept.
        """
        gone = ids.select("vec_id").where("vec_id IS NOT NULL").distinct()
        vectors = materialize(self.vectors.join(gone, "vec_id", "left_anti").select(*self.vectors.columns), "vectors")
        edges = materialize(graph.without(vectors, self.edges, gone, self.metric), "edges")
        if self.shards == 1:
            edges = graph.bridged(vectors, edges.drop("shard"), self.metric).withColumn("shard", F.lit(0))
        return replace(self, vectors=vectors, edges=edges)

    def update(self, more: DataFrame) -> VectorIndex:
        """The index with these vectors in place of those of the same ids, or beside them where an id is new."""
        return self.delete(more).add(more)

    def compact(self, least: int) -> VectorIndex:
        """The index with all shards of fewer than ``least`` vectors, such as additions leave, as one, built anew."""
        size = self.vectors.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        small = sorted(r["shard"] for r in size.where(F.col("n") < least).collect())  # a row for each shard at most
        if len(small) < 2:
            return self
        some = F.col("shard").isin(small)
        own = self.vectors.where(some).select("vec_id", "embedding")
        edges = graph.build_sequential(own, self.metric).withColumn("shard", F.lit(small[0]))
        vectors = self.vectors.withColumn("shard", F.when(some, F.lit(small[0])).otherwise(F.col("shard")))
        return replace(self, routes=None, vectors=vectors, edges=materialize(self.edges.where(~some).unionByName(edges), "edges"))

    def search_where(self, queries: DataFrame, allowed: DataFrame, k: int = 100, query_key: str = "vec_id", few: float = 0.02) -> DataFrame:
        """(query_id, rank, vec_id, dist) among the vectors of ``allowed`` (vec_id), such as metadata that pass a filter.

        Where no more than the part ``few`` of all vectors is allowed, they are all compared. Else the graph is searched,
        through vectors that are not allowed as well, with so much more room as there are of these; queries that end
        with too few rows are compared with all that is allowed.
        """
        allowed = allowed.select("vec_id").distinct()
        own = self.vectors.join(allowed, "vec_id", "left_semi")
        n, every = own.count(), self.vectors.count()
        asked = _coded(queries, self.bits, query_key)
        if n <= max(k, few * every):
            return knn(asked, own, k, self.metric, query_key)
        room = -(-2 * k * every // n)
        found = self.search_batch(queries, room, query_key=query_key).join(allowed, "vec_id", "left_semi")
        found = materialize(ranked(found.select("query_id", "vec_id", "dist"), k), "filtered")
        whole = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias(query_key))
        rest = knn(asked.join(whole, query_key, "left_anti"), own, k, self.metric, query_key)
        return found.join(whole.withColumnRenamed(query_key, "query_id"), "query_id", "left_semi").select("query_id", "rank", "vec_id", "dist").unionByName(rest)

    def _shard(self) -> str | None:
        return "shard" if self.shards > 1 else None

    def search_batch(self, queries: DataFrame, k: int = 100, options: Options | None = None, query_key: str = "vec_id", metric: str | None = None, visit: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, dist) of all queries, by a bounded search unless ``options`` say otherwise.

        With ``visit`` a routed index is searched in the shards of so many centroids only.
        """
        if (metric or self.metric) != self.metric or options and options.metric != self.metric:
            raise ValueError(f"the index was built for {self.metric}")
        if visit:
            if not self.routes:
                raise ValueError("only an index of routed shards can be visited in part")
            return route.search_routed(queries, self.vectors, self.edges, self.routes, options or bounded(self.metric, k), visit, k, query_key)
        return search(_coded(queries, self.bits, query_key), self.vectors, self.edges, options or bounded(self.metric, k), k, query_key, shard=self._shard())

    def search(self, vector: list[float], k: int = 100, options: Options | None = None) -> list[tuple[int, float]]:
        """Ids and distances for one vector, nearest first."""
        one = self.vectors.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "vec_id long, embedding array<double>")
        rows = self.search_batch(one, k, options or unbounded(self.metric, k)).orderBy("rank").collect()
        return [(r["vec_id"], r["dist"]) for r in rows]

    def walk(self, queries: DataFrame, query_key: str = "vec_id") -> DataFrame:
        return greedy_walk(_coded(queries, self.bits, query_key), self.vectors, self.edges, self.metric, query_key, shard=self._shard())

    def size(self) -> tuple[int, int]:
        """Vectors and components of each."""
        r = self.vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        return r["n"], r["d"] or 0

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        spark = self.vectors.sparkSession
        spark.createDataFrame([(self.metric, self.shards, self.bits)], "metric string, shards int, bits int").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/edges"), about["metric"], about["shards"], about["bits"])


def _coded(vectors: DataFrame, bits: int | None, key: str = "vec_id") -> DataFrame:
    return codes(vectors, bits, key).withColumnRenamed("words", "embedding") if bits else vectors
