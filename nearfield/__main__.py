"""Build an index, search it, or size a filter.

    python -m nearfield build DATA INDEX DIM METRIC [--shards N] [--bulk] [--bits N] [--dense]
    python -m nearfield test INDEX QUERIES DIM METRIC [PQ [DISPLAY]] [--dense]
    python -m nearfield test-raw VECTORS GRAPH QUERIES DIM METRIC [PQ [DISPLAY]] [--dense]
    python -m nearfield tune PQ

build reads LIBSVM text, or with --dense lines of components, and writes an index; test prints the nearest ids of each
query, a line for each; test-raw does so for an index of raw files. --log LEVEL (ALL, DEBUG, INFO, WARN, ERROR) says what goes
to stderr. With --bits the metric is hamming and vectors and queries are coded.
"""

from __future__ import annotations

import argparse
import sys
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.bloom import autotune
from nearfield.functions.distance import METRICS
from nearfield.plans.index import VectorIndex
from nearfield.shared import LEVELS, log
from nearfield.sources.vectors import read_dense, read_libsvm, result_lines


def _arguments(args: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="nearfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--log", choices=LEVELS, default="WARN")
    commands = top.add_subparsers(dest="command", required=True)
    for name, files in (("build", ["data", "index"]), ("test", ["index", "queries"]), ("test-raw", ["vectors", "graph", "queries"])):
        one = commands.add_parser(name)
        for f in files:
            one.add_argument(f)
        one.add_argument("dim", type=int)
        one.add_argument("metric", choices=METRICS)
        one.add_argument("--dense", action="store_true")
        if name == "build":
            one.add_argument("--shards", type=int)
            one.add_argument("--bulk", action="store_true")
            one.add_argument("--bits", type=int)
        else:
            one.add_argument("pq", type=int, nargs="?", default=100)
            one.add_argument("display", type=int, nargs="?", default=100)
    commands.add_parser("tune").add_argument("pq", type=int)
    return top.parse_args(args)


def _read(spark: SparkSession, path: str, o: argparse.Namespace) -> DataFrame:
    return read_dense(spark, path) if o.dense else read_libsvm(spark, path, o.dim)


def main(args: list[str]) -> int:
    try:
        o = _arguments(args)
    except SystemExit as e:
        return 1 if e.code else 0
    log.setLevel(LEVELS[o.log])
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    began = perf_counter()
    if o.command == "tune":
        r = autotune(spark.createDataFrame([(o.pq,)], "topk long")).first()
        print(f"bit {r['words']} {r['power']} hash {r['hashes']} p {r['p']:.6f}")
    elif o.command == "build":
        VectorIndex.build(_read(spark, o.data, o), o.metric, shards=o.shards, bulk=o.bulk, bits=o.bits).save(o.index)
    else:
        index = VectorIndex.load(spark, o.index) if o.command == "test" else VectorIndex.from_raw(spark, o.vectors, o.graph, o.dim, o.metric)
        queries = _read(spark, o.queries, o)
        lines = result_lines(index.search_batch(queries, o.pq, metric=o.metric), o.display)
        for r in queries.select(F.col("vec_id").alias("query_id")).join(lines, "query_id", "left").orderBy("query_id").toLocalIterator():
            print(r["value"] or "")
    log.info("%.3f s", perf_counter() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
