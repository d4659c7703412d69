"""What several of these operators share: shared-folder tables, spans and connected components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: components(): so few edges are left to one task.
FEW_EDGES = 4096


def once_a_process(make):
    """make, whose results are kept by its arguments for as long as the process lives.

    Functions reach executors by value, each time anew; what is kept stands beside them, in a module of
    its own, and is not sent along.
    """

    @wraps(make)
    def call(*args):
        store = sys.modules.setdefault("pricestrata_kept", types.ModuleType("pricestrata_kept")).__dict__
        key = f"{make.__module__}.{make.__qualname__}{args!r}"
        if key not in store:
            store[key] = make(*args)
        return store[key]

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="pricestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that kept() wrote and nothing will read again."""
    for df in tables:
        if path := getattr(df, "kept_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage: Spark then removes the files of shuffles that nothing will read again."""
    spark.sparkContext._jvm.System.gc()


def merged(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a few edges (src, dst), in one task; component is the smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for src, dst in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one, two = sorted((root(src), root(dst)))
                up[two] = one
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "component"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) for every node of edges (src, dst: longs), component being one node of each component.

    Contraction: every node joins its neighbour of the lowest hash, the edges are renamed, and what
    remains is contracted again with other hashes; a round leaves a constant share of the nodes. No
    round gathers a node's neighbours, so a node with very many is only a key of a partial aggregate.
    The last edges, `few` at most however many there were, take one task and not as many rounds again:
    a round is two tables of as many tasks as a shuffle has, all of which the driver keeps account of.
    """
    names: DataFrame | None = None
    left = kept(edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    turn = 0
    spark = edges.sparkSession
    while number := left.count():
        order = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("h"), F.col(c).alias("v"))
        if number <= few:
            parent = kept(merged(left))
        else:
            both = left.select("src", "dst").unionAll(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            parent = kept(both.groupBy("src").agg(F.min(order("dst")).alias("m")).select(F.col("src").alias("node"), F.least(F.col("m"), order("src"))["v"].alias("component")))
        if names is None:
            names = parent
        else:
            step = parent.select(F.col("node").alias("component"), F.col("component").alias("next"))
            names = names.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        if number <= few:
            discard(left)
            break
        a, b = (parent.select(F.col("node").alias(c), F.col("component").alias(f"{c}_p")) for c in ("src", "dst"))
        before = left
        left = kept(left.join(a, "src").join(b, "dst").select(F.least("src_p", "dst_p").alias("src"), F.greatest("src_p", "dst_p").alias("dst")).where("src <> dst").distinct())
        discard(before)
        turn += 1
    return names if names is not None else spark.createDataFrame([], "node long, component long")


def joined_spans(spans: list[tuple[int, int, int, str]]) -> str:
    """kind:start:end of (start, place of kind, end, kind), in that order, joined by commas."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))
