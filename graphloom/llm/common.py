"""Shared pieces of the corpus operators: durable tables, gapless numbering,
connected components and a bounded key filter.

Lineage is cut with Parquet tables in the shared folder that the cluster names
in ``spark.checkpoint.dir``; a lost executor therefore costs a re-read, never a
wrong result.  Nothing here collects per-document data to the driver.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import ship

_own_folder: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Ship the package and, unless the session chose its own, make Arrow batches small (2000 rows, 2 MB): whole texts are long rows."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "2097152")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the setting is absent (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="graphloom-"))
    return "file://" + _own_folder[0]


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove tables written by ``durable`` (missing ones are ignored)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        delete(spark, path)


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table is removed when the driver ends, or earlier with ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def cached(df: DataFrame) -> DataFrame:
    """Keep the result of one narrow scan on the executors' disks for the jobs that follow.

    Lineage stays: a lost executor costs a new scan of its partitions.  The cache goes with the session
    or ``spark.catalog.clearCache()``.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def release(*tables: DataFrame) -> None:
    """Delete durable tables that no pending result reads any more."""
    for t in tables:
        if path := getattr(t, "_graphloom_path", None):
            delete(t.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Delete the shuffle files of finished jobs now.

    Spark deletes them when the driver's JVM collects their handles; without pressure on its heap that may take half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def row_hashes() -> tuple[Column, Column]:
    """Two hashes of a document."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(7), "doc_id", "text")


def clashes(keys: DataFrame) -> list[int]:
    """Of (key, check) rows, the keys that stand for several checks.

    Keys are 64-bit hashes: for n different documents about n * n / 2**65 are expected, 3 for 10**10.
    """
    several = keys.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b")
    return [r.key for r in several.select("key").collect()]


def moved(key: Column, check: Column, clash: list[int]) -> Column:
    """``key``, or ``check`` where the key stands for several."""
    return F.when(key.isin(clash), check).otherwise(key) if clash else key


def row_key(docs: DataFrame) -> Column:
    """A long per document (doc_id, text): equal for repeated rows, and different for different ones.

    A hash; where two documents share one (found with one scan), their second hashes take its place.
    """
    key, check = row_hashes()
    return moved(key, check, clashes(docs.select(key.alias("key"), check.alias("check"))))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on the named columns."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def gapless_index(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the given order.

    One group may hold any share of the rows: rows are range-partitioned over
    (groups, order, tie) so that a large group spans many tasks, each task's
    share is counted, and the counts' running totals are added to a local
    ``row_number``.  Ties (and repeated rows) get distinct numbers.
    """
    narrow = cached(df.withColumn("_gl_tie", F.monotonically_increasing_id()))
    ranged = durable(
        narrow.repartitionByRange(*groups, *order, "_gl_tie").withColumn("_gl_part", F.spark_partition_id()), "ranged"
    )
    narrow.unpersist()
    counts = ranged.groupBy(*groups, "_gl_part").agg(F.count(F.lit(1)).alias("_gl_n"))
    before = W.partitionBy(*groups).orderBy("_gl_part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*groups, "_gl_part", F.coalesce(F.sum("_gl_n").over(before), F.lit(0)).alias("_gl_base"))
    local = W.partitionBy(*groups, "_gl_part").orderBy(*order, "_gl_tie")
    rows = ranged.withColumn("_gl_rank", F.row_number().over(local))
    return rows.join(base, same(rows, base, *groups, "_gl_part")).select(
        *[rows[c] for c in df.columns], (base["_gl_base"] + rows["_gl_rank"] - 1).cast("long").alias(name)
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (id, component), component = smallest id reachable.

    Alternating large-star / small-star contraction: every round rewires edges to
    smaller neighbours, so a chain of n nodes takes O(log n) rounds.  A hub's
    neighbourhood is only ever reduced with min(), never collected.
    """
    both = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src != dst")
    now = durable(both.distinct(), "edges")
    for _ in range(rounds):
        sym = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = sym.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # large star: larger neighbours of u attach to the smallest of u's neighbourhood
        large = (
            sym.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        )
        # small star: u and its smaller neighbours attach to the smallest
        small_low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(small_low, "src")
        new = durable(
            small.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .union(small_low.select("src", F.col("m").alias("dst")))
            .filter("src != dst")
            .distinct(),
            "edges",
        )
        # converged when every node hangs directly on a root: no node is both src and dst
        done = new.select("src").join(new.select(F.col("dst").alias("src")), "src", "left_semi").isEmpty()
        single = done and new.groupBy("src").count().filter("count > 1").isEmpty()
        release(now)
        now = new
        if single:
            break
    else:
        raise RuntimeError("connected components did not converge")
    roots = now.select(F.col("dst").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(roots)


def maybe_mark(df: DataFrame, column: Column, keys: DataFrame, name: str, bits: int = 24) -> DataFrame:
    """``df`` with a boolean: may its long key be among ``keys`` (one long column)?  False is certain.

    A bitmap of 2**bits bits whatever the data: at most 2**(bits-6) rows of 16 bytes (4 MB)
    are broadcast.  Callers join the rows that pass exactly afterwards; a full bitmap only makes
    everything pass.
    """
    key = keys.columns[0]
    at = f"pmod(xxhash64({key}), {1 << bits})"
    words = keys.select(F.expr(f"shiftright({at}, 6)").alias("_w"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    probe = df.withColumn("_s", F.pmod(F.xxhash64(column), F.lit(1 << bits)))
    hit = probe.join(F.broadcast(words), F.shiftright(probe["_s"], 6) == words["_w"], "left")
    return hit.select(*[probe[c] for c in df.columns], F.expr("coalesce((shiftright(_b, cast(_s & 63 as int)) & 1L) = 1, false)").alias(name))


def maybe_in(df: DataFrame, column: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``; see ``maybe_mark``."""
    return maybe_mark(df, column, keys, "_gl_maybe").filter("_gl_maybe").drop("_gl_maybe")


def without(df: DataFrame, column: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among ``keys`` (one long column); only rows that the bitmap cannot clear are joined."""
    marked = maybe_mark(df, column, keys, "_gl_maybe")
    unsure = marked.filter("_gl_maybe").withColumn("_gl_probe", column)
    gone = keys.select(F.col(keys.columns[0]).alias("_gl_gone"))
    unsure = unsure.join(gone, unsure["_gl_probe"] == gone["_gl_gone"], "left_anti")
    return marked.filter("not _gl_maybe").select(*df.columns).union(unsure.select(*df.columns))


def split_hot(df: DataFrame, counts: DataFrame, names: list[str], share: int = 4096) -> DataFrame:
    """Rows of ``df`` whose ``names`` (none null) are among ``counts`` (names, each once, and n, their rows).

    Keys with more than a ``share``-th of the counted rows are fewer than ``share``: they are broadcast, so that no
    task gathers the rows of one of them.  The others meet in a shuffle.
    """
    least = (counts.agg(F.sum("n").alias("n")).first().n or 0) // share
    hot = F.broadcast(counts.filter(F.col("n") > least).select(*names, F.lit(True).alias("_gl_hot")))
    marked = df.join(hot, names, "left")
    usual = marked.filter("_gl_hot is null").select(*df.columns)
    return marked.filter("_gl_hot").select(*df.columns).union(usual.join(counts.filter(F.col("n") <= least).select(*names), names).select(*df.columns))


def text_slices(col: pa.Array, limit: int = 1 << 19):
    """(start, stop, texts) of runs of a text column of about ``limit`` bytes (one text at least).

    Only one run is in memory as Python strings; freed memory goes back to the system after the last.
    """
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, len(col)
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop, col.slice(start, stop - start).to_pylist()
        start = stop
    give_back()


def give_back() -> None:
    """Return memory that the allocators hold but do not use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
