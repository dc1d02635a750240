"""Operator 7: near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors of a label form one class, so a very common vector costs one row.  Each class
gets the sign bits of random hyperplanes in several tables; classes of one label that share
a table's code meet in a bucket, where a block product gives their exact cosines in double precision.
The number of bits follows the number of classes, and the number of tables the bits:
a pair exactly at the threshold is missed with probability ``miss`` at most.
Buckets over ``block`` rows are dealt out as pairs of blocks, so no task holds a whole large bucket.
A pair counts in the first table in which it meets, so links need no de-duplication.  What a group writes is its classes'
numbers of links and a spanning forest of them, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, durable, release

THRESHOLD = 0.98


def plan(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for a number of classes."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, classes) / 64))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([77, dim, bits]).standard_normal((dim, bits * tables))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = 1e-6, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Rows link within one label and one dimension only.  A null label or vector, an empty or zero vector,
    one with null, NaN or infinite components: no links.  Equal vectors, repeated rows among them,
    link with each other.  A null vec_id forms no component id: its row has
    component_id null and counts as kept.  Other columns are ignored; an empty table gives an empty result.
    """
    good = F.expr(
        "coalesce(label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0), false)"
    )
    own = vectors.select("vec_id", "label", "embedding", good.alias("good"))
    own = own.withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "embedding"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(7), "label", "embedding")))
    classes = own.filter("good").groupBy("h1", "h2", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    # ids are given as the table is written, so they cannot clash; members find their class by 128 bits
    classes = durable(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), threshold, miss)

    def sign(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            lists = batch.column(2)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            codes = np.zeros((len(sizes), tables), np.int32)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = unit_rows(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), int(dim))
                on = (x @ planes(int(dim), bits, tables) > 0).reshape(len(rows), tables, bits)
                codes[rows] = on @ (1 << np.arange(bits)).astype(np.int32)
            flat = pa.array(codes.ravel(), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, labels, lists, batch.column(3), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), flat)], ["class", "label", "embedding", "copies", "codes"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    signed = durable(
        classes.select("class", "label", "embedding", "copies").mapInArrow(sign, f"class long, label {kinds['label']}, embedding {kinds['embedding']}, copies long, codes array<int>"), "signed"
    )
    placed = signed.select("class", "label", F.size("embedding").alias("dim"), F.posexplode("codes").alias("tab", "code"))
    bucket = ["tab", "code", "label", "dim"]
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    met = placed.join(sizes, bucket).withColumn("mine", F.pmod("class", "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select("class", *bucket, "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    rows = met.join(signed.select("class", "embedding", "copies", "codes"), "class")
    group = [*bucket, "low", "high"]
    n_parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n_parts, *group).sortWithinPartitions(*group).select(*group, "mine", "class", "embedding", "copies", "codes")

    def product(batches):
        """Exact cosines within each group; groups are runs of the sorted rows."""
        held = None
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # src, and a linked dst (n -1) or its number of links n

        def group_links(t: pa.Table):
            dim, tab = t.column("dim")[0].as_py(), t.column("tab")[0].as_py()
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            ids, copies = t.column("class").to_numpy(), t.column("copies").to_numpy()
            x = unit_rows(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
            codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), tables)
            if low == high:
                left = right = np.arange(len(ids))
            else:
                mine = t.column("mine").to_numpy()
                left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
            counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            tied = []
            for i in range(0, len(left), 512):
                rows = left[i : i + 512]
                a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
                a, b = rows[a], right[b]
                if low == high:
                    a, b = a[a < b], b[a < b]
                first = np.ones(len(a), bool)
                for k in range(tab):
                    first &= codes[a, k] != codes[b, k]
                np.add.at(counts, a[first], copies[b[first]])
                np.add.at(counts, b[first], copies[a[first]])
                cuts = [*np.searchsorted(a, np.unique(a)).tolist(), len(a)]
                for start, stop in zip(cuts, cuts[1:]):
                    trees = np.unique(label[np.append(b[start:stop], a[start])])
                    if len(trees) > 1:
                        label[np.isin(label, trees)] = trees[0]
                        tied += [(trees[0], k) for k in trees[1:]]
            some = np.flatnonzero(counts)
            out.append((ids[some], np.zeros(len(some), np.int64), counts[some]))
            if tied:
                pairs = ids[np.array(tied)]
                out.append((pairs[:, 0], pairs[:, 1], np.full(len(pairs), -1)))

        def finish(t: pa.Table):
            keys = [t.column(c).combine_chunks() for c in group]
            change = np.zeros(t.num_rows, bool)
            for k in keys:
                k = k.dictionary_encode().indices.to_numpy()
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    group_links(t.slice(a, b - a))

        def flush():
            src, dst, n = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in out)]) for k in range(3))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst, mask=n >= 0), pa.array(n, mask=n < 0)], ["src", "dst", "n"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            if held is not None:
                now = pa.concat_tables([held, now])
            last = now.slice(now.num_rows - 1)
            same = np.ones(now.num_rows, bool)
            for c in group:
                same &= pa.compute.equal(now.column(c), last.column(c)[0]).to_numpy()
            start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if start:
                finish(now.slice(0, start))
                yield flush()
            held = now.slice(start)
        if held is not None and held.num_rows:
            finish(held)
            yield flush()

    found = durable(dealt.mapInArrow(product, "src long, dst long, n long"), "links")
    release(signed)
    beyond = found.filter("n is not null").groupBy(F.col("src").alias("class")).agg(F.sum("n").alias("beyond"))
    member = connected_components(found.filter("n is null").select("src", "dst")).select(F.col("id").alias("class"), "component")
    info = classes.select("class", "h1", "h2", "copies", "least").join(member, "class", "left").join(beyond, "class", "left")
    info = info.withColumn("component", F.coalesce("component", "class"))
    roots = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = durable(
        info.join(roots, "component").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).cast("long").alias("n_links"), "component_id"), "info"
    )
    out = own.select("vec_id", "h1", "h2").join(info, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


import pyarrow.compute  # noqa: E402,F401  (makes pa.compute available)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
