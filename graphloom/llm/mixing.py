"""Operator 8: mixing sources to target weights by Pfair scheduling, native operations only.

A source's rows form blocks.  Target weights are quantized to whole quanta of one period
(``period`` slots, a little more if there are many sources).  With a quanta of Q slots, a source's block k has
release floor(k * Q / a) and deadline ceil((k + 1) * Q / a), and earliest deadline first
fills the slots: a source's count of blocks never strays a whole block from a * t / Q.
The windows repeat every period, so the schedule of one period is folded once (a
higher-order aggregate over at most a few thousand slots) and every block looks its slot up.

Sources end at different times.  A phase is a run of periods with the same sources left;
each phase has its own period made of the remaining sources' quanta, so targets stay in
proportion.  No row is dropped or repeated.

That is the plan of ``schedule`` (its SQL says the same): it keeps to the rounded weights, so
against the target weights it drifts as the input grows.  ``interleave``, the pipeline's stage, keeps to the target
weights themselves: the sources are the leaves of a binary tree, slot t of a node goes to its smaller child (share
r <= 1/2 of the node) if floor(r * (t + 1) + 1/2) > floor(r * t + 1/2), and to the other one if not.  Every split is within 1/2 of its
share, so a source of weight w stays within (1 + sum of w / weight of each ancestor below the root) / 2 blocks of w * t
however long the phase is; ``tree`` looks for a
shape with a bound under 1 (some weights leave up to about 1.4).  A block's slot is closed arithmetic along its path.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, gapless_index, same

PERIOD = 400
BLOCK_ROWS = 16
MAX_LOOKUP = 200_000
MAX_PARTS = 20_000
MAX_SHAPES = 64


def target(weights: dict[str, float] | None) -> Column:
    """A source's target weight, from its name and its rows ``n``.

    ``weights`` gives target weights by source name; without them the target is the square
    root of the source's rows.  A source without a positive target gets the smallest one, so its rows are kept.
    """
    if not weights:
        return F.sqrt("n")
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    given = table[F.coalesce("source", F.lit(""))]
    return F.when(given > 0, given).otherwise(F.lit(min(v for v in weights.values() if v > 0)))


def sources_table(counts: DataFrame, block_rows: int, period: int, weights: dict[str, float] | None) -> DataFrame:
    """source, quanta, blocks, periods (whole periods until the source ends); see ``target``."""
    rows = counts.withColumn("w", target(weights))
    total = rows.agg(F.sum("w").alias("total"))
    rows = rows.join(F.broadcast(total), F.lit(True))
    rows = rows.withColumn("quanta", F.greatest(F.lit(1), F.round(F.col("w") / F.col("total") * period)).cast("int"))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
    return rows.select("source", "n", "quanta", "blocks", F.ceil(F.col("blocks") / F.col("quanta")).cast("long").alias("periods"))


PICK = """
aggregate(
  sequence(0, slots - 1),
  named_struct('c', transform(active, x -> 0), 'o', cast(array() as array<struct<i:int,k:int>>)),
  (s, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(active) - 1),
             i -> s.c[i] < active[i].quanta and floor(s.c[i] * cast(slots as long) / active[i].quanta) <= t),
      i -> struct(cast(ceil((s.c[i] + 1) * cast(slots as long) / active[i].quanta) as int) as d, i as i))).i),
    b -> named_struct(
      'c', transform(s.c, (v, j) -> if(j = b, v + 1, v)),
      'o', concat(s.o, array(named_struct('i', b, 'k', s.c[b])))))[0],
  s -> s.o)
"""


def phases_table(sources: DataFrame) -> DataFrame:
    """One row per phase: first and last+1 period, slots of a period, active sources, slots before the phase."""
    packed = sources.agg(F.array_sort(F.collect_list(F.struct("source", "quanta", "periods"))).alias("all"))
    packed = packed.select("all", F.array_sort(F.array_distinct(F.transform("all", lambda x: x["periods"]))).alias("ends")).filter("size(ends) > 0")
    rows = packed.select("all", "ends", F.posexplode("ends").alias("phase", "until"))
    rows = rows.withColumn("since", F.expr("case when phase = 0 then 0L else ends[phase - 1] end"))
    rows = rows.withColumn("active", F.expr("filter(all, x -> x.periods > since)")).withColumn("slots", F.expr("aggregate(active, 0, (s, x) -> s + x.quanta)"))
    rows = durable(rows, "active")
    # one row per phase
    past = W.orderBy("phase").rowsBetween(W.unboundedPreceding, -1)
    before = rows.select("phase", F.coalesce(F.sum((F.col("until") - F.col("since")) * F.col("slots")).over(past), F.lit(0)).cast("long").alias("before"))
    return rows.join(F.broadcast(before), "phase").select("phase", "since", "until", "slots", "active", "before")


def template_table(phases: DataFrame) -> DataFrame:
    """phase, source, nth (its block within a period), at (slot within a period), and the phase's figures."""
    n = int(phases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = phases.repartition(n, "phase").withColumn("order", F.expr(PICK))
    rows = folded.select("phase", "since", "slots", "before", "active", F.posexplode("order").alias("at", "x"))
    return rows.select("phase", "since", "slots", "before", F.expr("active[x.i].source").alias("source"), F.expr("x.k").alias("nth"), "at")


def schedule(rows: DataFrame, source: Column, order: list[str], weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``rows`` (narrow) with source, index in the source, block, phase, slot, quanta, phase_slots, release, deadline.

    Rows of a source keep the given order.  A null source is a source of its own, after none and before all names.
    (slot, offset) is the place in the mixture; slots of a source's unfilled last period stay empty.
    """
    if clash := {"source", "index", "block", "offset", "phase", "slot", "quanta", "phase_slots", "release", "deadline"} & ({*rows.columns} - {"source"}):
        raise ValueError(f"columns would clash: {sorted(clash)}")
    numbered = durable(gapless_index(rows.withColumn("source", source), ["source"], order, "index"), "numbered")
    counts = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = durable(sources_table(counts, block_rows, period, weights), "sources")
    phases = durable(phases_table(sources), "phases")
    template = durable(template_table(phases), "template")
    ends = phases.agg(F.array_sort(F.collect_list("until")).alias("ends"))
    known = sources.select("source", "quanta")
    own = numbered.join(F.broadcast(known), same(numbered, known, "source")).drop(known["source"]).join(F.broadcast(ends), F.lit(True))
    own = own.withColumn("block", F.floor(F.col("index") / block_rows)).withColumn("offset", (F.col("index") % block_rows).cast("int"))
    own = own.withColumn("_p", F.expr("block div quanta")).withColumn("_nth", F.expr("cast(block % quanta as int)"))
    own = own.withColumn("_phase", F.expr("size(filter(ends, e -> e <= _p))"))
    # a large template is joined by key
    t = F.broadcast(template) if template.count() <= MAX_LOOKUP else template.hint("merge")
    out = own.join(t, (own["_phase"] == template["phase"]) & (own["_nth"] == template["nth"]) & own["source"].eqNullSafe(template["source"]))
    start = F.col("before") + (F.col("_p") - F.col("since")) * F.col("slots")
    return out.select(
        *[own[c] for c in numbered.columns], "block", "offset", "phase", (start + F.col("at")).cast("long").alias("slot"), own["quanta"], template["slots"].alias("phase_slots"),
        (start + F.floor(F.col("nth") * F.col("slots").cast("long") / own["quanta"])).cast("long").alias("release"),
        (start + F.ceil((F.col("nth") + 1) * F.col("slots").cast("long") / own["quanta"])).cast("long").alias("deadline"),
    )


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """The mixture's plan for every document: doc_id and the columns of ``schedule``.

    Null doc_id and null source are kept; repeated rows get places of their own; an empty table gives an empty plan.
    """
    return schedule(docs.select("doc_id", "source"), F.col("source"), ["doc_id"], weights, block_rows, period)


def tree(weights: list[float]) -> tuple[list[list[tuple[float, bool]]], float]:
    """(each leaf's path up to the root as (r of the node, whether it is on the smaller side), bound on the deviation)."""

    def paths(root):
        out, bound, todo = [[] for _ in weights], 0.0, [(root, [], 0.0)]
        while todo:
            (w, _, leaf, kids), up, inverse = todo.pop()
            if kids is None:
                out[leaf] = up[::-1]
                bound = max(bound, (1 + w * inverse) / 2 if up else 0.0)
                continue
            small, large = sorted(kids, key=lambda x: x[:2])
            r = small[0] / (small[0] + large[0])
            below = inverse + (1 / w if up else 0.0)
            todo += [(small, [*up, (r, True)], below), (large, [*up, (r, False)], below)]
        return out, bound

    def huffman(nodes):
        heap = list(nodes)
        heapq.heapify(heap)
        count = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], count := count + 1, -1, (a, b)))
        return heap[0]

    leaves = sorted((w, i, i, None) for i, w in enumerate(weights))

    best = paths(huffman(leaves))
    for cut in range(1, len(leaves) - 1 if len(leaves) <= MAX_SHAPES else 0):
        if best[1] < 1:
            break
        # the smallest sources apart: a small sibling deep in the tree costs its neighbour a whole split
        rest, few = huffman(leaves[cut:]), huffman(leaves[:cut])
        best = min(best, paths((few[0] + rest[0], -1, -1, (few, rest))), key=lambda x: x[1])
    return best


def slot_of(k: int, path: list[tuple[float, bool]]) -> int:
    """The slot of a source's block k, counted from the start of the phase (``SLOT`` is the same for columns)."""
    for r, small in path:
        t = math.ceil((k + 0.5) / (r if small else 1 - r)) - 1
        k = next(x for x in (t - 1, t, t + 1, t + 2) if _given(x + 1, r, small) > k)
    return k


def _given(t: int, r: float, small: bool) -> int:
    """Of a node's first t slots, those of one child."""
    return math.floor(r * t + 0.5) if small else t - math.floor(r * t + 0.5)


SLOT = """
start + aggregate(path, block - since, (k, x) -> filter(
  transform(sequence(-1L, 2L), d -> cast(ceil((k + 0.5D) / if(x.small, x.r, 1D - x.r)) as bigint) - 1L + d),
  t -> if(x.small, cast(floor(x.r * (t + 1L) + 0.5D) as bigint), t + 1L - cast(floor(x.r * (t + 1L) + 0.5D) as bigint)) > k)[0])
"""


def target_phases(sources: list[tuple[str | None, float, int]]) -> list[dict]:
    """For (source, weight, blocks): the phases, each with its sources' first block, end, path, and the first slot.

    A phase ends with the slot that takes the last block of a source.
    """
    out, start = [], 0
    active = [[name, w, blocks, 0] for name, w, blocks in sources if blocks]
    while active:
        paths, _ = tree([a[1] for a in active])
        length = 1 + min(slot_of(a[2] - a[3] - 1, p) for a, p in zip(active, paths, strict=True))
        for a, path in zip(active, paths, strict=True):
            taken = length
            for r, small in reversed(path):
                taken = _given(taken, r, small)
            if taken:
                out.append({"source": a[0], "since": a[3], "until": a[3] + taken, "start": start, "path": [{"r": r, "small": small} for r, small in path]})
            a[3] += taken
        active, start = [a for a in active if a[3] < a[2]], start + length
    return out


def target_schedule(rows: DataFrame, order: list[str], weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (narrow, with source) and their index in the source, block, offset and slot by the target weights themselves.

    Only one row per source comes to the driver.
    """
    spark = rows.sparkSession
    numbered = durable(gapless_index(rows, ["source"], order, "index"), "numbered")
    counts = numbered.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    found = counts.select("source", target(weights).alias("w"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")).collect()
    parts = target_phases(sorted((tuple(r) for r in found), key=lambda r: (r[0] is not None, r[0])))
    kind = pa.schema([("source", pa.string()), ("since", pa.int64()), ("until", pa.int64()), ("start", pa.int64()), ("path", pa.list_(pa.struct([("r", pa.float64()), ("small", pa.bool_())])))])
    t = spark.createDataFrame(pa.Table.from_pylist(parts, kind))
    t = F.broadcast(t) if len(parts) <= MAX_PARTS else durable(t, "parts")
    own = numbered.withColumn("block", F.floor(F.col("index") / block_rows)).withColumn("offset", (F.col("index") % block_rows).cast("int"))
    met = own.join(t, own["source"].eqNullSafe(t["source"]) & (own["block"] >= t["since"]) & (own["block"] < t["until"]))
    return met.select(*[own[c] for c in own.columns], F.expr(SLOT).alias("slot"))


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """Whole rows in mixture order (range-partitioned and sorted by slot), columns unchanged; docs needs source.

    Follows the target weights without rounding; ``period`` is not used.
    """
    tie, slot, offset = "_gl_row", "_gl_slot", "_gl_offset"
    kept = durable(docs.withColumn(tie, F.monotonically_increasing_id()), "rows")
    plan = target_schedule(kept.select(tie, "source"), [tie], weights, block_rows)
    plan = plan.select(F.col(tie).alias("_gl_key"), F.col("slot").alias(slot), F.col("offset").alias(offset))
    placed = kept.join(plan, kept[tie] == plan["_gl_key"])
    return placed.repartitionByRange(slot, offset).sortWithinPartitions(slot, offset).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
