"""Operator 6: n-gram Jaccard join as a blocked sparse product.

Rows of the incidence matrix are distinct shingle sets (documents with equal sets form
one class), columns are shingles.  Only the columns of each row's prefix under one global order
take part: sets with Jaccard >= 0.8 share a column of their first n - ceil(0.8 n) + 1.
The columns are dealt into blocks; a block multiplies its part of the matrix with its transpose
(all pairs of rows within a column), the overlap counts of a pair are added up over the
blocks, and pairs whose sizes or counts are below the bounds that follow from their sizes
are discarded.  What remains is verified on the whole sets.

Two measures keep groups of copies and shared passages from giving all pairs:
* first, near copies found through the 16 smallest hashes are linked (after verification) to
  one centre each and contracted; the product leaves out pairs within a component;
* the order puts very frequent columns last, the most frequent at the end, so that a shared passage is not in the
  prefix of documents that have other text.  The order is free: any order gives the same
  links, so the list of frequent columns may be bounded without loss.

Shingles are 64-bit hashes of word hashes; a class id is the lower half of its set's 128-bit hash, or the upper one
where several sets share the lower one.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, clashes, connected_components, durable, maybe_in, maybe_mark, moved, release, row_key, swept, text_slices, without

WORDS = 5
PERCENT = 80
BOTTOM = 16
FREQUENT = 8
MAX_FREQUENT = 500_000  # 4 MB


class WordHashes(dict):
    """word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
MIX = np.uint64(0x9E3779B97F4A7C15)


def finish(h: np.ndarray) -> np.ndarray:
    """Final mixing, so that the order of hashes is as good as random."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text; fewer words than ``width``: the whole sequence as one."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]  # bytes: A-Z and ASCII white space only
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * MIX + flat[i : i + len(rolled)]
    rolled = finish(rolled)
    out = []
    for end, k in zip(ends.tolist(), n.tolist(), strict=True):
        if k >= width:
            s = np.sort(rolled[end - k : end - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif k:
            h = np.uint64(k)
            for x in flat[end - k : end]:
                with np.errstate(over="ignore"):
                    h = h * MIX + x
            out.append(finish(np.array([h])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def needed(n: np.ndarray | int):
    """ceil(0.8 n)"""
    return (n * PERCENT + 99) // 100


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """(lower, upper) half of a set's hash."""
    upper, lower = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64)
    return int(np.uint64(lower).view(np.int64)), int(np.uint64(upper).view(np.int64))


def class_ids(sets: list[np.ndarray], clash: frozenset[int]) -> list[int]:
    halves = [set_hash(s) if len(s) else (0, 0) for s in sets]
    return [upper if lower in clash else lower for lower, upper in halves]


def profile(batches):
    """(doc_id, row, text) -> (doc_id, row, n, class and check: the halves of the set's hash, prefix under the hash order)."""
    for batch in batches:
        for a, b, texts in text_slices(batch.column(2)):
            sets = shingle_sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            keep = n - needed(n) + 1
            prefix = [s[: max(0, k)] if len(s) else s for s, k in zip(sets, keep.tolist(), strict=True)]
            halves = [set_hash(s) if len(s) else (0, 0) for s in sets]
            lower, upper = (pa.array([h[k] for h in halves], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), lower, upper, lists(prefix)],
                ["doc_id", "row", "n", "class", "check", "prefix"],
            )


def whole_sets(clash: frozenset[int]):
    """(text) -> (class, whole set)."""

    def run(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets, clash), pa.int64()), lists(sets)], ["class", "shingles"])

    return run


def sets_of(classes: DataFrame, need: DataFrame, texts: DataFrame, clash: frozenset[int]) -> DataFrame:
    """(class, whole set), each class once, for at least the classes needed; ``classes`` names a row for each.

    The scan keeps rows whose key passes a bounded bitmap, and their sets meet by class: texts cross no shuffle.
    """
    rows = classes.select("class", "row").join(need, "class", "left_semi").select("row")
    found = maybe_in(texts, texts["row"], rows).select("text").mapInArrow(whole_sets(clash), "class long, shingles array<long>")
    return found.groupBy("class").agg(F.first("shingles").alias("shingles"))


def touched(frequent: np.ndarray):
    """(row, prefix) -> keys of the rows whose prefix has a frequent column."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has_any(batch.column(1), frequent)))], ["row"])

    return run


def has_any(prefix: pa.ListArray, frequent: np.ndarray) -> np.ndarray:
    sizes = pa.compute.list_value_length(prefix).to_numpy()
    hot = among(prefix.flatten().to_numpy().view(np.uint64), frequent)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hot], minlength=len(sizes)) > 0


def add_counts(values: np.ndarray, counts: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with counts, after the values of ``new`` were counted too; merged in place of sorting all again."""
    every = np.sort(np.concatenate(new))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    here, n = every[first], np.diff(np.append(first, len(every))).astype(np.int32)
    old = among(here, values)
    counts[np.searchsorted(values, here[old])] += n[old]
    at = np.searchsorted(values, here[~old])
    return np.insert(values, at, here[~old]), np.insert(counts, at, n[~old])


def repeated_columns(batches, limit: int = 1 << 21):
    """(text) -> columns that at least two different sets of a run of texts have, with their counts.

    A run ends with ``limit`` distinct columns, which bounds the memory; counts of several runs are to be added.
    """
    classes: set[tuple[int, int]] = set()
    values, counts = np.empty(0, np.uint64), np.empty(0, np.int32)
    new: list[np.ndarray] = []
    waiting = 0

    def found():
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"])

    for batch in batches:
        for _, _, texts in text_slices(batch.column(0)):
            for s in shingle_sets(texts):
                c = set_hash(s)
                if len(s) and c not in classes:
                    classes.add(c)
                    new.append(s)
                    waiting += len(s)
                if waiting > max(limit // 8, len(values) // 2):
                    values, counts = add_counts(values, counts, new)
                    new, waiting = [], 0
                    if len(values) > limit:
                        yield found()
                        values, counts = values[:0].copy(), counts[:0].copy()
                        classes.clear()
    if new:
        values, counts = add_counts(values, counts, new)
    yield found()


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def reordered(frequent: np.ndarray, counts: np.ndarray, clash: frozenset[int]):
    """(text) -> (class, n, rare, often): prefixes with frequent columns last, rarer ones of them first, for texts whose hash prefix has one."""

    def run(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                sets, n, rare, often = [], [], [], []
                for s in shingle_sets(texts):
                    if not len(s):
                        continue
                    keep = len(s) - int(needed(len(s))) + 1
                    if not among(s[:keep], frequent).any():
                        continue
                    hot = among(s, frequent)
                    first, last = s[~hot][:keep], s[hot]
                    last = last[np.argsort(counts[np.searchsorted(frequent, last)], kind="stable")]
                    sets.append(s), n.append(len(s)), rare.append(first), often.append(last[: keep - len(first)])
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets, clash), pa.int64()), pa.array(n, pa.int64()), lists(rare), lists(often)], ["class", "n", "rare", "often"])

    return run


def untouched(frequent: np.ndarray):
    """Prefixes without a frequent column stay as they are."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~has_any(batch.column(2), frequent)))

    return run


def block_product(batches):
    """Rows sorted by (token, component) -> pairs of classes of different components within a token and the size bound."""

    def pairs(t: np.ndarray, cls: np.ndarray, n: np.ndarray, h: np.ndarray, comp: np.ndarray):
        new_token = np.append(True, t[1:] != t[:-1])
        new_run = new_token | np.append(True, comp[1:] != comp[:-1])
        ends = np.append(np.flatnonzero(new_token)[1:], len(t))[np.cumsum(new_token) - 1]
        run_end = np.append(np.flatnonzero(new_run)[1:], len(t))[np.cumsum(new_run) - 1]
        count = ends - run_end  # each row meets the later components of its token
        rows = np.flatnonzero(count)
        total = np.cumsum(count[rows])
        start = 0
        while start < len(rows):
            before = int(total[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + 500_000, side="right")))
            part = rows[start:stop]
            start = stop
            k = count[part]
            left = np.repeat(part, k)
            right = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(run_end[part], k)
            low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            ok = 100 * low >= PERCENT * high
            left, right = left[ok], right[ok]
            if len(left):
                swap = cls[left] > cls[right]
                a, b = np.where(swap, right, left), np.where(swap, left, right)
                bound = bounds(n[a], n[b], np.minimum(h[a], h[b]))
                yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(bound)], ["src", "dst", "bound"])

    held = None
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = len(now[0]) - int((now[0][::-1] != now[0][-1]).argmax() or len(now[0]))
        held = [x[cut:] for x in now]
        if cut:
            yield from pairs(*[x[:cut] for x in now])
    if held is not None and len(held[0]):
        yield from pairs(*held)


def bounds(na: np.ndarray, nb: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Least count of shared rare prefix columns that sets of these sizes with Jaccard >= 0.8 have.

    They overlap in ceil(4/9 (na + nb)) at least; of a common column, at most n - prefix lie
    beyond the shorter-reaching prefix, and at most ``often`` are frequent ones in both prefixes.
    """
    overlap = -(-PERCENT * (na + nb) // (100 + PERCENT))
    return np.maximum(1, overlap - needed(np.maximum(na, nb)) + 1 - often)


def compare(batches):
    """Rows sorted by (src, salt, tag): the centre's set, then its partners' -> verified pairs."""
    centre, key = None, None
    for batch in batches:
        src, salt, tag, dst = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        values, ends = batch.column(4).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(4)).to_numpy())])
        a, b = [], []
        for i in range(len(src)):
            s = values[ends[i] : ends[i + 1]].view(np.uint64)
            if tag[i] == 0:
                centre, key = s.copy(), (src[i], salt[i])
            elif key == (src[i], salt[i]):
                common = int(among(s, centre).sum())
                if 100 * common >= PERCENT * (len(s) + len(centre) - common):
                    a.append(src[i]), b.append(dst[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def most_frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` columns with the highest counts, sorted by column, and the counts."""
    found = counts.orderBy(F.desc("n"), "token").limit(limit).select("token", "n").collect()
    tokens = np.array([r.token for r in found], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r.n for r in found], np.int64)[order]


def joined_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both lists in one; the higher count of a column in both."""
    tokens, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    counts = np.zeros(len(tokens), np.int64)
    np.maximum.at(counts, at, np.concatenate([a[1], b[1]]))
    return tokens, counts


def dense_product(batches):
    """Groups of rows sorted by (block, low, high): links between components, a spanning forest of each group.

    The group's part of the incidence matrix is multiplied with its transpose, some columns at a time.
    """

    def settle(mine: np.ndarray, low: int, high: int, cls: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]):
        n = np.array([len(x) for x in sets], np.int64)
        left = np.arange(len(sets)) if low == high else np.flatnonzero(mine == low)
        right = left if low == high else np.flatnonzero(mine == high)
        if not len(left) or not len(right):
            return
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        shared = count[column] > 1
        column, owner = number[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        overlap = np.zeros((len(left), len(right)), np.float32)
        width = 2048
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            overlap += part[left] @ part[right].T
        parent = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i in range(len(left)):
            both = overlap[i].astype(np.int64)
            ok = np.flatnonzero((100 * both >= PERCENT * (n[left[i]] + n[right] - both)) & (comp[right] != comp[left[i]]))
            for j in ok.tolist():
                x, y = find(int(comp[left[i]])), find(int(comp[right[j]]))
                if x != y:
                    parent[x] = y
                    out.append((cls[left[i]], cls[right[j]]))
        if out:
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["src", "dst"])

    key, rows = None, []

    def flush():
        if len(rows) > 1:
            mine, cls, comp, sets = zip(*rows, strict=True)
            yield from settle(np.array(mine), key[1], key[2], np.array(cls, np.int64), np.array(comp, np.int64), list(sets))

    for batch in batches:
        block, low, high, mine, cls, comp = (batch.column(i).to_numpy() for i in range(6))
        values, ends = batch.column(6).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(6)).to_numpy())])
        for i in range(len(block)):
            now = (int(block[i]), int(low[i]), int(high[i]))
            if now != key:
                yield from flush()
                key, rows = now, []
            rows.append((mine[i], cls[i], comp[i], values[ends[i] : ends[i + 1]].copy()))
    yield from flush()


def dense_links(hot: DataFrame, classes: DataFrame, texts: DataFrame, clash: frozenset[int], size: int = 512) -> DataFrame:
    """Links between components among sets whose prefixes reach into frequent columns (class, component, often).

    Sets that hang together through such columns form one block.  A block is dealt out as pairs of
    parts of about ``size`` sets, so that a task holds two parts; whole sets are compared, and only a forest of links is written.
    """
    spark = hot.sparkSession
    hot = durable(hot, "hot")
    entries = hot.select("class", "component", F.explode("often").alias("token"))
    live = entries.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("token")
    edges = entries.join(live, "token").select(F.col("class").alias("src"), F.col("token").alias("dst"))
    block = connected_components(edges).select(F.col("id").alias("class"), F.col("component").alias("block"))
    member = durable(hot.select("class", "component").join(block, "class"), "member")
    parts = member.groupBy("block").agg(F.count(F.lit(1)).alias("g")).filter("g > 1").select("block", F.ceil(F.col("g") / size).cast("int").alias("k"))
    placed = member.join(parts, "block").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    sets = durable(sets_of(classes, placed.select("class"), texts, clash), "sets")
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    dealt = dealt.select("block", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "class", "component").join(sets, "class")
    group = ["block", "low", "high"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.select(*group, "mine", "class", "component", "shingles").repartition(n, *group).sortWithinPartitions(*group)
    links = durable(met.mapInArrow(dense_product, "src long, dst long").hint("rebalance"), "links")
    release(hot, member, sets)
    return links


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, clash: frozenset[int]) -> DataFrame:
    """Pairs of classes whose whole sets have Jaccard >= 0.8.

    One text of every class needed is read again.  A pair meets at its src; a src with many partners is split over salts.
    """
    spark = pairs.sparkSession
    need = pairs.select(F.col("src").alias("class")).union(pairs.select(F.col("dst").alias("class"))).distinct()
    sets = durable(sets_of(classes, need, texts, clash), "sets")
    fan = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("fan"))
    salted = pairs.join(fan, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("fan")).cast("int").alias("salt"))
    partners = salted.join(sets, salted["dst"] == sets["class"]).select("src", "salt", F.lit(1).alias("tag"), "dst", "shingles")
    centres = fan.join(sets, fan["src"] == sets["class"]).select("src", F.explode(F.expr("sequence(0, fan - 1)")).alias("salt"), F.lit(0).alias("tag"), F.col("src").alias("dst"), "shingles")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = centres.union(partners).repartition(n, "src", "salt").sortWithinPartitions("src", "salt", "tag")
    links = durable(met.mapInArrow(compare, "src long, dst long").hint("rebalance"), "links")
    release(sets)
    return links


def join(docs: DataFrame, frequent: int = FREQUENT, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text); see ``vertices``."""
    return vertices(docs, frequent, max_frequent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (a null one last); columns unchanged.

    Rows without words are all kept.  Only rows that leave, and rows that occur more than once, are joined or shuffled.
    """
    key = "_gl_row"
    own = row_key(docs)
    found = durable(vertices(docs, row=own).select("doc_id", "row", "n", "root"), "vertices")
    linked = found.filter("n > 0")
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b"), F.count(F.lit(1)).alias("size"))
    gone = linked.join(best.filter("size > 1").select("root", F.col("b.row").alias("stays")), "root").filter("row != stays").select("row").distinct()
    again = durable(linked.groupBy("row").count().filter("count > 1").select("row"), "again")
    kept = without(docs.withColumn(key, own), F.col(key), durable(gone, "gone"))
    marked = maybe_mark(kept, F.col(key), again, "_gl_again")
    # the bitmap is not exact: rows that occur once, or have no words, pass it as well
    unsure = marked.filter("_gl_again")
    repeated = unsure.join(again.withColumnRenamed("row", key), key, "left_semi").dropDuplicates([key])
    single = unsure.join(again.withColumnRenamed("row", key), key, "left_anti")
    return marked.filter("not _gl_again").select(*docs.columns).union(single.select(*docs.columns)).union(repeated.select(*docs.columns))


def vertices(docs: DataFrame, frequent: int = FREQUENT, max_frequent: int = MAX_FREQUENT, row: Column | None = None) -> DataFrame:
    """doc_id, row (its ``row_key``, unless given), n, class, root (the component's class), component_id for every row of (doc_id, text).

    Every row is a vertex; rows with equal non-empty sets, and rows whose sets have 100 * intersection >=
    80 * union, are linked.  component_id is the smallest doc_id of the component (null doc_ids do not
    name one unless nothing else is there).  Null, empty or wordless text: n_shingles 0, linked with nothing.
    Other columns are ignored; an empty table gives an empty result.
    ``frequent`` and ``max_frequent`` only tune the order of columns; links do not depend on them.
    """
    own = docs.select("doc_id", (row_key(docs) if row is None else row).alias("row"), "text")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = scanned = cached(own.mapInArrow(profile, f"doc_id {kind}, row long, n long, class long, check long, prefix array<long>"))
    clash = frozenset(clashes(rows.filter("n > 0").select(F.col("class").alias("key"), "check")))
    rows = rows.withColumn("class", moved(F.col("class"), F.col("check"), list(clash)))
    classes = durable(rows.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("row").alias("row")), "classes")
    known_rows = durable(rows.select("doc_id", "row", "n", "class"), "rows")
    scanned.unpersist()
    rows, full = known_rows, known_rows.filter("n > 0")
    texts = own.select("row", "text")

    # contraction: near copies through their smallest hashes
    # (a centre has about its members' size, so that a passage alone does not draw documents of all sizes to one centre)
    band = F.floor(F.log("n") / F.log(F.lit(1.08))).cast("int")
    low = classes.select("class", "n", F.size("prefix").alias("p"), band.alias("band"), F.explode(F.slice("prefix", 1, BOTTOM)).alias("token"))
    centre = low.groupBy("token", "band").agg(F.min(F.struct("class", "n")).alias("c"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("token", "band", F.col("c.class").alias("src"), F.col("c.n").alias("cn"))
    near = low.join(centre, ["token", "band"]).filter(f"class != src and 100 * least(n, cn) >= {PERCENT} * greatest(n, cn)")
    near = near.groupBy("src", F.col("class").alias("dst")).agg(F.count(F.lit(1)).alias("shared"), F.first("p").alias("p")).filter(f"4 * shared >= least(p, {BOTTOM})")
    near = durable(near.select("src", "dst"), "near")
    first = verify(near, classes, texts, clash)
    part = durable(connected_components(first).withColumnRenamed("id", "class"), "parts")
    release(near, first)
    swept(spark)

    # the order of columns: frequent ones last
    # (counted over all documents, near copies once)
    inner = durable(part.filter("class != component").select("class"), "inner")
    often = without(classes.select("class", "prefix"), F.col("class"), inner).select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > frequent)
    listed, counts = most_frequent(often, max_frequent)
    if len(listed):
        # prefixes without these columns reach further: the columns found there are counted too
        reach = durable(classes.select("row", "prefix").mapInArrow(touched(listed), "row long"), "reach")
        more = maybe_in(texts, texts["row"], reach).select("text").mapInArrow(repeated_columns, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > frequent)
        listed, counts = joined_counts((listed, counts), most_frequent(more, max_frequent))
        release(reach)
    release(inner)
    kept = classes.mapInArrow(untouched(listed), "class long, n long, prefix array<long>").select("class", "n", F.col("prefix").alias("rare"), F.array().cast("array<long>").alias("often"))
    if len(listed):
        reach = durable(classes.select("row", "prefix").mapInArrow(touched(listed), "row long"), "reach")
        changed = maybe_in(texts, texts["row"], reach).select("text").mapInArrow(reordered(listed, counts, clash), "class long, n long, rare array<long>, often array<long>")
        kept = kept.union(changed.groupBy("class").agg(F.first("n"), F.first("rare"), F.first("often")))
    known = kept.join(part, "class", "left").withColumn("component", F.coalesce("component", "class"))
    columns = known.select("class", "n", F.size("often").cast("long").alias("h"), "component", "rare")

    # the blocked product over rare columns
    n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = columns.select(F.explode("rare").alias("token"), "class", "n", "h", "component")
    dealt = entries.repartition(n_blocks, "token").sortWithinPartitions("token", "component")
    counted = dealt.mapInArrow(block_product, "src long, dst long, bound long").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"), F.first("bound").alias("bound"))
    pairs = counted.filter("shared >= bound").select("src", "dst")
    pairs = durable(pairs, "pairs")
    second = verify(pairs, classes, texts, clash)
    release(pairs)
    swept(spark)
    if len(listed):
        second = second.union(dense_links(known.filter("size(often) > 0").select("class", "component", "often"), classes, texts, clash))

    links = part.filter("class != component").select(F.col("class").alias("src"), F.col("component").alias("dst")).union(second)
    member = connected_components(links).select(F.col("id").alias("class"), F.col("component").alias("root"))
    release(classes, part)
    least = full.groupBy("class").agg(F.min("doc_id").alias("least")).join(member, "class", "left").withColumn("root", F.coalesce("root", "class"))
    name = least.groupBy("root").agg(F.min("least").alias("component_id"))
    info = least.join(name, "root").select("class", "root", "component_id")
    out = rows.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return out.join(info, "class", "left")


import pyarrow.compute  # noqa: E402,F401  (makes pa.compute available)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
