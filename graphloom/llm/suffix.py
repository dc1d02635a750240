"""Operator 9: removal of long repeated passages with run-length suffix indexes.

A byte is removed if a ``width``-byte string that covers it also starts somewhere else.

1. Winnowing sends every window of ``width`` bytes to the anchor it contains: the smallest hash among its
   ``gram``-byte grams (the last of equals).  Equal windows have equal anchors, wherever they
   are.  A run of windows with one anchor place is a context; anchors are about ``width`` / 2 bytes apart.
2. Contexts that are equal as a whole (128-bit hash) and occur twice are repeated; that settles
   most copies with counts alone.  The distinct contexts of an anchor go on.
3. For groups of such contexts a run-length index is built: suffix order, the Burrows-Wheeler
   transform's runs, and match lengths sampled at the ends of runs only.  Between two
   samples the match length of the following position is one less, so the matching
   statistics are streamed along the text, and window starts with a match of
   ``width`` or more are marked.  (Indexes are per group of anchors, not one for the corpus: memory is bounded.)
   An anchor with very many distinct contexts is settled by counting its windows' 128-bit hashes.

Passages of over ``WORDS`` words may be shorter than ``width``: ``remove_repeats`` counts them from strings of ``SHORT`` bytes,
and looks for those of ``width`` only inside unbroken runs of them, which hold every one.

Texts cross no shuffle, except those whose contexts are compared or that lose bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cached, durable, give_back, maybe_in, maybe_mark, release, row_key, split_hot, swept

WIDTH = 400
SHORT = 150
WORDS = 50
GRAM = 32
SEGMENT = 1 << 19
BATCH = 1 << 19
MANY = 4096  # contexts of about 600 bytes: an index of 2.5 MB
BEYOND = 8  # symbols that the suffix order sees after a window

_table = np.random.default_rng(4099).integers(1, 2**63, 256, np.int64).view(np.uint64)
_factors = [np.uint64(x) for x in np.random.default_rng(4111).integers(1, 2**62, 32, np.int64) * 2 + 1]


def power_hash(h: np.ndarray, size: int, done: int = 1, salt: int = 0) -> np.ndarray:
    """Hashes of all strings of ``size`` (a power-of-two multiple of ``done``) from those of ``done``."""
    k = done.bit_length() + salt
    while done < size:
        h = h[:-done] * _factors[k % 32] + (h[done:] ^ (h[done:] >> np.uint64(31)))
        done, k = 2 * done, k + 1
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Contexts of the texts data[starts:ends]: (text number, anchor, first window, windows).

    ``data`` holds at most 2**24 bytes.
    """
    w = width - gram + 1
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none.view(np.uint64), none, none
    h = mixed(power_hash(_table[data], gram))
    n = len(h)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (low - np.arange(n, dtype=np.uint64))  # equal hashes: the last
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max)
    full[:n] = key
    grid = full.reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - w + 1], before[w - 1 : n])
    place = (low - (least & low)).astype(np.int64)
    lengths = np.maximum(0, ends - starts - width + 1)
    text = np.repeat(np.arange(len(starts)), lengths)
    window = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    if not len(window):
        return none, none.view(np.uint64), none, none
    place = place[window]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(first, len(window)))
    return text[first], h[place[first]], window[first], count


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string column; nulls are empty."""
    col = pa.compute.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def work_units(offsets: np.ndarray, width: int, limit: int = 1 << 18):
    """(number of the first text, starts, ends, base): runs of texts, or overlapping segments of a long one."""
    sizes = np.diff(offsets)
    i, n = 0, len(sizes)
    while i < n:
        if sizes[i] > SEGMENT:
            for s in range(0, int(sizes[i]) - width + 1, SEGMENT):
                e = min(int(sizes[i]), s + SEGMENT + width - 1)
                yield i, np.array([offsets[i] + s]), np.array([offsets[i] + e])
            i += 1
            continue
        j = i
        while j < n and sizes[j] <= SEGMENT and offsets[j + 1] - offsets[i] <= max(limit, sizes[i]):
            j += 1
        yield i, offsets[i:j], offsets[i + 1 : j + 1]
        i = j


def gram_of(width: int) -> int:
    """Long grams seldom meet by chance, so fewer contexts are compared; they stand closer together, so there are more rows."""
    return max(GRAM, 1 << ((width // 2).bit_length() - 1))


def only_spans(rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, spans: list[list[dict]]):
    """The spans as texts of their own: (rows, places in the whole texts, bytes, offsets)."""
    cut = np.array([(i, s["since"], s["until"]) for i, found in enumerate(spans) for s in found], np.int64).reshape(-1, 3)
    parts = [data[offsets[i] + a : offsets[i] + b] for i, a, b in cut.tolist()]
    return rows[cut[:, 0]], cut[:, 1], np.concatenate([data[:0], *parts]), np.concatenate([[0], np.cumsum(cut[:, 2] - cut[:, 1])])


def anchors_of(width: int, gram: int = GRAM):
    """(row, text), or (row, text, spans) for these byte spans only -> (row, anchor, first, windows, c1, c2)."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            at = np.zeros(len(rows), np.int64)
            if batch.num_columns > 2:
                rows, at, data, offsets = only_spans(rows, data, offsets, batch.column(2).to_pylist())
            for i, starts, ends in work_units(offsets, width):
                base = int(starts[0])
                part = data[base : int(ends[-1])]
                text, anchor, first, count = contexts(part, starts - base, ends - base, width, gram)
                raw = part.tobytes()
                digest = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)])
                c = np.frombuffer(digest, np.int64).reshape(-1, 2)
                local = first + base - offsets[i + text] + at[i + text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[i + text]), pa.array(anchor.view(np.int64)), pa.array(local.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(c[:, 0]), pa.array(c[:, 1])],
                    ["row", "anchor", "first", "windows", "c1", "c2"],
                )
            give_back()

    return run


def suffix_order(symbols: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of the text to ``depth`` symbols, groups apart; equal prefixes share a rank."""
    n = len(symbols)
    used = np.bincount(symbols, minlength=1) > 0
    used[0] = True
    dense = np.cumsum(used) - 1
    bits = max(1, int(dense[-1]).bit_length())
    done = min(63 // bits, depth)
    wide = np.concatenate([dense[symbols], np.zeros(done, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(done):
        key <<= bits
        key |= wide[j : j + n]

    def ranked(key):
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(1, key[1:] != key[:-1]), dtype=np.int32)
        return order.astype(np.int32), rank

    def joined(first, *ahead):
        key = first.astype(np.int64)
        for r, distance in ahead:
            key *= n + 1
            key[: max(0, n - distance)] += r[distance:]
        return key

    most = 3 if (n + 1) ** 3 < 1 << 63 else 2  # ranks that fit into one key
    _, rank = ranked(key)
    size = min(depth, (most - 1) * done)
    order, rank = ranked(joined(group, *[(rank, min(d, size - done)) for d in range(0, size, done)]))
    done = size
    while done < depth and rank[order[-1]] < n:
        size = min(depth, most * done)
        order, rank = ranked(joined(rank, *[(rank, min(d, size - done)) for d in range(done, size, done)]))
        done = size
    return order, rank


def match_length(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = 1 << 14) -> np.ndarray:
    """Common prefix lengths of suffix pairs; a 0 symbol ends a text.  ``limit`` pairs at a time bound the memory."""
    out = np.zeros(len(a), np.int32)
    step = np.arange(32, dtype=np.int32)
    padded = np.concatenate([symbols, np.zeros(64, symbols.dtype)])
    for i in range(0, len(a), limit):
        left, right, length = a[i : i + limit], b[i : i + limit], out[i : i + limit]
        live = np.arange(len(left))
        while len(live):
            x = padded[(left[live] + length[live])[:, None] + step]
            y = padded[(right[live] + length[live])[:, None] + step]
            bad = (x != y) | (x == 0)
            stop = bad.any(axis=1)
            length[live] += np.where(stop, bad.argmax(axis=1), 32).astype(np.int32)
            live = live[~stop]
    return out


def repeated_starts(texts: list[bytes], groups: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(flags, offsets): does the string of ``width`` bytes at each place of each text start at another place of the group?

    Run-length index: the match with the suffix before (after) in order is sampled where the
    transform changes its symbol, and streamed along the text from there.
    """
    # the order sees ``BEYOND`` symbols after a window: were they another group's text, two suffixes could be
    # ordered otherwise than those a place before them, and matches would not stream
    pad = BEYOND + 1
    sizes = np.array([len(t) + pad for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    filler = bytes(pad)
    raw = np.frombuffer(b"".join(t + filler for t in texts), np.uint8)
    inside = np.ones(len(raw), bool)
    for j in range(pad):
        inside[offsets[1:] - 1 - j] = False
    symbols = np.where(inside, raw.astype(np.int16) + 1, 0)
    group = np.repeat(np.asarray(groups, np.int32), sizes)
    order, rank = suffix_order(symbols, group, width + BEYOND)
    n = len(symbols)
    count = np.bincount(rank, minlength=n + 2)
    tied = count[rank] > 1
    previous = np.concatenate([[0], symbols[:-1]])
    start = np.zeros(n, bool)
    start[offsets[:-1]] = True
    bwt, head = previous[order], start[order]
    after_tie = ~tied & np.concatenate([[False], tied[:-1]])
    found = tied.copy()
    place = np.arange(n, dtype=np.int32)
    for step in (1, -1):
        suffix, neighbour = (order[1:], order[:-1]) if step == 1 else (order[:-1], order[1:])
        changes = bwt[1:] != bwt[:-1]  # a run of the transform ends between the two
        sampled = changes | head[1:] | head[:-1] | after_tie[suffix]
        s, t = suffix[sampled], neighbour[sampled]
        length = np.where(group[s] == group[t], match_length(symbols, s, t), 0)
        reach = np.zeros(n, np.int32)
        reach[s] = length
        edge = order[0] if step == 1 else order[-1]
        last = np.full(n, -1, np.int32)
        last[s], last[edge] = s, edge
        last[offsets[:-1]] = offsets[:-1]
        last = np.maximum.accumulate(last)
        found |= reach[last] - (place - last) >= width
    left = np.repeat((offsets[1:] - pad).astype(np.int32), sizes) - place
    return found & (left >= width), offsets


def cut_contexts(batches):
    """(text, wanted contexts) -> their bytes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        rows, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        out = [(w["anchor"], r, w["first"], w["windows"], w["settled"], w["many"], data[o + w["first"] : o + w["first"] + w["windows"] + w["width"] - 1].tobytes()) for r, o, ws in zip(rows.tolist(), offsets.tolist(), wanted, strict=False) for w in ws]
        for i in range(0, len(out), 2000):
            a, r, f, n, s, m, b = zip(*out[i : i + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64()), pa.array(f, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.bool_()), pa.array(m, pa.bool_()), pa.array(b, pa.binary())], ["anchor", "row", "first", "windows", "settled", "many", "bytes"])


CUT = "anchor long, row long, first int, windows int, settled boolean, many boolean, bytes binary"


def compare_contexts(width: int):
    """Contexts sorted by (anchor, row, first) -> repeated window starts (row, since, until)."""

    def settle(items: list[tuple]):
        """items: whole anchor groups."""
        texts, groups, own = [], [], []  # own: [(item, offset in its text)]
        for item in items:
            anchor, row, first, windows, _, raw = item
            if own:
                a2, r2, f2, at, k = own[-1][-1][0][0], own[-1][-1][0][1], own[-1][-1][0][2], own[-1][-1][1], len(texts) - 1
                if (a2, r2) == (anchor, row):
                    if f2 == first:
                        continue  # the same place again, from a repeated row
                    offset = at + first - f2
                    if offset <= len(texts[k]):  # overlapping contexts of one anchor form one text, so no place counts twice
                        texts[k] = texts[k][:offset] + raw
                        own[-1].append((item, offset))
                        continue
            texts.append(raw)
            groups.append(anchor)
            own.append([(item, 0)])
        if not texts:
            return None
        _, numbers = np.unique(np.array(groups, np.int64), return_inverse=True)
        flags, offsets = repeated_starts(texts, numbers, width)
        rows, since, until = [], [], []
        for base, members in zip(offsets.tolist(), own, strict=False):
            for (_, row, first, windows, settled, _), at in members:
                if settled:
                    continue
                f = np.concatenate([[False], flags[base + at : base + at + windows], [False]])
                edge = np.flatnonzero(f[1:] != f[:-1])
                rows += [row] * (len(edge) // 2)
                since += (first + edge[::2]).tolist()
                until += (first + edge[1::2]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(since, pa.int32()), pa.array(until, pa.int32())], ["row", "since", "until"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6)]
            for item in zip(*cols, strict=True):
                if size > BATCH and held[-1][0] != item[0]:
                    if (out := settle(held)) is not None:
                        yield out
                    held, size = [], 0
                    give_back()
                held.append(item)
                size += len(item[5])
            give_back()
        if held and (out := settle(held)) is not None:
            yield out

    return run


def window_hashes(width: int):
    """Contexts of very common anchors -> a row for each window."""

    def run(batches):
        for batch in batches:
            seen = set()
            for row, first, windows, raw in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 6)), strict=True):
                if (row, first) in seen:
                    continue
                seen.add((row, first))
                data = _table[np.frombuffer(raw, np.uint8)]
                both = []
                for salt in (0, 9):
                    total, at = np.zeros(windows, np.uint64), 0
                    for k, bit in enumerate(b for b in range(width.bit_length() - 1, -1, -1) if width >> b & 1):
                        h = power_hash(data, 1 << bit, salt=salt)
                        total = mixed(total * _factors[k + salt] + h[at : at + windows])
                        at += 1 << bit
                    both.append(total.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array([row] * windows, pa.int64()), pa.array(np.arange(first, first + windows, dtype=np.int32))], ["w1", "w2", "row", "since"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key(docs).alias("row"), "text")


def repeated_windows(own: DataFrame, width: int = WIDTH, many: int = MANY, gram: int = GRAM, within: DataFrame | None = None, used: list | None = None) -> DataFrame:
    """(row, text) -> row, since, until: starts of windows that occur elsewhere too, as half-open ranges.

    ``within`` (row, spans): only windows inside these byte spans are looked at; no window may lie in two of them.
    ``used`` collects the tables that nothing needs once the result is written.
    """
    spark = own.sparkSession
    texts = own.select("row", "text")
    long = texts.filter(F.octet_length("text") >= width)
    if within is not None:
        long = maybe_in(long, F.col("row"), within.select("row")).join(within, "row").select("row", "text", "spans")
    anchors = cached(long.mapInArrow(anchors_of(width, gram), "row long, anchor long, first int, windows int, c1 long, c2 long"))
    twice = durable(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    live = durable(split_hot(maybe_in(anchors, F.col("anchor"), twice.select("anchor")), twice, ["anchor"]), "live")
    kinds = durable(live.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "windows")).alias("x")), "kinds")
    whole = split_hot(live, kinds.filter("n > 1").select("anchor", "c1", "c2", "n"), ["anchor", "c1", "c2"])
    marks = whole.select("row", F.col("first").alias("since"), (F.col("first") + F.col("windows")).alias("until"))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = kinds.join(several, "anchor").select(
        "x.row", F.struct("anchor", "x.first", "x.windows", (F.col("n") > 1).alias("settled"), (F.col("k") > many).alias("many"), F.lit(width).alias("width")).alias("w")
    )
    wanted = durable(wanted.groupBy("row").agg(F.collect_list("w").alias("wanted")), "wanted")
    pieces = maybe_in(texts, texts["row"], wanted.select("row")).join(wanted, "row").select("row", "text", "wanted").mapInArrow(cut_contexts, CUT)
    pieces = durable(pieces, "pieces")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.filter("not many").repartition(n, "anchor").sortWithinPartitions("anchor", "row", "first")
    marks = marks.union(dealt.mapInArrow(compare_contexts(width), "row long, since int, until int"))
    # (row, since) is unique but for repeated rows, which repeat whole contexts
    windows = pieces.filter("many").mapInArrow(window_hashes(width), "w1 long, w2 long, row long, since int").dropDuplicates(["w1", "w2", "row", "since"])
    windows = durable(windows, "windows")
    common = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    if used is not None:
        used += [anchors, twice, live, kinds, wanted, pieces, windows]
    return marks.union(touching(windows.join(common, ["w1", "w2"]).select("row", "since")))


def touching(starts: DataFrame) -> DataFrame:
    """(row, since), each once -> row, since, until: runs of successive starts."""
    run = F.col("since") - F.row_number().over(W.partitionBy("row").orderBy("since"))
    return starts.withColumn("run", run).groupBy("row", "run").agg(F.min("since").alias("since"), (F.max("since") + 1).alias("until")).select("row", "since", "until")


def unbroken(width: int):
    """(row, ranges) -> (row, spans): byte spans of unbroken runs of window starts."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int64) << 32, np.diff(ranges.offsets.to_numpy()))
            since, until = (row + x.to_numpy() for x in ranges.flatten().flatten())
            order = np.argsort(since)
            since, until = since[order], np.maximum.accumulate(until[order])
            first = np.flatnonzero(np.append(True, since[1:] > until[:-1]))
            a, b = since[first], until[np.append(first[1:], len(since)) - 1]
            offsets = np.append(0, np.cumsum(np.bincount(a >> 32, minlength=batch.num_rows)))
            ends = [pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (a, b + (width - 1))]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(ends, ["since", "until"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["row", "spans"])

    return run


def merged_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """The bytes that the spans cover, as maximal spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["since"], s["until"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def passages(raw: np.ndarray, spans: list[dict], words: int) -> list[tuple[int, int]]:
    """Byte spans of the repeated passages with over ``words`` words, or of ``WIDTH`` bytes or more."""
    return merged_spans([s for s in spans if s["until"] - s["since"] >= WIDTH or len(raw[s["since"] : s["until"]].tobytes().split()) > words])


def removal_spans(own: DataFrame, width: int = WIDTH, gram: int = GRAM, within: DataFrame | None = None, used: list | None = None) -> DataFrame:
    """(row, text) -> row, spans (bytes since, until of unbroken runs of repeated strings), one row for each text that has some."""
    marks = repeated_windows(own, width, gram=gram, within=within, used=used)
    ranges = marks.groupBy("row").agg(F.collect_set(F.struct("since", "until")).alias("ranges"))
    return durable(ranges.mapInArrow(unbroken(width), "row long, spans array<struct<since:int,until:int>>"), "spans")


def remove_repeats(docs: DataFrame, width: int = WIDTH, short: int = SHORT, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes for every row.

    Null text: as empty.  Texts shorter than ``width``: nothing removed.  Repeated rows repeat each other.
    Other columns are ignored; an empty table gives an empty result.  kept_sha256 is of the remaining bytes,
    which need not be valid UTF-8 (``clean`` keeps whole characters).

    n_passages and passage_bytes count what ``clean(docs, short, words)`` would cut, by bytes: nothing of it is removed here
    unless strings of ``width`` bytes cover it.  ``short`` is at most ``width``.
    """
    own, used = keyed(docs), []
    short = min(short, width)
    near = removal_spans(own, short, gram_of(short), used=used)
    for table in used:
        table.unpersist()
    release(*used)
    swept(docs.sparkSession)
    # the short strings in a repeated string of ``width`` bytes all repeat: it lies in one unbroken run
    within = near.select("row", F.filter("spans", lambda s: s["until"] - s["since"] >= width).alias("spans")).filter(F.size("spans") > 0)
    spans = removal_spans(own, width, gram_of(width), within)

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            removed, runs, digests, several, covered = [], [], [], [], []
            for i, (spans, other) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw, at, h = data[offsets[i] : offsets[i + 1]], 0, hashlib.sha256()
                found, long = merged_spans(spans or []), passages(raw, other, words)
                for a, b in found:
                    h.update(raw[at:a].tobytes())
                    at = b
                h.update(raw[at:].tobytes())
                removed.append(sum(b - a for a, b in found))
                runs.append(len(found))
                digests.append(h.hexdigest())
                several.append(len(long))
                covered.append(sum(b - a for a, b in long))
            numbers = [pa.array(x, pa.int64()) for x in (removed, runs, several, covered)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string())], ["row", "n_removed", "n_spans", "n_passages", "passage_bytes", "kept"])

    both = near.withColumnRenamed("spans", "near").join(spans, "row", "left")
    hit = maybe_in(own.select("row", "text"), F.col("row"), near.select("row")).join(both, "row").select("row", "text", "spans", "near")
    changed = hit.mapInArrow(cut, "row long, n_removed long, n_spans long, n_passages long, passage_bytes long, kept string").dropDuplicates(["row"])
    base = own.select("doc_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    out = base.join(changed, "row", "left")
    zero = F.lit(0).cast("long")
    number = {n: F.coalesce(n, zero).alias(n) for n in ("n_removed", "n_spans", "n_passages", "passage_bytes")}
    return out.select("doc_id", "n_bytes", number["n_removed"], number["n_spans"], F.coalesce("kept", "whole").alias("kept_sha256"), number["n_passages"], number["passage_bytes"])


def clean(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """``docs`` with repeated passages cut out of text, other columns unchanged, but n_chars (if there) is the new length.

    A passage is an unbroken run of repeated strings of ``width`` bytes; it goes if it has over ``words`` words (parts
    between ASCII white space) or ``WIDTH`` bytes or more.  Spans shrink to whole characters, so the text stays valid; a text that is removed entirely becomes empty.
    """
    row = "_gl_row"
    kept = docs.withColumn(row, row_key(docs))
    spans = removal_spans(kept.select(F.col(row).alias("row"), "text"), width)

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        out = []
        for i, found in enumerate(spans.to_pylist()):
            raw, at, parts = data[offsets[i] : offsets[i + 1]], 0, []
            for a, b in passages(raw, found, words) if found else []:
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(raw[at:a].tobytes())
                at = b
            parts.append(raw[at:].tobytes())
            out.append(b"".join(parts).decode("utf-8"))
        return pa.array(out, pa.string())

    marked = maybe_mark(kept, F.col(row), spans.select("row"), "_gl_maybe")
    some = marked.filter("_gl_maybe").join(spans.withColumnRenamed("row", "_gl_key").withColumnRenamed("spans", "_gl_spans"), F.col(row) == F.col("_gl_key"), "left")
    text = F.when(F.col("_gl_spans").isNull(), F.col("text")).otherwise(cut(F.coalesce("text", F.lit("")), "_gl_spans"))
    some = some.withColumn("text", text)
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col("_gl_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return marked.filter("not _gl_maybe").select(*docs.columns).union(some.select(*docs.columns))


import pyarrow.compute  # noqa: E402,F401  (makes pa.compute available)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
