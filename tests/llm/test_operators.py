import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, corpus, frame, near_components, repeated_bytes, repeated_passages, rows_by, runs
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, embeddings, jaccard, langid, licenses, mixing, packing, quality, sharding, suffix

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return frame(spark, ROWS)


def empty(spark):
    return frame(spark, []).limit(0)


# ---- 1

def test_sharding(spark, docs):
    tree = sharding.HashTree.uniform(2, 3, 4)
    out = sharding.shard_documents(docs, tree, tree.grown()).collect()
    assert len(out) == len(ROWS) and {r.law for r in out} == {"key"}
    assert all(r.grown_shard in (r.shard, 24) for r in out) and all(0 <= r.shard < 24 and r.shard // 12 == r.region and r.shard // 4 % 3 == r.rack for r in out)
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    by = {r.doc_id: r.shard for r in out}
    assert all(by[r.doc_id] == r.shard for r in out)
    expected = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == expected
    assert sharding.shard_documents(empty(spark), tree).count() == 0


def test_hash_tree_movement(spark):
    keys = spark.range(20000)
    tree = sharding.HashTree.uniform(2, 3, 4)
    place = lambda t: {r.id: r for r in sharding.place(keys, t, F.col("id")).collect()}
    a = place(tree)
    counts = Counter(r.shard for r in a.values())
    assert len(counts) == 24 and max(counts.values()) < 1.25 * 20000 / 24
    heavier = place(tree.with_weight(5, 3.0))  # in region 0, rack 1
    moved = [k for k in a if a[k].shard != heavier[k].shard]
    assert moved and all(heavier[k].region == 0 for k in moved)
    assert all(a[k].rack == heavier[k].rack or heavier[k].rack == 1 for k in moved if a[k].region == 0)
    assert abs(Counter(r.shard for r in heavier.values())[5] - 20000 * 3 / 26) < 250
    more = tree
    now = a
    for n in range(24, 28):
        more = more.grown()
        then = place(more)
        assert all(then[k].shard in (now[k].shard, n) for k in now)
        now = then


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("shard"), sharding.HashTree.uniform(), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


# ---- 2

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_documents(spark, docs, library):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs).collect())
    expected = Counter()
    for d, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == expected
    ids = docs.select("doc_id", "text", bpe.ids_column(F.col("text"), bpe.tokenizer_path()).alias("ids"))
    assert all((r.text or "") == r.back for r in ids.select("text", bpe.text_column(F.col("ids"), bpe.tokenizer_path()).alias("back")).collect())
    assert bpe.encode_documents(empty(spark)).count() == 0


def test_bpe_odd_texts(library):
    import random

    rng, model = random.Random(3), bpe.NumpyBPE(bpe.tokenizer_path(), table_symbols=500)
    pieces = ["a", "aa", "the", " ", "\n", "é", "₏", "\U000107bb", "日本", "<|endoftext|>", "'s", "1", "\x85", "\x1c", "​", "!", "́", "<|", "\t"]
    for _ in range(800):
        text = "".join(rng.choice(pieces) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(40)))
        ids, offsets = model.encode_batch([text, None, text])
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected * 2 and offsets.tolist() == [0, len(expected), len(expected), 2 * len(expected)]
        assert model.decode(ids) == library.decode(expected * 2, skip_special_tokens=False)
    long = "ab" * 20000 + "a" * 9999
    assert model.encode_batch([long])[0].tolist() == library.encode(long, add_special_tokens=False).ids
    assert model.decode(np.array([222, 50256])) == library.decode([222, 50256], skip_special_tokens=False)


# ---- 3

def test_language_id(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.identify(real).join(real, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == real.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)


def test_language_id_edges(spark, docs):
    out = rows_by(langid.identify(docs))
    assert sum(map(len, out.values())) == len(ROWS)
    for d in (2000, 2001, 2002, 2008):
        assert out[d][0].lang_pred == "und" and out[d][0].score == 0
    assert out[2003][0].lang_pred in ("en", "de") and out[None][0].held_out
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = frame(spark, [(d, t, None, s, n) for d, t, _, s, n in ROWS])
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.accepted(unlabelled).count() == sum(bool(t and any(c.isalpha() for c in t)) for _, t, *_ in ROWS)


@pytest.mark.parametrize("count", [1, 4, 24])
def test_accepted_whatever_the_number_of_languages(spark, count):
    import random

    rng = random.Random(5)
    rows, clean = [], []
    for k in range(count):
        # a language: syllables of its own letters
        letters = [rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçáíóú", 12) for _ in range(3)]
        syllables = ["".join(rng.choice(x) for x in letters) for _ in range(25)]
        for i in range(30):
            text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([4, 20, 200])))
            clean.append(len(rows))
            rows.append((len(rows), text, f"l{k}"))
    other = ["我们今天去学校学习中文因为老师说语言很重要 他们喜欢在公园里散步 天气很好", "Сегодня мы пошли в школу потому что учитель сказал что язык очень важен", "=== --- a *** ### 12 34", "q" * 300]
    other += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(5)]
    other += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(60)) for _ in range(5)]
    docs = spark.createDataFrame(rows + [(10**6 + i, x, None) for i, x in enumerate(other)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.accepted(docs).collect()) == clean


def test_profile_is_the_bundle_of_bound_vectors():
    code, doc = langid.trigrams(["ab c", None, "", "é1"])
    assert doc.tolist() == [0, 0, 0, 3] and len(code) == 4
    v, dim = langid.letter_vectors(64), 64
    a, b = langid.letter_symbols()[[ord("a"), ord("b")]]
    assert (langid.gram_vectors(code[:1], dim) == np.roll(v[0], 2) * np.roll(v[a], 1) * v[b]).all()


# ---- 4

def test_quality(spark, docs):
    out = quality.rate_documents(docs).collect()
    expected = Counter()
    for d, t, *_ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        expected[d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(covered), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == expected
    assert all(not r.kept for r in out if r.base_failed)
    assert quality.rate_documents(empty(spark)).count() == 0


def test_quality_verdict(spark):
    good = [(i, " ".join(["the", "cat", "of", "a", "house", "went", "to", "and", "is", "in"][(i * 7 + j * 3 + j // 10) % 10] + ("s" if j % 13 == 0 else "") + str(j % 17 if j % 50 == 0 else "") for j in range(90)), "en", "s", 0) for i in range(40)]
    odd = [(100, " ".join(f"|{i}|#{i}%" for i in range(100)), "en", "s", 0), (101, "short | text", "en", "s", 0)]
    refs = quality.learn(frame(spark, good + odd))
    assert refs.languages == ("en",) and "the" in refs.words[0]
    judge = quality.judge(refs, quality.Limits())
    far, near = judge.rows([odd[0][1], good[3][1]], ["en", "xx"])
    assert far[-2] > 0.28 and not far[6] and near[-2] < 0.15 and near[-1] < 0.3
    assert judge.rows([odd[1][1]], ["en"])[0][-2:] == (None, None)
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.jensen_shannon(p, q) == 1 and quality.jensen_shannon(p, p) == 0


# ---- 5

def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return words, places, labels


def brute_labels(words, k=licenses.K, gap=licenses.GAP, need=licenses.COVERAGE):
    """Templates whose merged diagonals cover enough of their words, and the best share."""
    found, best = set(), 0.0
    for name, body in licenses.TEMPLATES.items():
        t = brute_base(body)[0]
        at = {}
        for j in range(len(t) - k + 1):
            at.setdefault(tuple(t[j : j + k]), []).append(j)
        lines = {}
        for i in range(len(words) - k + 1):
            for j in at.get(tuple(words[i : i + k]), ()):
                lines.setdefault(i - j, set()).add(j)
        previous, cluster = None, set()
        for d in [*sorted(lines), None]:
            if previous is not None and (d is None or d - previous > gap):
                share = len({x for j in cluster for x in range(j, j + k)}) / len(t)
                best = max(best, share)
                if share >= need:
                    found.add(name)
                cluster = set()
            if d is not None:
                cluster |= lines[d]
                previous = d
    return found, best


def test_license_scan(spark, docs):
    mit = licenses.TEMPLATES["mit-text"]
    edited = mit.replace("without restriction", "without any restriction").replace("publish, ", "")
    texts = [
        f"Intro. {mit} end", f"x {edited} y", " ".join(mit.split()[:20]), "Licensed under the APACHE license, Version 2.0.", "cc-by cc by CC\nBY", "KK mit liİcense MITK License", "This work is licensed under the GNU General Public License, version 3.",
        "mit license " * 50 + "gnu general public license", licenses.TEMPLATES["bsd-text"].upper(), f"{mit} {mit}",
    ]
    rows = ROWS + [(5000 + i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5000, texts[0], "en", "s", 0)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(frame(spark, rows)).collect())
    expected = Counter()
    for d, t, *_ in rows:
        words, places, labels = brute_base(t)
        found, best = brute_labels(words)
        expected[d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), round(best, 9)] += 1
    assert got == expected
    assert any("mit-text" in k[6] for k in got if k[0] == 5001)
    assert licenses.scan(empty(spark)).count() == 0


def test_native_plans(spark, docs):
    for df in (licenses.votes(docs, licenses.TEMPLATES), mixing.mix_documents(docs)):
        assert not re.search("Python|Pandas|Arrow|MapIn", df._jdf.queryExecution().executedPlan().toString())


# ---- 6

@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    rows = corpus(seed, 80)
    out = jaccard.join(frame(spark, rows), frequent=3)
    part, sizes = near_components([t for _, t, *_ in rows])
    name = {}
    for c, (d, *_) in zip(part, rows, strict=True):
        name[c] = d if name.get(c) is None else name[c] if d is None else min(name[c], d)
    expected = Counter((d, n, name[c] if n else d) for (d, *_), n, c in zip(rows, sizes, part, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == expected


def test_jaccard_does_not_depend_on_the_order(spark):
    """Passages in many documents, and documents made of passages only."""
    import random

    rng = random.Random(9)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3)]
    rows = [(i, f"{passages[i % 3]} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 8, 9, 10, 11, 30]))), "en", "s", 0) for i in range(120)]
    part, _ = near_components([r[1] for r in rows])
    least = {}
    for i, c in enumerate(part):
        least.setdefault(c, i)
    for frequent, limit in ((2, 10**6), (2, 5), (10**6, 1)):
        out = {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows), frequent, limit).collect()}
        assert out == {i: least[c] for i, c in enumerate(part)}
    assert jaccard.join(empty(spark)).count() == 0


def test_first_of_each(spark, docs):
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    part, sizes = near_components([t for _, t, *_ in ROWS])
    best = {}
    for (d, *_), n, c in zip(ROWS, sizes, part, strict=True):
        if n:
            best[c] = min(best.get(c, (True, None, 0)), (d is None, d if d is not None else 10**9, 0))
    expected = Counter([b[1] for b in best.values()] + [d for (d, *_), n in zip(ROWS, sizes, strict=True) if not n])
    assert Counter(r.doc_id for r in kept.collect()) == expected


def test_first_of_each_keeps_wordless_rows_under_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "maybe_mark", lambda df, column, keys, name: df.withColumn(name, F.lit(True)))
    rows = [(None, None, "en", "s", 0)] * 7 + [(None, "", "en", "s", 0)] * 5 + [(1, " ", "en", "s", 0)] * 3 + [(2, "some words here", "en", "s", 0)] * 4 + [(3, "other words", "en", "s", 0)]
    kept = Counter((r.doc_id, r.text) for r in jaccard.first_of_each(frame(spark, rows)).collect())
    assert kept == {(None, None): 7, (None, ""): 5, (1, " "): 3, (2, "some words here"): 1, (3, "other words"): 1}


# ---- 7

def brute_vectors(rows, threshold=0.98):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, label) else None for _, v, label in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= threshold or rows[i][1] == rows[j][1]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    name = {}
    for i, (d, *_) in enumerate(rows):
        name[find(i)] = min(name.get(find(i), d), d)
    return Counter((d, links[i], name[find(i)], d == name[find(i)]) for i, (d, *_) in enumerate(rows))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for c in range(25):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12])
            rows.append((i, [float(np.float32(x)) for x in v], int(c % 3)))
            i += 1
    rows += [(i, [1.0] * 16, None), (i + 1, None, 1), (i + 2, [0.0] * 16, 1), (i + 3, [float("nan")] * 16, 1), (i + 4, [None] * 16, 1), (i + 5, [], 1), (i + 6, [2.0, 0.0], 1), (i + 7, [1.0, 0.0], 1), (i + 8, [1.0, 0.0], 2), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("clash"))
    for block in (2048, 4):
        got = Counter(tuple(r) for r in embeddings.near_duplicates(df, block=block).collect())
        assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, [1.0, 0.0], 1), (7, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in embeddings.near_duplicates(null_id).collect()} == {(None, 1, None, True), (7, 1, 7, True)}


def test_embedding_plan_keeps_the_miss_rate():
    for n in (10, 10**5, 10**9):
        bits, tables = embeddings.plan(n, 0.98, 1e-6)
        together = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - together) ** tables <= 1e-6


# ---- 8

def brute_edf(quanta):
    total, counts, out = sum(quanta), [0] * len(quanta), []
    for t in range(total):
        ready = [((c + 1) * total, a, i) for i, (c, a) in enumerate(zip(counts, quanta, strict=True)) if c < a and c * total // a <= t]
        i = min((-(-d // a), i) for d, a, i in ready)[1]
        counts[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 3.0, "c": 1.0, "": 1.0}])
def test_mixing(spark, weights):
    import random

    rng = random.Random(1)
    sources = ["a"] * 700 + ["b"] * 90 + ["c"] * 33 + [None] * 5
    rng.shuffle(sources)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string")
    out = mixing.mix_documents(df, weights, block_rows=4, period=20).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(sources))) and len({(r.slot, r.offset) for r in out}) == len(out)
    assert all(r.release <= r.slot < r.deadline for r in out)
    blocks = {}
    for r in out:
        assert blocks.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block) and r.block == r["index"] // 4 and r.offset == r["index"] % 4
    first = [r for r in out if r.phase == 0]
    quanta = {r.source: r.quanta for r in first}
    order = sorted(quanta, key=lambda s: (s is not None, s))
    template = brute_edf([quanta[s] for s in order])
    period = sum(quanta.values())
    assert period == first[0].phase_slots
    for slot, (source, _) in blocks.items():
        if slot <= max(r.slot for r in first):
            assert source == order[template[slot % period]]
    counts = Counter()
    for t in range(period):
        for i, s in enumerate(order):
            assert abs(counts[i] - quanta[s] * t / period) < 1
        counts[template[t]] += 1


def test_interleave(spark, docs):
    out = mixing.interleave(docs, block_rows=4, period=12)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, t) for d, t, *_ in ROWS)
    head = [r.source for r in out.limit(24).collect()]
    assert len(set(head)) >= 3
    assert mixing.interleave(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("weights", [[0.9996, 0.0004], [(1 / 3) ** 0.5] + [(2 / 57) ** 0.5] * 19])
def test_target_weights_do_not_drift(weights):
    paths, bound = mixing.tree(weights)
    slots, total = 60_000, sum(weights)
    seen = set()
    for w, path in zip(weights, paths, strict=True):
        k = 0
        while (t := mixing.slot_of(k, path)) < slots:
            assert t not in seen and abs(k - w / total * t) < 1 and abs(k + 1 - w / total * (t + 1)) < 1
            seen.add(t)
            k += 1
    assert len(seen) == slots and bound < 1


def test_interleave_follows_the_target_weights(spark):
    df = spark.createDataFrame([(i, "b" if i % 500 == 0 else "a") for i in range(20_000)], "doc_id long, source string")
    head = [r.source for r in mixing.interleave(df, {"a": 0.9996, "b": 0.0004}, block_rows=1).collect()]
    count = 0
    for t, source in enumerate(head[:19_000]):
        assert abs(count - 0.0004 * t) < 1
        count += source == "b"
    assert count and head.count("b") == 40
    plan = mixing.target_schedule(df, ["doc_id"], block_rows=4).collect()
    assert len({(r.slot, r.offset) for r in plan}) == len(plan) == 20_000 and max(r.slot for r in plan) == 5_000 - 1


def test_mixing_beyond_the_lookup(spark, monkeypatch):
    rows = [(i, f"s{i % 17 % (i % 5 + 3)}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    small = mixing.mix_documents(df, block_rows=4, period=20).collect()
    monkeypatch.setattr(mixing, "MAX_LOOKUP", 10)
    large = mixing.mix_documents(df, block_rows=4, period=20)
    assert sorted(map(str, large.collect())) == sorted(map(str, small)) and len(small) == 3000
    monkeypatch.setattr(mixing, "MAX_PARTS", 1)
    assert sorted(r.doc_id for r in mixing.interleave(df, block_rows=4).collect()) == list(range(3000))


# ---- 9

def test_suffix_documents(spark, docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect())
    texts = [(t or "").encode() for _, t, *_ in ROWS]
    expected = Counter()
    for (d, *_), t, hit in zip(ROWS, texts, repeated_bytes(texts), strict=True):
        expected[d, len(t), sum(hit), runs(hit), hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest()] += 1
    assert got == expected and sum(n for *_, n, _, _ in got) > 0
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_suffix_passages(spark):
    """Passages of over 50 words that repeat are counted where they have under 400 bytes, too; only strings of 400 bytes are removed."""
    import random

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 7))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    short, long, pair = prose(60), prose(200), [prose(45), prose(45)]
    assert len(short) < 400 < len(long)
    texts = [prose(300) for _ in range(12)]
    for i, passage in ((0, short), (1, short), (2, long), (3, long), (4, pair[0]), (5, pair[0])):
        texts[i] = prose(100) + "\n" + passage + "\n" + prose(100)
    texts[6] = prose(40) + "\n" + short + " " + pair[0] + " " + pair[1] + "\n" + prose(30) + "\n" + long[300:]
    texts[7] = pair[0] + " " + pair[1] + " " + prose(80)
    texts += [long[:600] + prose(20) + long[500:], None, "", texts[2]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[9]]  # a repeated row
    raw = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for (d, *_), t, hit, near in zip(rows, raw, repeated_bytes(raw), repeated_passages(raw, 150, 50), strict=True):
        want[d, len(t), sum(hit), runs(hit), hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest(), runs(near), sum(near)] += 1
    found = suffix.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.passage_bytes) for r in found) == want
    by = {r.doc_id: r for r in found}
    assert all(by[i].n_removed == 0 and by[i].n_passages == 1 and by[i].passage_bytes >= len(short) for i in (0, 1))
    assert by[2].n_removed > 0 and not any(by[i].n_passages for i in (4, 5, 8, 10, 11))


@pytest.mark.parametrize("many", [2, 4096])
def test_suffix_small_width_and_common_anchors(spark, many):
    """A short width meets all border cases; ``many`` = 2 settles anchors by counting windows."""
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("abcd") for _ in range(700))
    rows = []
    for i in range(40):
        a = rng.randrange(500)
        rows.append((i, base[a : a + rng.randrange(30, 190)] + "".join(rng.choice("abxyzé") for _ in range(rng.randrange(40))), "en", "s", 0))
    rows += [(100, "a" * 300, "en", "s", 0), (101, "ab" * 120, "en", "s", 0), (102, "x" * 39, "en", "s", 0)]
    own = suffix.keyed(frame(spark, rows))
    width = 48
    marks = suffix.repeated_windows(own, width, many)
    text = {r.row: r.text.encode() for r in own.collect()}
    found = {k: [False] * len(t) for k, t in text.items()}
    for r in marks.collect():
        for i in range(r.since, r.until + width - 1):
            found[r.row][i] = True
    assert [found[k] for k in text] == repeated_bytes(list(text.values()), width)


def test_run_length_index():
    import random

    rng = random.Random(8)
    for trial in range(40):
        width = rng.choice([5, 12, 40])
        base = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(rng.randrange(10, 250)))
        texts, groups = [], []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(len(base))
            texts.append(base[a : rng.randrange(a, len(base) + 1)] + bytes(rng.choice(b"abxyz") for _ in range(rng.randrange(20))))
            groups.append(rng.randrange(2))
        flags, offsets = suffix.repeated_starts(texts, np.array(groups), width)
        count = Counter((g, t[i : i + width]) for g, t in zip(groups, texts, strict=True) for i in range(len(t) - width + 1))
        for t, g, o in zip(texts, groups, offsets, strict=False):
            for i in range(len(t)):
                assert flags[o + i] == (i + width <= len(t) and count[g, t[i : i + width]] > 1)


def test_run_length_index_of_groups():
    """Whatever group's text comes next, a match that ends with its text is found (150: the order looks 224 symbols ahead)."""
    import random

    rng = random.Random(1)
    for width in (150, 400, 115):
        texts, groups = [], []
        for g in range(60):
            base = bytes(rng.choice(b"abcdefgh") for _ in range(width + 60))
            for _ in range(4):
                a = rng.randrange(50)
                texts.append(bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(9))) + base[a : rng.randrange(a + width, len(base) + 1)])
                groups.append(g)
        order = rng.sample(range(len(texts)), len(texts))
        texts, groups = [texts[i] for i in order], [groups[i] for i in order]
        flags, offsets = suffix.repeated_starts(texts, np.array(groups), width)
        count = Counter((g, t[i : i + width]) for g, t in zip(groups, texts, strict=True) for i in range(len(t) - width + 1))
        for t, g, o in zip(texts, groups, offsets, strict=False):
            assert flags[o : o + len(t)].tolist() == [i + width <= len(t) and count[g, t[i : i + width]] > 1 for i in range(len(t))]


def test_clean(spark, docs):
    out = suffix.clean(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    by = rows_by(out)
    texts = [(t or "").encode() for _, t, *_ in ROWS]
    for (d, t, *_), hit in zip(ROWS, repeated_bytes(texts), strict=True):
        if not any(hit):
            assert any(r.text == t for r in by[d])
        elif t.isascii():
            assert any(r.text == "".join(c for c, h in zip(t, hit, strict=True) if not h) and r.n_chars == len(r.text) for r in by[d])


# ---- 10

def test_packing(spark, docs):
    model = bpe.load(bpe.tokenizer_path())
    for length, group in ((64, 10**6), (64, 500), (2048, 10**6)):
        out = packing.pack(docs, length=length, group_tokens=group).collect()
        assert len({r.pack_id for r in out}) == len(out)
        got = Counter()
        pieces = {}
        for r in out:
            ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
            assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length and len(r.segments) == r.n_segments
            assert (ids[r.n_tokens :] == packing.PAD).all() and not positions[r.n_tokens :].any()
            for a, b, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.segments, strict=False):
                assert b - a == s.length and (positions[a:b] == np.arange(b - a)).all()
                pieces.setdefault(s.doc_id, Counter())[s.piece, ids[a:b].tobytes()] += 1
        for d, t, *_ in ROWS:
            ids = model.encode_batch([t])[0].astype("<u2")
            for k in range(-(-len(ids) // length)):
                got[d, k, ids[k * length : (k + 1) * length].tobytes()] += 1
        assert got == Counter({(d, k, b): n for d, c in pieces.items() for (k, b), n in c.items()})
    assert packing.pack(empty(spark)).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 3000)
    rows = packing.best_fit_decreasing(lengths, 100)
    assert sorted(p for r in rows for p in r) == list(range(3000)) and all(sum(lengths[p] for p in r) <= 100 for r in rows)
    free, expected = [], 0  # the same rule without a tree
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            expected += 1
            free.append(100 - n)
    assert len(rows) == expected


# ---- shared

def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {a: find(a) for a in parent if any(a in e and e[0] != e[1] for e in edges)}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_key_filter(spark):
    keys, df = spark.range(0, 1000, 7), spark.range(1000).withColumnRenamed("id", "k")
    assert {r.k for r in common.maybe_in(df, F.col("k"), keys).collect()} >= set(range(0, 1000, 7))
    assert {r.k for r in common.without(df, F.col("k"), keys).collect()} == {k for k in range(1000) if k % 7}
    assert common.maybe_in(df, F.col("k"), keys).count() < 160


@pytest.fixture
def weak_row_hashes(monkeypatch):
    """Most documents share the first hash with another one."""
    monkeypatch.setattr(common, "row_hashes", lambda: (F.pmod(F.xxhash64("doc_id", "text"), F.lit(64)), F.xxhash64(F.lit(7), "doc_id", "text")))


def test_row_keys_tell_documents_apart(spark, docs, weak_row_hashes):
    key, _ = common.row_hashes()
    different = docs.select("doc_id", "text").distinct().count()
    assert docs.select(key.alias("k")).distinct().count() < different
    assert docs.select(common.row_key(docs).alias("k")).distinct().count() == different
    assert docs.select("doc_id", "text", common.row_key(docs).alias("k")).distinct().count() == different
    assert empty(spark).select(common.row_key(empty(spark))).count() == 0


def test_results_do_not_depend_on_row_hashes(spark, docs, weak_row_hashes):
    test_suffix_documents(spark, docs)
    test_first_of_each(spark, docs)


def test_jaccard_with_sets_that_share_half_a_hash(spark, monkeypatch):
    from pyspark import cloudpickle

    whole = jaccard.set_hash
    monkeypatch.setattr(jaccard, "set_hash", lambda s: (whole(s)[0] % 64, whole(s)[1]))
    seen = []
    monkeypatch.setattr(jaccard, "clashes", lambda keys: seen.append(common.clashes(keys)) or seen[-1])
    cloudpickle.register_pickle_by_value(jaccard)  # so that the workers get the weak hash too
    try:
        test_jaccard(spark, 3)
    finally:
        cloudpickle.unregister_pickle_by_value(jaccard)
    assert seen[0]


def test_gapless_index_of_a_hot_group(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.when(F.col("id") % 2 == 0, F.lit(1)).alias("o"))
    out = common.gapless_index(df, ["g"], ["o"], "i").collect()
    for g in (0, 1):
        assert sorted(r.i for r in out if r.g == g) == list(range(sum(r.g == g for r in out)))
