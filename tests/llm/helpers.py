"""Documents for small tests, and brute-force results."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    """Prose with exact and near copies, a shared passage, repeated lines, odd texts, nulls and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 160)))
        if i % 4 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        rows.append([i, text, rng.choice(["en", "de"]), f"s{i % 3}", len(text)])
        if i % 5 == 0:
            for _ in range(rng.randrange(1, 4)):
                parts = text.split(" ")
                for _ in range(rng.randrange(0, 3)):
                    parts[rng.randrange(len(parts))] = rng.choice(words)
                rows.append([1000 + len(rows), " ".join(parts), "en", "s0", 0])
    long = " ".join(rng.choice(words) for _ in range(6000))
    rows += [
        [2000, None, None, None, None], [2001, "", "en", "s1", 0], [2002, " \n\t ", "en", None, 0], [2003, "one", "de", "s1", 3], [2004, "Ünïcode ☃ 😀 漢字 " * 30, "de", "s2", 0], [2005, long, "en", "s0", 0], [2006, "line\nline\nLINE\n\nline\n" * 5, "en", "s0", 0],
        [2007, "a" * 1500, "en", "s0", 0], [2008, "12 34 !!", None, "s0", 0], [None, rows[0][1], "en", "s0", 0], [0, rows[0][1], "en", "s0", 0], [2009, "x <|endoftext|> y's 123", "en", "s1", 0],
    ]
    return [tuple(r) for r in rows]


def frame(spark, rows, extra=True):
    """The documents, with columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("shard", "row", "class", "key", "slot", "n", "w", "token")})
    return df


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])


class Sets:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, a):
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def near_components(texts):
    """Component number of each text under 5-word shingle Jaccard >= 0.8."""
    sets, groups = [shingles(t) for t in texts], Sets(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                groups.join(i, j)
    return [groups.find(i) for i in range(len(texts))], [len(s) for s in sets]


def repeated_bytes(texts, width=400):
    """For each text (bytes), which bytes are covered by a string of ``width`` bytes that starts elsewhere too."""
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                hit[i : i + width] = [True] * width
        out.append(hit)
    return out


def repeated_passages(texts, width, words, sure=400):
    """As ``repeated_bytes``, for unbroken runs of repeated strings with over ``words`` words or ``sure`` bytes."""
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        hit, i = [False] * len(t), 0
        while i <= len(t) - width:
            j = i
            while j <= len(t) - width and count[t[j : j + width]] > 1:
                j += 1
            end = j - 1 + width
            if j > i and (end - i >= sure or len(t[i:end].split()) > words):
                hit[i:end] = [True] * (end - i)
            i = j + 1
        out.append(hit)
    return out


def runs(flags):
    return sum(f and (i == 0 or not flags[i - 1]) for i, f in enumerate(flags))


def rows_by(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r.doc_id].append(r)
    return out
