"""Operator 2: byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are cut into words by the vocabulary's pattern; the distinct new words of a
batch are laid out as symbols in one flat array.  A round looks every adjacent
pair up by binary search in the sorted array of mergeable pair keys, takes each
word's lowest rank, and merges all its occurrences from the left.  Finished words leave
the array, so later rounds only touch long words.  Encoded words stay in a
bounded table per task and repeated words cost one dictionary look-up.

Runs inside one narrow scan (no shuffle).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

#: Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> dict[int, str]:
    """Each byte's printable stand-in: itself where printable, else the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Code points without a category in Python's Unicode tables; a newer regex build may call them letters."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


class Words(dict):
    """word -> number; unseen words are numbered and queued."""

    def __init__(self):
        self.queue: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.queue.append(word)
        return n


class NumpyBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library.

    ``table_symbols`` bounds the per-task word table (symbols kept before it is emptied).
    """

    def __init__(self, path: str, table_symbols: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.path, self.limit = path, table_symbols
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        # the first round's pairs are all of bytes: looked up once and for all
        first = self.byte_id.repeat(256) * self.size + np.tile(self.byte_id, 256)
        self.first_at = np.minimum(np.searchsorted(self.keys, first), len(self.keys) - 1).astype(np.int32)
        self.first_rank = np.where(self.keys[self.first_at] == first, self.rank[self.first_at], NO_RANK).astype(np.int32)
        back = {c: b for b, c in symbols.items()}
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.pattern = regex.compile(PATTERN)
        # from here on two Unicode versions may class a code point differently
        self.rare = re.compile("[\u0530-\U0010ffff]")
        self._library = None
        self._empty_table()

    def _empty_table(self) -> None:
        self.words, self.flat = Words(), np.empty(0, np.int64)
        self.at, self.len = np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii() or not self.rare.search(text) or not unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_id[raw]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pair = raw.astype(np.int32) << 8
        pair[:-1] |= raw[1:]
        at = self.first_at[pair]
        rank = np.where(np.append(word[1:] == word[:-1], False), self.first_rank[pair], NO_RANK)

        def look_up(i: np.ndarray) -> None:
            """Ranks of the pairs that start at places i."""
            pair = i[:-1] if len(i) and i[-1] == len(sym) - 1 else i
            key = sym[pair] * self.size + sym[pair + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            at[pair] = found
            rank[i] = NO_RANK
            rank[pair] = np.where((word[pair] == word[pair + 1]) & (self.keys[found] == key), self.rank[found], NO_RANK)

        done_sym, done_word = [], []
        while len(sym):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(start, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, start), count)
            over = least == NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, at, rank, least = sym[keep], word[keep], at[keep], rank[keep], least[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            new_run = np.append(True, np.diff(hit) != 1)
            run_start = hit[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
            hit = hit[(hit - run_start) % 2 == 0]  # a a a: the left pair
            sym[hit] = self.made[at[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))  # each merge before it took one place
            sym, word, at, rank = sym[stay], word[stay], at[stay], rank[stay]
            # only pairs with a new symbol have another rank
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            changed[np.maximum(hit - 1, 0)] = True
            look_up(np.flatnonzero(changed))
        if not done_sym:
            return np.empty(0, np.int64), lengths
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _learn(self) -> None:
        queue = self.words.queue
        if queue:
            ids, count = self.merge([w.encode("utf-8") for w in queue])
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(count) - count])
            self.len = np.concatenate([self.len, count])
            self.flat = np.concatenate([self.flat, ids])
            self.words.queue = []

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets of len(texts) + 1); a null text counts as empty."""
        if len(self.flat) > self.limit:
            self._empty_table()
        numbers, counts, specials = [], np.zeros(len(texts), np.int64), []
        seen = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            for part in parts:
                if part in self.special:
                    specials.append((seen, self.special[part]))
                    found = [""]  # a place for the special id
                else:
                    found = self.split(part)
                numbers.append(np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)))
                counts[i] += len(found)
                seen += len(found)
        self._learn()
        number = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        length = self.len[number]
        at = self.at[number]
        flat = self.flat
        if specials:
            where, ids = map(np.array, zip(*specials, strict=True))
            length[where], at[where] = 1, len(flat) + np.arange(len(ids))
            flat = np.concatenate([flat, ids])
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(at - (ends - length), length) + np.arange(total)] if total else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]])
        return out, offsets

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids; an id outside the vocabulary is an error."""
        length = self.piece_len[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return b""
        return self.piece_bytes[np.repeat(self.piece_at[ids] - (ends - length), length) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; broken UTF-8 becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def load(path: str) -> NumpyBPE:
    """One encoder per worker process."""
    return NumpyBPE(path)


def ids_column(text: Column, path: str) -> Column:
    """array<int> of token ids (null text: empty array)."""

    @F.arrow_udf("array<int>")
    def ids(col: pa.Array) -> pa.Array:
        bpe, flats, sizes = load(path), [], []
        for _, _, texts in text_slices(col):
            flat, offsets = bpe.encode_batch(texts)
            flats.append(flat)
            sizes.append(np.diff(offsets))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32)
        values = np.concatenate(flats).astype(np.int32) if flats else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return ids(text)


def text_column(ids: Column, path: str) -> Column:
    """Text of a column of id arrays (null: null)."""

    @F.arrow_udf("string")
    def text(col: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([None if x is None else bpe.decode(np.array(x, np.int64)) for x in col.to_pylist()], pa.string())

    return text(ids)


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_column(text: Column, path: str, with_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, ids]) of each text after encoding and decoding."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def digest(col: pa.Array) -> pa.Array:
        bpe, rows, all_ids = load(path), [], [np.empty(0, np.int32)]
        for a, b, texts in text_slices(col):
            flat, offsets = bpe.encode_batch(texts)
            raw = flat.astype("<u4")
            if with_ids:
                all_ids.append(raw.view("<i4"))
            data = np.frombuffer(bpe.decode_bytes(flat), np.uint8)
            cut = np.concatenate([[0], np.cumsum(bpe.piece_len[flat])])[offsets]
            for i in range(b - a):
                ids = raw[offsets[i] : offsets[i + 1]]
                decoded = data[cut[i] : cut[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-8")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
        columns, fields = [pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], list(DIGEST)
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(np.array(n, np.int64))]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids))))
            fields.append(pa.field("ids", columns[-1].type))
        return pa.StructArray.from_arrays(columns, fields=fields)

    return digest(text)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Null or empty text: no tokens, the hashes of no bytes.  Special-token strings in a
    text become their ids.  Repeated rows give repeated results; other columns are ignored.
    """
    own = docs.select("doc_id", round_trip_column(F.col("text"), path or tokenizer_path()).alias("_d"))
    return own.select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")


def token_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As ``encode_documents``, with the ids themselves (array<int>) for every document."""
    own = docs.select("doc_id", round_trip_column(F.col("text"), path or tokenizer_path(), True).alias("_d"))
    return own.select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256", "_d.ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
