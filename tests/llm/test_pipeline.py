"""The pipeline, stage by stage and as a whole, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from helpers import corpus, frame, near_components, repeated_passages

import corpus_pipeline
from graphloom.llm import bpe, langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_columns(spark):
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_array_dedup", "source_mixing", "bpe_tokens"]
    docs = frame(spark, corpus(7, 40), extra=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, docs, ""), name)
        if name != "bpe_tokens":
            assert docs.columns == COLUMNS
    assert docs.count() > 0
    nothing = frame(spark, [], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


def test_run_matches_brute_force(spark, tmp_path):
    rows = [(d if d is not None else 3000, t, lang, s, n) for d, t, lang, s, n in corpus(3, 50)]
    seen: set = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    folder = tmp_path / "sf"
    frame(spark, rows, extra=False).write.parquet(str(folder / "documents.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(folder)).collect()}

    # 1: the model is an input of the stage; its decisions are taken again, one text at a time
    scorer = langid.Scorer(langid.fit_documents(spark.read.parquet(str(folder / "documents.parquet"))))
    kept = []
    for r in rows:
        (lang,), score = scorer.predict([r[1]])
        if lang != "und" and score[0] >= 0.3:
            kept.append(r)
    # 2
    part, _ = near_components([r[1] for r in kept])
    first: dict = {}
    for c, r in zip(part, kept, strict=True):
        first[c] = min(first.get(c, r), r, key=lambda x: x[0])
    kept = sorted(first.values())
    # 3
    texts = [r[1].encode() for r in kept]
    cut = {r[0]: bytes(b for b, h in zip(t, hit, strict=True) if not h) for r, t, hit in zip(kept, texts, repeated_passages(texts, 150, 50), strict=True)}
    # 4 keeps every row; 5
    model = bpe.load(bpe.tokenizer_path())
    assert set(got) == set(cut)
    for d, raw in cut.items():
        ids = model.encode_batch([raw.decode("utf-8")])[0]
        assert got[d].ids == ids.tolist() and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() and got[d].decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_mixing_takes_effect(spark):
    rows = [(i, "w " * 30, "en", "big" if i % 10 else "small", 60) for i in range(2000)]
    out = corpus_pipeline.source_mixing(spark, frame(spark, rows, extra=False), "").collect()
    assert Counter(r.doc_id for r in out) == Counter(range(2000))
    head = [r.source for r in out[:400]]
    assert abs(head.count("small") / 400 - 200**0.5 / (200**0.5 + 1800**0.5)) < 0.06
    assert np.mean([r.source == "small" for r in out[-100:]]) == 0


def test_passages_of_over_fifty_words_go_and_shorter_ones_stay(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    prose = lambda k, n=6: " ".join(word(rng.randrange(2, n)) for _ in range(k))
    long, short, own = prose(51, 5), prose(45, 6), prose(70)
    assert 150 <= len(long) < 250 and 150 <= len(short) < 400
    rows = [(i, f"{prose(60)} {long} {prose(40)}", "en", "a", 0) for i in range(4)]
    rows += [(10 + i, f"{prose(60)} {short} {prose(40)}", "en", "a", 0) for i in range(4)]
    rows += [(20 + i, prose(100), "en", "b", 0) for i in range(10)] + [(30, f"{own} {prose(5)} {own}", "en", "b", 0)]
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_array(spark, frame(spark, rows, extra=False), "").collect()}
    for d, text, *_ in rows:
        if d < 10:
            assert long not in out[d] and len(out[d]) <= len(text) - len(long)
        elif d == 30:
            assert own not in out[d]
        else:
            assert out[d] == text
