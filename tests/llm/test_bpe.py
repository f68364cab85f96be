import random

import pytest
from tokenizers import Tokenizer

from stratalog.llm import bpe
from stratalog.session import ship

PATH = f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}"
ODD = ["", " ", "\n", "a", "aaaaaaa aaaa", "a" * 30_001, "ab" * 20_000, "日本" * 3000, "<|endoftext|> it's we'll 'S 'sS x'd", "x\x1c y z  \n\n foo ", "x\x1f  y", "\x85 a\xa0b \xa0 c", "½²٣ⅷ 12٣", "👩‍💻🇳🇿 ♻️", "á́ กี่ हिन्दी", "\r\n\r\n\tif (x) {\r\n", "  lead", "trail  ", "　全角 em", "﻿bom​zero", "'''s''ll", "\0\x01\x7f"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def encoded(encoder, texts):
    ids, offsets = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_odd_and_random_texts_equal_the_public_library(reference):
    rng = random.Random(1)
    alphabet = "aaabcdeE  \n\t.,'\"-_(){}0129éß漢字かなไทยदेन\x1c\xa0👍"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(800)]
    encoder = bpe.CorpusEncoder(PATH)
    want = reference(texts)
    assert encoded(encoder, texts) == want
    assert encoded(encoder, texts[::-1]) == want[::-1]  # now from what it knows
    lengths = encoder.encode(texts, lengths_only=True)[1]
    assert lengths.tolist() == [len(x) for x in want]


def test_bounded_memory_keeps_the_result(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 10)
    encoder = bpe.CorpusEncoder(PATH)
    for text in ("one two three", "four five six seven eight nine ten eleven", "one two"):
        assert encoded(encoder, [text]) == reference([text])


def test_frames(spark, reference, monkeypatch):
    ship(spark)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (None, "no id"), (1, ODD[1]), (1, ODD[1])]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, id int, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df).collect()), key=repr)
    assert got == sorted(((i, reference([t or ""])[0]) for i, t in rows), key=repr)
    counts = sorted(tuple(r) for r in bpe.token_counts(df.where("doc_id IS NOT NULL")).collect())
    assert counts == sorted((i, len(reference([t or ""])[0])) for i, t in rows if i is not None)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
