"""BPE against the tokenizers library: exact ids, exact decoded text, exact digests."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slickwatch.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "Hello  World's café", "Ich <|endoftext|> x<|endoftext|>", "a\x1cb", "ΑΣ ΟΔΥΣΣΕΥΣ", "İx", "ﬀ é é", "123 4", "　x",
    "x\x85y\x0by", "ǅ don't 'S", "aaaaaaaaaaaaa hahahahaha" * 300, "日本語 😀😀 न", "don't've\x1f\x1e 's", "​ ﻿ x᠎ y", "</w> a</w>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_ids_and_decoded_text(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, tokens_ string")
    for r in bpe.encoded(docs, PATH).collect():
        assert (r.tokens.ids, r.tokens.decoded) == want(library, r.text)


def test_both_ways_of_merging_and_random_words(library):
    rng, table = random.Random(1), bpe.Bpe(PATH)
    words = ["".join(rng.choices("aehinorst'é", k=rng.randrange(1, 40))) for _ in range(3000)]
    for word, parts in zip(words, table.encode(words)):
        assert [int(i) for p in parts for i in p[1].split()] == want(library, word)[0]
    assert 0 < table.merged < table.checked


def test_query_matches_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = bpe.op3_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = want(library, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
