"""Token counts against a plain Viterbi and the unigram model of the tokenizers library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from slickwatch.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocab = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def want(library, text):
    if not text:
        return 0
    return len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids)


ODD = [None, "", " ", "   ", " a  b ", "hello world", "x\ny\t z", "日本語 😀 न", "▁ a▁b", "word " * 4000, "é" * 300, "aaaa" * 600, "\U0001f9ff\U0001f9ff ok", "don't stop"]


def test_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens_ int")
    got = token_counts.counted(docs, PATH).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [want(library, t) for t in ODD]


def plain(pieces, unknown, text):
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(len(text)):
        lone = True
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in pieces:
                lone = lone and j > i + 1
                total = best[i][0] + pieces[text[i:j]]
                if best[j] is None or total > best[j][0]:
                    best[j] = (total, best[i][1] + 1)
        if lone and (best[i + 1] is None or best[i][0] + unknown > best[i + 1][0]):
            best[i + 1] = (best[i][0] + unknown, best[i][1] + len(text[i].encode()))
    return best[-1][1]


def test_ties_against_plain_viterbi():
    rng = random.Random(4)
    for _ in range(20):
        pieces = {"".join(rng.choices("ab", k=rng.randrange(1, 4))): -float(rng.randrange(1, 4)) for _ in range(7)}
        model = token_counts.Unigram(list(pieces.items()), min(pieces.values()))
        parts = ["".join(rng.choices("abé", k=rng.randrange(1, 12))) for _ in range(60)]
        assert model.count_each(parts) == [plain(pieces, model.unknown, p) for p in parts]


def test_query_matches_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = token_counts.op10_token_counts(spark, folder).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == want(library, texts[r.doc_id]) for r in got)


def test_empty_table(spark):
    assert token_counts.counted(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
