"""Packing: ids of the library, exact covers, gapless sequences, target proportions."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slickwatch.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(library, docs, rows, window=1024):
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(library.encode(text or "", add_special_tokens=False).ids + [0])
    total = sum(len(x) for y in want.values() for x in y)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for doc_id, texts in want.items():
        if len(texts) > 1:
            continue
        ids, at = np.array(texts[0], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = {}
    for seq, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes[seq] = at
    assert sum(sizes.values()) == total
    assert sorted(sizes) == list(range(-(-total // window)))
    assert all(sizes[s] == window for s in sorted(sizes)[:-1])


def test_pieces_of_odd_texts(library):
    bpe = packing.ByteBpe(PATH)
    for text in ["", " ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "a\n", "\n \n", "a <|endoftext|> b", "it's 'tis", "é ü 日本 😀", "x" * 500 + " y", "a  b  c", "12 3a_b", "a\t b \t c"]:
        assert np.frombuffer(bpe.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_keeps_proportions_and_carries_deficits():
    totals = [100_000, 31_234, 7_777, 3, 0]
    plan = packing.Plan(totals, window=100, cycle=16)
    windows = np.arange(plan.windows)
    before = np.array([plan.borders(q, windows)[0] for q in range(5)])
    assert (before.sum(0) == 100 * windows).all()
    assert (np.diff(before, axis=1) >= 0).all()
    goal = np.outer(np.array(totals) / sum(totals), 100 * windows)
    rounding = 3 + 0.5 * windows[:-40] / 16  # half a token for each cycle of 16 windows
    assert (np.abs(before - goal)[:, :-40] <= rounding).all()
    for q in range(4):
        for token in (0, totals[q] // 2, totals[q] - 1):
            w = plan.window_of(q, token)
            assert before[q, w] <= token and (w + 1 == plan.windows or token < before[q, w + 1])


def test_plan_with_given_shares():
    plan = packing.Plan([5000, 5000, 90], [3, 1, 0], window=100, cycle=8)
    takes = np.diff(np.array([plan.borders(q, np.arange(40))[0] for q in range(3)]), axis=1)
    assert (takes[0] == 75).all() and (takes[1] == 25).all() and (takes[2] == 0).all()
    assert plan.windows == 101


def test_odd_rows(spark, library):
    rows = [(1, "one two", "a", 5), (2, None, None, 5), (3, "", "b", 5), (4, "word " * 3000, "a", 5), (5, "x", "c", 5), (6, "same", "b", 5), (6, "same", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got = packing.pieces(docs, PATH, window=64, queues=2).collect()
    check(library, [r[:2] for r in rows], got, 64)


@pytest.mark.parametrize("given", [False, True])
def test_many_sources_keep_their_targets(spark, library, given):
    """200 sources, eight queues: each of the shared queue's sources stays within its target in every stretch of windows."""
    rows, k = [], 0
    for s in range(200):
        for _ in range(40 if s < 7 else 4 + s % 5):
            rows.append((k, " ".join(f"w{(k * 31 + j) % 997}" for j in range(5 + k % 40)), f"s{s:03d}"))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    shares = {f"s{s:03d}": 1.0 + s % 3 for s in range(200)} if given else None
    got = packing.pieces(docs, PATH, shares=shares, window=512, queues=8).collect()
    check(library, [r[:2] for r in rows], got, 512)
    source = {r[0]: r[2] for r in rows}
    total, taken = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in got:
        total[source[r.doc_id]] += r.length
        taken[source[r.doc_id]][r.sequence_id] += r.length
    large = sorted(total, key=lambda s: (-total[s], s))[:7]
    last = max(w for t in taken.values() for w in t)
    tail = [s for s in total if s not in large]
    whole = np.array([sum(taken[s][w] for s in tail) for w in range(last + 1)])
    share = {s: (shares or total)[s] for s in tail}
    until = min(max(w for w, n in taken[s].items() if n) for s in tail) if given else last - 2  # by then none of them has run out
    assert until > 10
    for s in tail:
        own = np.cumsum([taken[s][w] for w in range(until)])
        want = np.cumsum(whole[:until]) * share[s] / sum(share.values())
        room = 3 + max(share[s] / sum(share.values()) * 512, 1)
        assert np.abs(own - want).max() <= room, (s, np.abs(own - want).max(), room)


def test_shared_queue_without_shares(spark, library):
    """Sources of the shared queue without a target come after those with one; ties and one token each."""
    rows = [(k, "", f"t{k:02d}") for k in range(60)] + [(100 + k, "word " * 300, "big") for k in range(3)] + [(200, "x y z " * 40, "with")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pieces(docs, PATH, shares={"big": 1.0, "with": 1.0}, window=64, queues=2).collect()
    check(library, [r[:2] for r in rows], got, 64)
    first = min((r.sequence_id, r.offset) for r in got if r.doc_id < 60)
    assert first > max((r.sequence_id, r.offset) for r in got if r.doc_id == 200)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pieces(docs, PATH).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(library, docs, packing.op5_packing(spark, folder).collect())
