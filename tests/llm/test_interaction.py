"""Filter interaction audit: brute force over all orders, odd rows, the whole table against the oracle."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np

from slickwatch.llm import interaction

DOCS = "doc_id long, text string, lang string, source string, mask int, digest string, n long"
LABELS = "doc_id long, quality int, toxic int, part string"


def failed(rows, doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows):
        out.add("E")
    return out


def by_hand(rows, labels):
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    docs = [(r[3] or "", failed(rows, r[0], r[1] or ""), r[0]) for r in rows]
    out, shapley = {}, defaultdict(Counter)
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part][f] += len(now)
                out[part, "".join(order), step] = [
                    len(left), len(now), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part),
                    sum(d[2] in good for d in now), sum(d[2] in toxic for d in now),
                ]
                gone += now
    return {(p, o, s): (*v, shapley[p][o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}


def odd_rows():
    plain = " ".join(f"word{i}" for i in range(60))
    few = " ".join(["again", "and"] * 40)
    rows = [
        (1, plain, "en", "a"), (2, plain, "en", "b"), (3, plain, None, None), (3, plain, None, None), (None, plain, "en", "a"),
        (4, None, "en", ""), (5, "", "en", "a"), (6, few, "en", "a"), (7, few + " $", "en", "a"), (8, few.upper() + "#", None, "b"),
        (9, "É" * 95 + "ABCDE", "en", "b"), (10, "É" * 95 + "ABCDEF", "en", "b"), (11, plain + "\x0b\x1c  x", "en", "b"),
        (12, "\n \t", "en", "c"), (13, ("long tail " * 50000) + "|", "en", "c"), (1, few, "en", "c"), (14, few, "en", "c"),
        (15, " ".join(f"w{i}" for i in range(13)) + " w0" * 7 + " " + plain, "en", "d"),
    ]
    return [(*r, 3, "x", -1) for r in rows]


def test_brute_force_and_odd_rows(spark):
    labels = [(1, 1, 0, "z"), (2, 1, 1, "z"), (3, 0, 1, "z"), (3, 1, None, "z"), (6, None, 1, None), (None, 1, 1, "z"), (99, 1, 1, "z"), (13, 1, 0, None)]
    rows = odd_rows()
    found = got(interaction.audit(interaction.masks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))))
    want = by_hand(rows, labels)
    assert len(want) == 600 * 5 and found == want


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    out = interaction.audit(interaction.masks(docs, labels))
    assert out.count() == 0 and out.columns == [c.split()[0] for c in interaction.SCHEMA.split(", ")]
    rows = spark.createDataFrame(odd_rows()[:3], DOCS)
    assert sum(r.good_lost + r.toxic_lost for r in interaction.audit(interaction.masks(rows, labels)).collect()) == 0


def test_other_filters_and_counts_beyond_an_int(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", m, int(n), 0, int(n)) for i in range(150) for m, n in enumerate(rng.integers(0, 1 << 40, 8))]
    out = interaction.audit(spark.createDataFrame(rows + rows[:8], "part string, mask int, n long, good long, toxic long"), "XYZ").collect()
    assert len(out) == 150 * 6 * 3
    held = defaultdict(int)
    for p, m, n, *_ in rows + rows[:8]:
        held[p, m] += n
    for r in out:
        f, before = "XYZ".index(r.filter_order[r.step - 1]), ["XYZ".index(c) for c in r.filter_order[: r.step - 1]]
        fails = lambda m, g: m >> g & 1
        gone = sum(held[r.part, m] for m in range(8) if fails(m, f) and not any(fails(m, g) for g in before))
        assert r.removed == r.toxic_lost == gone
        assert r.redundant == sum(held[r.part, m] for m in range(8) if fails(m, f) and any(fails(m, g) for g in before))
        assert r.unique_fails == held[r.part, 1 << f]


def test_query_against_oracle(spark):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(interaction.ORACLE_OP11)
    names = [c[0] for c in want.description]
    df = interaction.op11_filter_interaction(spark, folder)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
