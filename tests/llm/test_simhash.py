"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from slickwatch.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """{doc_id: smallest doc_id reachable}, for (doc_id, fingerprint) pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in prints:
        for j, g in prints:
            if bin(f ^ g).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in prints}


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    prints = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        seed = rng.getrandbits(64)
        prints.add(seed)
        block = 16 * rng.randrange(4)
        for _ in range(6):
            spread = rng.choice([range(64), range(block, block + 16)])
            prints.add(seed ^ sum(1 << b for b in rng.sample(spread, rng.randrange(1, 5))))
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)
    root = {p: p for p in prints}
    for a, b in found:
        old, new = root[a], root[b]
        root = {p: new if r == old else r for p, r in root.items()}
    want = brute_groups([(p, p) for p in prints])
    assert len({(root[p], want[p]) for p in prints}) == len(set(root.values())) == len(set(want.values()))


def cluster(size, rng, spread=range(64)):
    """Fingerprints, each at most 3 flips from an earlier one."""
    out = [rng.getrandbits(64)]
    while len(out) < size:
        bits = rng.sample(spread, rng.randrange(1, 4))
        fp = rng.choice(out[-20:]) ^ sum(1 << b for b in bits)
        if fp not in out:
            out.append(fp)
    return out


@pytest.mark.parametrize("size", [50, 200, 800])
def test_links_stay_few_in_clusters(spark, size):
    rng = random.Random(size)
    prints = cluster(size, rng) + cluster(size // 2, rng, range(16)) + cluster(min(size, 100), rng, range(40, 48))
    df = spark.createDataFrame([(simhash._signed(p),) for p in sorted(set(prints))], "fp long").repartition(3)
    variants = simhash._met(simhash.variants(df), "block", "near").count()
    links = simhash.links(df)
    found = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert len(found) <= 14 * df.count() and len(found) < variants  # a link a row and bucket at most, most of them the same
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    got = {p: roots.get(simhash._signed(p), simhash._signed(p)) for p in set(prints)}
    want = brute_groups([(p, p) for p in sorted(set(prints))])
    assert len(set(got.values())) == len(set(want.values())) == len({(got[p], want[p]) for p in got})


def test_flooded_against_pairs():
    rng = np.random.default_rng(1)
    for bits, size in ((1, 3000), (3, 40), (3, 400), (1, 65536)):
        values = np.sort(rng.choice(1 << 16, size, replace=False))
        source = simhash.flooded(values, simhash._flips(bits))
        reached = np.flatnonzero(source >= 0)
        assert (np.bitwise_count(values[reached] ^ values[source[reached]]) <= bits).all()
        root = np.arange(size)
        while (source[root] >= 0).any():
            root = np.where(source[root] >= 0, source[root], root)
        if size == 65536:
            assert (source >= 0).sum() == size - 1
        else:
            near = np.bitwise_count(values[:, None] ^ values) <= bits
            top = np.arange(size)
            while (top != (new := np.where(near, top, size).min(1))).any():
                top = new
            assert len(set(zip(root.tolist(), top.tolist()))) == len(set(top.tolist())) == (source < 0).sum()


def test_open_buckets_over_batches():
    rng = random.Random(2)
    prints = sorted(set(cluster(300, rng, range(16))))
    rows = [(0, p >> 16 << 16, True, p) for p in prints]
    columns = lambda r: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(b, simhash._signed(n), o, simhash._signed(f)) for b, n, o, f in r])], ["block", "near", "own", "fp"])
    whole = pa.Table.from_batches(simhash._bucket_links(iter([columns(rows)]))).to_pylist()
    cut = pa.Table.from_batches(simhash._bucket_links(iter([columns(rows[i : i + 7]) for i in range(0, len(rows), 7)]))).to_pylist()
    assert whole == cut and len(whole) <= 2 * len(rows)


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        parts = t.split()
        parts[60] = "changed"
        rows += [(100 + i, " ".join(parts), "y"), (200 + i, t.upper(), None), (200 + i, t.upper(), None)]
    return rows + [(300, None, "n"), (301, "", "n"), (302, " \t\n", "n"), (303, "One", "n"), (304, "one  TWO", "n"), (305, "É é  x y", "n"), (306, "long " * 30000, "n"), (None, base[0], "n")]


def test_groups(spark):
    rows = texts()
    got = simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = brute_groups([(i, brute_print(t)) for i, t, _ in rows if i is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % 2**64, r.component_id) == (brute_print(dict((i, t) for i, t, _ in rows)[r.doc_id]), want[r.doc_id])
    left = simhash.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert left.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_empty(spark):
    assert simhash.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_groups(prints)
    got = simhash.op2_simhash(spark, folder).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", want[i]) for i, p in prints)
