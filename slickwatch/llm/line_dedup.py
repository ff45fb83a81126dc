"""Line dedup: lines that several documents share stay in the first of them only.

1. *Explode*: inside Spark tasks every text is cut at line feeds; each line's key
   (stripped of ASCII space, A-Z lower-cased) leaves as a 128-bit hash with the
   line's position. Keys that are too short leave nothing.
2. *Count*: rows of one document and hash are merged, then the documents of each
   hash are counted. Both sums combine before the shuffle, so a line that stands
   in every document is one row a task.
3. *Drop*: a line goes if its hash is shared and its document is not the first.
   Hashes with more than ``1 / SHARE`` of all lines (at most ``SHARE`` of them at
   any size) are broadcast; the others are joined by shuffle.
4. *Reassemble*: a document gets the positions of its dropped lines and keeps the
   others in place. Only here does the text travel, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import annotated, fresh, table
from slickwatch.session import staged

MIN_CHARS, MIN_DOCS = 10, 2
#: A hash is hot beyond this share of all lines, so there are at most 4,096 hot ones.
SHARE = 4096
#: Lines that leave a task at once.
ROWS_AT_ONCE = 1 << 16

LINES = "doc_id long, t1 long, t2 long, h1 long, h2 long, pos int"


def keyed(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[int], list[bytes]]:
    """Positions and hashes of the lines of one text whose key has ``min_chars`` code points or more."""
    places, hashes = [], []
    for pos, line in enumerate(text.split(b"\n")):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()  # of bytes: only A-Z change
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            places.append(pos)
            hashes.append(xxhash.xxh3_128_digest(key))
    return places, hashes


def _exploded(min_chars: int):
    def out(rows: list) -> pa.RecordBatch:
        ids, t1, t2, sizes, places, hashes = zip(*rows)
        pairs = np.frombuffer(b"".join(b"".join(h) for h in hashes), "<i8").reshape(-1, 2)
        spread = np.repeat(np.arange(len(ids)), sizes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()).take(pa.array(spread)),
                pa.array(np.array(t1, np.int64)[spread]),
                pa.array(np.array(t2, np.int64)[spread]),
                pa.array(np.ascontiguousarray(pairs[:, 0])),
                pa.array(np.ascontiguousarray(pairs[:, 1])),
                pa.array(np.concatenate([np.array(p, np.int32) for p in places])),
            ],
            ["doc_id", "t1", "t2", "h1", "h2", "pos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, t1, t2, text in zip(*(batch.column(i) for i in range(4))):
                places, hashes = keyed((text.as_py() or "").encode(), min_chars)
                for i in range(0, len(places), ROWS_AT_ONCE):
                    part = places[i : i + ROWS_AT_ONCE]
                    held.append((doc_id.as_py(), t1.as_py(), t2.as_py(), len(part), part, hashes[i : i + ROWS_AT_ONCE]))
                    size += len(part)
                    if size >= ROWS_AT_ONCE:
                        yield out(held)
                        held, size = [], 0
            if held:
                yield out(held)

    return run


def _marks(text) -> tuple:
    """128 bits that, with the id, name a row by its text."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, share: int = SHARE) -> DataFrame:
    """doc_id, t1, t2, drops: the positions of the lines that go, for rows that lose any.

    ``docs`` has doc_id and text. Rows of one doc_id are one document; rows
    without doc_id together are one, which comes after all others.
    """
    text = F.coalesce("text", F.lit(""))
    lines = staged(docs.select("doc_id", *_marks(text), text.alias("text")).mapInArrow(_exploded(min_chars), LINES), "lines")
    once = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    keys = once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.sum("n").alias("n"))
    shared = staged(keys.filter(F.col("docs") >= min_docs).drop("docs"), "shared")
    total = lines.count()
    hot = shared.filter(F.col("n") * share > total).drop("n")
    cold = shared.filter(F.col("n") * share <= total).drop("n")
    goes = ~F.col("doc_id").eqNullSafe(F.col("first"))
    by_hot = lines.join(F.broadcast(hot), ["h1", "h2"]).filter(goes)
    rest = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    gone = by_hot.unionByName(rest.join(cold, ["h1", "h2"]).filter(goes))
    return gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("drops"))


def _reassembled(texts: pa.Array, drops: pa.Array) -> pa.Array:
    kept, sizes, gone = [], [], []
    for text, out in zip(texts, drops):
        lines, out = (text.as_py() or "").split("\n"), set(out.as_py() or ())
        sizes.append(len(lines))
        gone.append(len(out))
        kept.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text.as_py() or "")
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["kept", "n_lines", "n_dropped"]
    )


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, share: int = SHARE) -> DataFrame:
    """``docs`` with a column ``lines`` (kept string, n_lines, n_dropped long); a taken name gets underscores.

    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose their lines in all documents but that of the smallest doc_id.
    Null and empty texts are one empty line. Rows that repeat a doc_id are one
    document, so they never lose a line to each other, and each stays; rows
    without doc_id are one document after all others. A text whose lines all go
    becomes empty. An empty table gives an empty result; other columns stay.
    """
    name = "lines"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    text = F.coalesce("text", F.lit(""))
    t1, t2, drops, i, a, b = (fresh(docs, x) for x in ("t1", "t2", "drops", "id", "a", "b"))
    goes = dropped(docs.select("doc_id", "text"), min_chars, min_docs, share).toDF(i, a, b, drops)
    first, second = _marks(text)
    rows = docs.withColumn(t1, first).withColumn(t2, second)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(t1) == F.col(a)) & (F.col(t2) == F.col(b))
    joined = rows.join(goes, same, "left").select(*docs.columns, drops)
    return annotated(joined, name, _reassembled, "kept string, n_lines long, n_dropped long", "text", drops).select(*docs.columns, name)


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Line counts and the digest of what stays, for every document."""
    out = deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


ORACLE_OP12 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
),
lines AS (
    SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM texts
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
),
shared AS (
    SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
),
told AS (
    SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> first AS goes FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM told
GROUP BY r, doc_id
"""
