"""Order-dependent building blocks that survive one key holding most rows.

A plain ``Window.partitionBy(key)`` sorts everything of one key in one task. What
needs the order itself (:func:`carry_forward`) is cut by range of key and order, so
that a hot key lies over several tasks, and one row a task goes on to the next.
Ranks and percentiles cut a key into bins of the value, whose counts alone are
brought together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slickwatch.session import cut_lineage

# Executors need not have this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """True at each row whose key differs from the row above; ``before`` is the key above the first."""
    new = np.zeros(len(columns[0]), bool)
    for col in columns:
        a, b = col[:-1], col[1:]
        differs = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    new[0] = before is None or before != tuple(c[0].as_py() for c in columns)
    return new


class _Carry:
    """What goes from a run of sorted rows to the next: the last key and its last payload; ``whole`` while that key has not changed."""

    def __init__(self, key: tuple | None = None, payload: pa.Array | None = None):
        self.key, self.payload, self.whole = key, payload, True

    def passed(self, keys: list[pa.Array], payload: pa.Array, inclusive: bool) -> pa.Array:
        """Last non-null payload before (or at) each row within its key."""
        n = len(payload)
        start = _starts(keys, self.key)
        if start.any():
            self.whole = False
        there = payload.is_valid().to_numpy(zero_copy_only=False)
        rows = np.arange(n)
        last = np.maximum.accumulate(np.where(there, rows, -1))
        begin = np.maximum.accumulate(np.where(start, rows, -1))  # -1: the key that was carried in
        seen = last if inclusive else np.append(-1, last[:-1])
        if not inclusive:
            seen = np.where(start, -1, seen)
        inside = seen >= np.maximum(begin, 0)
        carried = self.payload if self.payload is not None else pa.nulls(1, payload.type)
        at = np.where(inside, seen, np.where(begin < 0, n, -1))
        out = pa.concat_arrays([payload, carried]).take(pa.array(at, mask=at < 0))
        if last[-1] >= max(begin[-1], 0):
            self.payload = payload.slice(last[-1], 1)
        elif begin[-1] >= 0:
            self.payload = None
        self.key = tuple(c[-1].as_py() for c in keys)
        return out


def _columns(batch: pa.RecordBatch, keys: list[str]) -> tuple[list[pa.Array], pa.Array]:
    names = batch.schema.names
    return [batch.column(names.index(k)) for k in keys], batch.column(names.index("_p"))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], payload: Column, out: str = "prev", inclusive: bool = False) -> DataFrame:
    """Last non-null ``payload`` before (or at) each row, per key in order.

    One exchange cuts the rows by range of key and order, so a key that holds
    most rows is many tasks; each task sorts its own and goes through them once.
    From a task to the next goes one row: its last key and payload. Those rows, one a
    task, are all the driver sees.
    """
    tagged = df.withColumn("_p", payload)
    ordered = cut_lineage(tagged.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    kind = ordered.schema["_p"].dataType

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if batch.num_rows:
                columns, values = _columns(batch, keys)
                carry = carry or _Carry(tuple(c[0].as_py() for c in columns))
                carry.passed(columns, values, inclusive)
        if carry is not None:
            last = carry.payload if carry.payload is not None else pa.nulls(1, values.type)
            one = pa.RecordBatch.from_arrays([*[pa.array([k], c.type) for k, c in zip(carry.key, columns)], last], [*map(str, range(len(keys) + 1))])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema) as out_:
                out_.write_batch(one)
            packed = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([carry.whole]), pa.array([sink.getvalue().to_pybytes()])]
            yield pa.RecordBatch.from_arrays(packed, ["at", "whole", "tail"])

    held: list[tuple[int, tuple, pa.Array]] = []
    for r in sorted(ordered.mapInArrow(ends, "at int, whole boolean, tail binary").collect()):
        row = pa.ipc.open_stream(bytes(r["tail"])).read_next_batch()
        key, last = tuple(c[0].as_py() for c in row.columns[:-1]), row.columns[-1]
        if last.null_count and r.whole and held and held[-1][1] == key:
            last = held[-1][2]  # the whole task was of the key before, without a payload of its own
        held.append((r["at"], key, last))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        before = [h for h in held if h[0] < own][-1:]
        carry = _Carry(before[0][1], before[0][2]) if before else _Carry()
        for batch in batches:
            if batch.num_rows:
                columns, values = _columns(batch, keys)
                found = carry.passed(columns, values, inclusive)
                at = batch.schema.names.index("_p")
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *batch.columns[at + 1 :], found], [*batch.schema.names[:at], *batch.schema.names[at + 1 :], out])

    result = StructType([f for f in ordered.schema.fields if f.name != "_p"]).add(out, kind)
    return ordered.mapInArrow(passed, result)


def grouped_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bin_width: float
) -> DataFrame:
    """Exact linear-interpolated percentiles without holding a group in one task.

    Equal values are counted first, so copies collapse map-side. Counts per
    ``bin_width``-wide bin locate the bins holding the wanted ranks, and only
    the values of those bins are ordered. ``bin_width`` is a resolution of the
    measured quantity (0.05 dB, one minute): it bounds the bins per key and
    does not affect the result.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col("_v") / F.lit(float(bin_width))))
    )
    up_to = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(up_to))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_bn"))
    )

    def position(p):
        return F.lit(float(p)) * (F.col("_total") - 1)

    wanted = F.lit(False)
    for p in probs.values():
        for rank in (F.floor(position(p)), F.ceil(position(p))):
            wanted = wanted | ((rank >= F.col("_start")) & (rank < F.col("_end")))
    hit = bins.filter(wanted).select(*keys, "_bin", "_start", "_total")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.join(hit, [*keys, "_bin"])
        .withColumn("_hi", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )
    parts, final = [], []
    for name, p in probs.items():
        for tag, rank in (("l", F.floor(position(p))), ("h", F.ceil(position(p)))):
            parts.append(
                F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v"))).alias(
                    f"_{tag}_{name}"
                )
            )
        frac = position(p) - F.floor(position(p))
        low, high = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        final.append((low + (high - low) * frac).alias(name))
    return ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *parts).select(*keys, *final)


def sorted_percentile(values: Column, p: float) -> Column:
    """Linear-interpolated percentile of a sorted array, as in :func:`grouped_percentiles`; null for an empty one."""
    at = F.lit(float(p)) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def distributed_rank(
    df: DataFrame,
    keys: list[str],
    bucket: list[Column],
    bucket_order: list[str],
    order: list[Column],
    out: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Exact 1-based row number per key without sorting a key in one task.

    ``bucket`` columns (named by ``_b0``, ``_b1`` ...) must follow the wanted
    order; ``bucket_order`` gives 'asc' or 'desc' for each. Rows are numbered
    inside a bucket and shifted by the rows of all buckets before it. ``total``
    names a column for the rows per key.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(bucket, names)])
    sort = [F.col(n).desc() if o == "desc" else F.col(n).asc() for n, o in zip(names, bucket_order)]
    before = (
        Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tagged.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn(total or "_total", F.sum("_rows").over(Window.partitionBy(*keys)))
        .drop("_rows", "_total")
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        tagged.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*keys, *names])
        .withColumn(out, (F.col("_in") + F.col("_before")).cast("bigint"))
        .drop("_in", "_before", *names)
    )

