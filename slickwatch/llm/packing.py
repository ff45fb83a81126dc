"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens. All sources beyond the ``QUEUES - 1`` largest share
one queue, inside which they take turns of their own: round after round each gives
what it owes by its target, so that every stretch of the queue has the mixture of
its sources. Turns are a table keyed by source and round, not a plan in one task, so
there may be any number of sources. Every window of ``WINDOW`` tokens takes from
each queue its target proportion. What a queue is owed and did not get whole is
its deficit, carried to the next window.

Deficits are carried by a plan instead of by one running task. Targets are
rounded to whole tokens of a cycle of ``CYCLE`` windows, in which all deficits are paid
back, so that one table of a cycle tells for any window how many tokens of each
queue came before it. Each task cuts its documents at those borders alone. When
a queue runs empty, the rest share its part, in a new phase of the plan; there
are at most as many phases as queues. Every window but the last is full.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwatch.llm.bpe import byte_letters
from slickwatch.llm.common import table
from slickwatch.session import staged

WINDOW, CYCLE, QUEUES = 1024, 64, 64
REMEMBERED, LONG = 600_000, 60
# Fixed value: the vocabulary's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Token ids of a byte-level vocabulary file, remembered for the pieces between single spaces.

    Pieces are encoded by rank, which is the library's result where ids follow
    the order of merges; that is looked up once, and other files go to the library whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        value = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(value[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        made = [vocab["".join(m)] for m in merges]
        self.by_rank = made == sorted(made) and len(made) + 256 == len(ranks) and min(made) == 256
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        ids = array("I", self.words.encode_ordinary(piece)).tobytes()
        if len(piece) <= LONG:
            self.memory[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit.

        No token of the vocabulary's pattern runs on over a single space, except
        that the space opens the next one. Texts with two spaces in a row, or
        with a special token, go to the library whole.
        """
        if not text:
            return b""
        if not self.by_rank or "  " in text or any(s in text for s in self.special):
            return self.raw(text)
        first, *rest = text.split(" ")
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        known, piece = self.memory.get, self.piece
        head = array("I", self.words.encode_ordinary(first)).tobytes()
        return head + b"".join([known(p) or piece(p) for p in [" " + p for p in rest]])


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


TOKENS = "doc_id long, source string, part int, at long, n long, ids binary"


def tokenised(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Ids of each document with ``end`` after it, and its place in its source's run of this task.

    ids: unsigned, 16-bit where the vocabulary allows, else 32-bit.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe, part, at = loaded(path), TaskContext.get().partitionId(), {}
        small = bpe.library.get_vocab_size() <= 1 << 16
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            out = {k: [] for k in ("doc_id", "source", "part", "at", "n", "ids")}
            for k in range(batch.num_rows):
                source = batch.column(2)[k].as_py()
                ids = bpe.ids(batch.column(1)[k].as_py()) + tail
                n = len(ids) // 4
                row = (batch.column(0)[k].as_py(), source, part, at.get(source, 0), n)
                at[source] = at.get(source, 0) + n
                ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if small else ids
                for key, x in zip(out, (*row, ids)):
                    out[key].append(x)
                if len(out["n"]) == 512:
                    yield _batch(out)
                    out = {k: [] for k in out}
            if out["n"]:
                yield _batch(out)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(run, TOKENS)


def _batch(out: dict) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds)], list(out))


def apportioned(shares: np.ndarray, total: int) -> np.ndarray:
    """``total`` whole tokens in proportion to ``shares``, by largest remainder."""
    exact = shares * (total / shares.sum())
    whole = np.floor(exact).astype(np.int64)
    order = np.argsort(-(exact - whole), kind="stable")
    whole[order[: total - whole.sum()]] += 1
    return whole


def round_robin(quanta: np.ndarray, left: np.ndarray, windows: int, window: int, per: int) -> np.ndarray:
    """Tokens that each window takes from each queue; stops early once all are empty.

    Each window owes queue s ``quanta[s] / per`` tokens. It takes the whole tokens
    owed, first queue first; room left goes to those owed most.
    """
    left, owed, out = left.copy(), np.zeros(len(quanta), np.int64), []
    while len(out) < windows and left.sum():
        owed = owed + quanta
        took, room = np.zeros(len(quanta), np.int64), window
        for s in range(len(quanta)):
            took[s] = min(max(owed[s] // per, 0), left[s], room)
            room -= took[s]
        while room and (left > took).any():
            for s in np.argsort(-(owed - took * per), kind="stable"):
                more = min(room, int(left[s] - took[s]), 1 if quanta[s] else room)
                took[s] += more
                room -= more
        owed, left = owed - took * per, left - took
        out.append(took)
    return np.array(out, np.int64).reshape(-1, len(quanta))


class Plan:
    """For every window the tokens of each queue before it, in closed form.

    Segments hold (first window, cycles, tokens before it, takes of one cycle).
    """

    def __init__(self, totals, shares=None, window: int = WINDOW, cycle: int = CYCLE):
        totals = np.array(totals, np.int64)
        shares = np.array(totals if shares is None else shares, np.float64)
        self.window, left, first = window, totals.copy(), 0
        segments = []
        while left.sum():
            live = (left > 0) & (shares > 0) if ((left > 0) & (shares > 0)).any() else left > 0
            goal = np.where(live, shares if (shares[live] > 0).all() else totals, 0.0)
            quanta = apportioned(goal, window * cycle)
            cycles = int((left[quanta > 0] // quanta[quanta > 0]).min())
            if cycles:
                takes = round_robin(quanta, quanta, cycle, window, cycle)
            else:
                takes, cycles = round_robin(quanta, left, cycle, window, cycle), 1
            segments.append((first, cycles, totals - left, takes))
            first += cycles * len(takes)
            left = left - cycles * takes.sum(0)
        self.windows, self.segments = first, segments
        self.starts = np.array([s[0] for s in segments], np.int64)
        self.cums = [np.vstack([np.zeros(len(totals), np.int64), np.cumsum(s[3], 0)]) for s in segments]
        self.ahead = [np.cumsum(s[3], 1) - s[3] for s in segments]  # of earlier queues in the window

    def window_of(self, queue: int, token: int) -> int:
        """The window that holds a token of a queue."""
        for (first, cycles, before, takes), cum in zip(self.segments, self.cums):
            each = int(cum[-1, queue])
            if token < before[queue] + cycles * each:
                turn, rest = divmod(token - int(before[queue]), each)
                return first + turn * len(takes) + int(np.searchsorted(cum[:, queue], rest, "right")) - 1
        raise IndexError(token)

    def borders(self, queue: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the queue before each window, and the window's tokens of earlier queues."""
        before, ahead = np.empty(len(windows), np.int64), np.empty(len(windows), np.int64)
        where = np.searchsorted(self.starts, windows, "right") - 1
        for k in np.unique(where):
            at = where == k
            first, _, base, takes = self.segments[k]
            turn, row = np.divmod(windows[at] - first, len(takes))
            before[at] = base[queue] + turn * self.cums[k][-1, queue] + self.cums[k][row, queue]
            ahead[at] = self.ahead[k][row, queue]
        return before, ahead

    def cut(self, queue: int, start: int, n: int) -> tuple[np.ndarray, ...]:
        """Pieces of n tokens from ``start`` of a queue: (from, length, window, offset)."""
        a, b = self.window_of(queue, start), self.window_of(queue, start + n - 1)
        windows = np.arange(a, b + 1)
        before, ahead = self.borders(queue, windows)
        low = np.maximum(before, start)
        high = np.append(before[1:], start + n)
        some = high > low
        return (low - start)[some], (high - low)[some], windows[some], (ahead + low - before)[some]


def turns(tail: DataFrame, owed: float) -> DataFrame:
    """source, n, phase, rate, late of each source of the shared queue; ``tail``: source, n, share (all of them, or none above 0).

    Before round r a source has given ``least(n, floor(rate r + phase))`` tokens, with a
    rate of its share of the ``owed`` tokens a round; phases, from a hash of the name,
    keep small sources from coming in clumps. Sources without a share begin in
    round ``late``, when the others are through.
    """
    sums = tail.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("share") > 0, F.col("share"))).alias("share"), F.sum(F.when(F.col("share") > 0, 0).otherwise(F.col("n"))).alias("rest")).first()
    if not sums.n:
        return tail.select("source", "n", F.lit(0.0).alias("phase"), F.lit(1.0).alias("rate"), F.lit(0).cast("long").alias("late"))
    phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    first = F.when(F.col("share") > 0, F.col("share") / F.lit(float(sums.share or 1.0)) * F.lit(owed))
    rest = F.col("n") / F.lit(float(sums.rest or 1)) * F.lit(owed)
    found = tail.select("source", "n", phase.alias("phase"), first.isNull().alias("rest"), F.coalesce(first, rest).alias("rate"))
    last = found.filter("NOT rest").agg(F.max(F.ceil(F.col("n") / F.col("rate")))).first()[0] or 0
    return found.select("source", "n", "phase", "rate", F.when(F.col("rest"), F.lit(int(last) + 1)).otherwise(F.lit(0)).cast("long").alias("late"))


def _given(r) -> F.Column:
    return F.least(F.col("n_source"), F.floor(F.col("rate") * r + F.col("phase"))).cast("long")


def _round(token) -> F.Column:
    """The round that gives a source's token; the quotient may be one off."""
    near = F.greatest(F.lit(0), F.ceil((token + 1 - F.col("phase")) / F.col("rate")) - 1).cast("long")
    return F.when(_given(near) > token, near - 1).when(_given(near + 1) <= token, near + 1).otherwise(near)


def interleaved(runs: DataFrame, tokens: DataFrame, owed: float) -> DataFrame:
    """part, source, at, parts: where the stretches of each document of the shared queue lie in it.

    ``runs``: part, source, n, base (tokens of the source in earlier tasks), share.
    parts: (skip, length, place) of each stretch, in order; their number is bounded by
    the document's length.
    """
    tail = runs.groupBy("source").agg(F.sum("n").alias("n"), F.max("share").alias("share"))
    turn = staged(turns(tail, owed).withColumnRenamed("n", "n_source"), "turns")
    own = tokens.select("part", "source", "at", "n").join(runs.select("part", "source", "base"), ["part", "source"]).join(turn, "source")
    own = own.withColumn("token", F.col("at") + F.col("base"))
    each = own.withColumn("r", F.explode(F.sequence(_round(F.col("token")), _round(F.col("token") + F.col("n") - 1))))
    low = F.greatest(F.col("token"), _given(F.col("r")))
    high = F.least(F.col("token") + F.col("n"), _given(F.col("r") + 1))
    each = each.select("part", "source", "at", (F.col("r") + F.col("late")).alias("r"), (low - F.col("token")).alias("skip"), (high - low).alias("length"), (low - _given(F.col("r"))).alias("inside")).filter("length > 0")
    each = staged(each, "stretches")
    # Tokens before each source's turn: sums within blocks of rounds, and of the blocks before.
    takes = each.groupBy("r", "source").agg(F.sum("length").alias("n")).withColumn("block", F.floor(F.col("r") / 1024))
    up_to = (Window.unboundedPreceding, Window.currentRow)
    blocks = takes.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block").rowsBetween(*up_to)) - F.col("m")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("r", "source").rowsBetween(*up_to)) - F.col("n")
    places = takes.withColumn("before", inside).join(blocks, "block").select("r", "source", (F.col("ahead") + F.col("before")).alias("place"))
    met = each.join(places, ["r", "source"]).select("part", "source", "at", F.struct("skip", "length", (F.col("place") + F.col("inside")).alias("place")).alias("x"))
    return met.groupBy("part", "source", "at").agg(F.sort_array(F.collect_list("x")).alias("parts"))


STRETCHES = "array<struct<skip: bigint, length: bigint, place: bigint>>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, shares: dict | None = None, window: int = WINDOW, queues: int = QUEUES) -> DataFrame:
    """The pieces that each document of ``docs`` (doc_id, text, source) is cut into.

    ``shares`` gives target proportions by source; without it each source gets
    its share of all tokens. Null text is empty (its end token only), null source
    is the empty source; rows that repeat are packed each. Empty in, empty out;
    other columns are not read. Sources beyond the ``queues - 1`` largest keep their
    targets within the queue they share. At most ``queues`` names and the plan, bounded
    by the number of queues, reach the driver and the tasks.
    """
    tokens = staged(tokenised(docs, path), "tokens")
    runs = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    largest = runs.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(queues - 1).collect()
    names = [r.source for r in largest]
    total = tokens.agg(F.sum("n")).first()[0] or 0
    totals = [r.n for r in largest] + [total - sum(r.n for r in largest)]
    goal = None
    if shares is not None:
        goal = [float(shares.get(s, 0.0)) for s in names]
        goal.append(max(0.0, float(sum(shares.values())) - sum(goal)))
    plan = Plan(totals, goal, window)
    queue = F.lit(len(names))
    for k, name in enumerate(names):
        queue = F.when(F.col("source") == name, F.lit(k)).otherwise(queue)
    runs = runs.withColumn("queue", queue)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    tasks = runs.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    tasks = tasks.withColumn("base", F.sum("m").over(Window.partitionBy("queue").orderBy("part").rowsBetween(*up_to)) - F.col("m"))
    inside = F.sum("n").over(Window.partitionBy("queue", "part").orderBy("source").rowsBetween(*up_to)) - F.col("n")
    places = runs.withColumn("inside", inside).join(tasks, ["queue", "part"])
    places = staged(places.select("part", "source", "queue", (F.col("base") + F.col("inside")).alias("base")), "places")
    placed = tokens.join(places, ["part", "source"]).select("doc_id", "n", "ids", "queue", (F.col("base") + F.col("at")).alias("at"), F.lit(None).cast(STRETCHES).alias("parts"))
    if totals[-1]:
        shared = F.col("queue") == len(names)
        by_source = Window.partitionBy("source").orderBy("part").rowsBetween(*up_to)
        tail = runs.filter(shared).withColumn("base", F.sum("n").over(by_source) - F.col("n"))
        share = F.col("n").cast("double")
        if shares is not None:
            given = tokens.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, share double")
            tail, share = tail.join(given, "source", "left"), F.coalesce("share", F.lit(0.0))
        else:
            share = F.sum("n").over(Window.partitionBy("source")).cast("double")
        tail = staged(tail.withColumn("share", share).select("part", "source", "n", "base", "share"), "tail")
        goal_of = np.array(totals if goal is None else goal, float)
        owed = max(1.0, window * (goal_of[-1] / goal_of.sum() if goal_of[-1] else 1.0))
        rest = tokens.join(tail.select("source").distinct(), "source", "left_semi")
        parts = interleaved(tail, rest, owed)
        cut = rest.join(parts, ["part", "source", "at"]).select("doc_id", "n", "ids", F.lit(len(names)).alias("queue"), "at", F.col("parts").cast(STRETCHES).alias("parts"))
        placed = placed.filter(~shared).unionByName(cut)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for doc_id, n, ids, q, at, parts in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns)):
                    wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                    if parts is None:
                        start, length, where, offset = plan.cut(q, at, n)
                    else:
                        cuts = [plan.cut(q, x["place"], x["length"]) for x in parts]
                        start = np.concatenate([c[0] + x["skip"] for c, x in zip(cuts, parts)])
                        length, where, offset = (np.concatenate([c[k] for c in cuts]) for k in (1, 2, 3))
                    view = memoryview(wide).cast("B")
                    crc = [zlib.crc32(view[4 * i : 4 * (i + k)]) for i, k in zip(start.tolist(), length.tolist())]
                    out.append((doc_id, start, length, np.array(crc, np.int64), n, where, offset))
                sizes = [len(x[1]) for x in out]
                whole = {k: pa.array(np.concatenate([x[i] for x in out])) for i, k in ((1, "start"), (2, "length"), (3, "crc"), (5, "seq"), (6, "offset"))}
                rows = np.repeat(np.arange(len(out)), sizes)
                doc = pa.array([x[0] for x in out], pa.int64()).take(pa.array(rows))
                count = pa.array([x[4] for x in out], pa.int64()).take(pa.array(rows))
                columns = [doc, whole["start"], whole["length"], whole["crc"], count, whole["seq"], whole["offset"]]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens in the mixture of their sources."""
    import public_tokenizers

    return pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
