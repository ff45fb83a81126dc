"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words counts the four letters they share as subsequences,
each discounted by ``DECAY`` for every letter of the stretch it spans (up to
``SPAN`` letters, so that up to ``SPAN - 4`` foreign letters may stand between). Marks
inside a word do not count as letters, letters spelt out one by one are joined, and
two short neighbours are also read as one word, so that gapped insults look like the
plain ones. A word with an inserted letter scores as its best copy without one.

Landmarks are words of labelled sentences. The machine sees a word by its
kernels with them, whitened (Nyström); a sentence counts by its worst word. It is trained
on bounded samples of sentences of labelled documents: in turn, the worst word of
each sentence is found, and the margin is fitted to those words. Its decision is a sum
of kernels with landmarks, that is, one weight for each four letters, which scores every
word of every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import annotated, flat, rank_digits, steps, table

LETTERS, SPAN, DECAY = 32, 6, 0.6
SHORT = 4  # letters of a word that may be half of a parted one
FOURS = LETTERS**4
SAMPLES = (2500, 1000)  # labelled documents that training sees, at most: clean, toxic
OF_A_DOCUMENT = 1024  # sentences of one document that training sees, at most: those of least hash
WINDOW = 64  # words of a sentence; longer ones are cut
SHORTENED = (5, 24)  # letters of a word that is also read with one letter left out
LEFT_OUT = 0.03  # what that costs
REMEMBERED = 400_000  # words whose decision a task keeps
LANDMARKS, SENTENCES, TURNS, MINED = 480, 4000, 6, 4000
RECURRING, LONGEST = 20_000, 40
#: For a toxic landmark: toxic documents with the word, and its log-likelihood ratio beyond the log of the number of words.
EVIDENCE = (3, 8.0)
CERTAIN = 0.9  # decision beyond which a word is no more toxic than another
MARGIN_DECAY = 1e-3
THRESHOLD = 0.7

# Letters. 0 none, 1 to 26 a to z, other bytes by their low bits.
CODES = np.zeros(256, np.int64)
CODES[97:123], CODES[65:91] = np.arange(1, 27), np.arange(1, 27)
CODES[128:192] = 27 + np.arange(64) % 3
OPENS, CLOSES = 30, 31  # ends of a word
#: 1 where a byte parts words, 2 where it is dropped inside one.
ROLES = np.where(CODES > 0, 0, 2)
ROLES[[9, 10, 11, 12, 13, 32]] = 1
SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)|\n+")


def _framed(letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters with marks around each word, and the first of each word there."""
    if not len(starts):
        return letters[:0], starts
    begins = starts + 2 * np.arange(len(starts))
    framed = np.full(len(letters) + 2 * len(starts), CLOSES)
    inside = np.ones(len(framed), bool)
    inside[begins] = inside[np.append(begins[1:], len(framed)) - 1] = False
    framed[inside] = letters
    framed[begins] = OPENS
    return framed, begins


def parsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all letters, number of each word's first letter among them, and the word's text.

    A space between two single letters does not part words.
    """
    n = len(data)
    role = ROLES[data]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    space = role == 1
    letter = role == 0
    # letters of each run between spaces
    run = np.cumsum(space | begin[:n])
    size = np.bincount(run, letter, int(run[-1]) + 1 if n else 1)
    at = np.flatnonzero(letter)
    if not len(at):
        return at, at, at
    of = run[at]
    new = np.append(True, of[1:] != of[:-1])
    single = size[of] == 1
    joined = np.append(False, single[1:] & single[:-1] & (rows[at][1:] == rows[at][:-1]) & (at[1:] - at[:-1] == 2) & space[np.minimum(at[1:] - 1, n - 1)])
    starts = np.flatnonzero(new & ~joined)
    return at, starts, rows[at][starts]


def words_of(data: np.ndarray, offsets: np.ndarray, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words in a row between marks of their ends, the first of each word, and the word's text."""
    at, starts, rows = found or parsed(data, offsets)
    return *_framed(CODES[data[at]], starts), rows


def joined_of(data: np.ndarray, offsets: np.ndarray, found: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`words_of`, of two short neighbours read as one word: an insult with a space inside."""
    at, starts, rows = found or parsed(data, offsets)
    if len(starts) < 2:
        return np.zeros(0, np.int64), starts[:0], rows[:0]
    ends = np.append(starts[1:], len(at))
    size = ends - starts
    beside = (rows[1:] == rows[:-1]) & (at[starts[1:]] - at[ends[:-1] - 1] == 2) & (size[1:] <= SHORT) & (size[:-1] <= SHORT) & (size[1:] + size[:-1] > SHORT)
    first = np.flatnonzero(beside)
    long = size[first] + size[first + 1]
    begins = np.cumsum(long) - long
    letters = np.arange(long.sum()) + np.repeat(starts[first] - begins, long)
    return *_framed(CODES[data[at[letters]]], begins), rows[first]


def fours(codes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(last letters' places, fours, weight) for each way to span 4 to SPAN letters of one word."""
    n = len(codes)
    word = np.zeros(n, np.int64)
    word[starts] = 1
    word = np.cumsum(word) - 1
    place = np.arange(n) - starts[word] if n else word
    out = []
    for span in range(4, SPAN + 1):
        last = np.flatnonzero(place >= span - 1)
        ends = codes[last - span + 1] * LETTERS**3 + codes[last]
        for i, j in combinations(range(1, span - 1), 2):
            out.append((last, ends + codes[last - j] * LETTERS**2 + codes[last - i] * LETTERS, DECAY**span))
    return out


def norms(sizes: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector if all its fours differ; at least that of a two-letter word."""
    total = np.zeros(len(sizes))
    for span in range(4, SPAN + 1):
        total += (span - 2) * (span - 3) / 2 * np.maximum(sizes - span + 1, 0) * DECAY ** (2 * span)
    return np.sqrt(np.maximum(total, DECAY**8))


def decisions(weights: np.ndarray, bias: float, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each word."""
    each = np.zeros(len(codes))
    for last, four, weight in fours(codes, starts):
        each[last] += weight * weights[four]
    sizes = np.diff(np.append(starts, len(codes)))
    return (np.add.reduceat(each, starts) if len(starts) else np.zeros(0)) / norms(sizes) + bias


def _picked(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words one after the other, each without its letter number ``skip``."""
    kept = sizes - 1
    begins = np.cumsum(kept) - kept
    place = np.arange(kept.sum()) - np.repeat(begins, kept)
    return codes[np.repeat(starts, kept) + place + (place >= np.repeat(skip, kept))], begins


def tolerant(weights: np.ndarray, bias: float, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each word, or of its best copy with a letter left out or letters said once, less ``LEFT_OUT``.

    The kernel alone lets a foreign letter stand in a stretch, at the price of its
    decay; so the word is also matched without it.
    """
    if not len(starts):
        return np.zeros(0)
    length = np.diff(np.append(starts, len(codes)))
    best = decisions(weights, bias, codes, starts)
    inner = length - 2
    long = np.flatnonzero((inner >= SHORTENED[0]) & (inner <= SHORTENED[1]))
    for i in range(0, len(long), 20_000):
        some = long[i : i + 20_000]
        owner = np.repeat(some, inner[some])
        skip = np.arange(len(owner)) - np.repeat(np.cumsum(inner[some]) - inner[some], inner[some]) + 1
        copies = decisions(weights, bias, *_picked(codes, starts[owner], length[owner], skip))
        np.maximum.at(best, owner, copies - LEFT_OUT)
    again = np.append(False, codes[1:] == codes[:-1])
    again[starts] = False
    owner = np.unique(np.searchsorted(starts, np.flatnonzero(again), "right") - 1)
    if len(owner):
        once = np.repeat(np.isin(np.arange(len(starts)), owner), length) & ~again
        left = np.add.reduceat(once, starts)[owner]
        np.maximum.at(best, owner, decisions(weights, bias, codes[once], np.cumsum(left) - left) - LEFT_OUT)
    return best


def names(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    sizes = np.diff(np.append(starts, len(codes)))
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.add.reduceat(mixed ^ (mixed >> np.uint64(30)), starts)


class Landmarks:
    """Normalised feature vectors of some words over the fours that any of them has."""

    def __init__(self, words: list[np.ndarray]):
        each = [[(f, w) for _, four, w in fours(x, np.zeros(1, np.int64)) for f in four.tolist()] for x in words]
        self.fours = np.array(sorted({f for x in each for f, _ in x}), np.int64)
        column = {f: k for k, f in enumerate(self.fours.tolist())}
        self.where = np.full(FOURS, len(self.fours), np.int64)
        self.where[self.fours] = np.arange(len(self.fours))
        self.columns = np.zeros((len(self.fours) + 1, len(words)), np.float32)  # the last for all other fours
        for k, (x, word) in enumerate(zip(each, words)):
            for f, w in x:
                self.columns[column[f], k] += w
            self.columns[:, k] /= norms(np.array([len(word)]))[0]

    def kernels(self, words: list[np.ndarray]) -> np.ndarray:
        """Kernels of words with the landmarks, in columns; some words at a time."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            sizes = np.array([len(w) for w in part])
            starts = np.cumsum(sizes) - sizes
            total = np.zeros((len(part), self.columns.shape[1]))
            for last, four, weight in fours(np.concatenate(part), starts):
                column = self.where[four]
                seen = column < len(self.fours)
                row = np.searchsorted(starts, last[seen], "right") - 1
                if len(row):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    total[row[first]] += weight * np.add.reduceat(self.columns[column[seen]], first, axis=0)
            out.append((total / norms(sizes)[:, None]).astype(np.float32))
        return np.vstack(out) if out else np.zeros((0, self.columns.shape[1]))

    def weights(self, parts: np.ndarray) -> np.ndarray:
        """One weight for each four, for a sum of kernels with these factors."""
        out = np.zeros(FOURS, np.float32)
        out[self.fours] = self.columns[:-1] @ parts
        return out


class Model:
    """Weights of fours, bias, and the logistic of a text's worst word."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset
        self.memory: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def decided(self, decide: Callable, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Decision of each word; up to ``REMEMBERED`` of those already worked out in this task are looked up."""
        name, one, at = np.unique(names(codes, starts), return_index=True, return_inverse=True)
        known, values = self.memory.get(decide.__name__, (name[:0], np.zeros(0)))
        place = np.searchsorted(known, name)
        hit = place < len(known)
        hit[hit] = known[place[hit]] == name[hit]
        out = np.zeros(len(name))
        out[hit] = values[place[hit]]
        new = one[~hit]
        sizes = np.diff(np.append(starts, len(codes)))[new]
        begins = np.cumsum(sizes) - sizes
        out[~hit] = decide(self.weights, self.bias, codes[np.arange(sizes.sum()) + np.repeat(starts[new] - begins, sizes)], begins)
        if len(known) + len(new) > REMEMBERED:
            known, values = known[:0], values[:0]
        known, values = np.concatenate([known, name[~hit]]), np.concatenate([values, out[~hit]])
        order = np.argsort(known)
        self.memory[decide.__name__] = known[order], values[order]
        return out[at]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """0 to 1 for each text: the logistic of its worst word; texts without words as if it were at -2."""
        data, offsets = flat(texts)
        worst = np.full(len(offsets) - 1, -2.0)
        for i, j in steps(offsets):
            part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            found = parsed(*part)
            for read, decide in ((words_of, tolerant), (joined_of, decisions)):
                codes, starts, rows = read(*part, found)
                if len(starts):
                    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    top = np.maximum.reduceat(self.decided(decide, codes, starts), first)
                    worst[i + rows[first]] = np.maximum(top, worst[i + rows[first]])
        worst = np.minimum(worst, CERTAIN)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -60, 60)))


def _margin(x: np.ndarray, at: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Support vector machine on the rows ``at`` of ``x``, weighted examples, squared hinge loss.

    Newton steps on the violators; their sums are taken some rows at a time.
    """
    n = x.shape[1] + 1
    keep = np.full(n, MARGIN_DECAY)
    keep[-1] *= 1e-3  # the bias is hardly held back
    w, before = np.zeros(n), None
    for _ in range(50):
        bad, left, right = np.zeros(len(at), bool), np.diag(keep), np.zeros(n)
        for i in range(0, len(at), 4000):
            part = np.hstack([x[at[i : i + 4000]].astype(np.float64), np.ones((len(at[i : i + 4000]), 1))])
            bad[i : i + 4000] = out = y[i : i + 4000] * (part @ w) < 1
            part, weight = part[out], cost[i : i + 4000][out]
            left = left + (part * weight[:, None]).T @ part
            right = right + part.T @ (weight * y[i : i + 4000][out])
        if before is not None and (bad == before).all():
            break
        before, w = bad, np.linalg.solve(left, right)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on softened targets; the clean class weighs four times the toxic one."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    goal = np.where(y > 0, high, low)
    weigh = np.where(y > 0, 0.2 / max(y.sum(), 1), 0.8 / max((1 - y).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.array([(weigh * (p - goal) * x).sum() + 1e-4 * a, (weigh * (p - goal)).sum()])
        h = weigh * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        a, b = (a, b) - np.clip(np.linalg.solve(hess, g), -2, 2)
    return float(a), float(b)


def sentence_bags(text: str) -> list[list[bytes]]:
    """Different words of the sentences of one whole text: at most ``OF_A_DOCUMENT`` of them, those of least hash.

    A sentence is cut into windows of ``WINDOW`` words, a word into overlapping
    stretches of ``LONGEST`` letters, so that nothing is too long to teach.
    """
    bags: dict[int, list[bytes]] = {}
    data, offsets = flat(pa.array([x for x in SENTENCE.split(text) if x], pa.string()))
    for first, last in steps(offsets):
        part = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        found = parsed(*part)
        held: dict[tuple[int, int], set] = {}
        number = np.arange(len(found[1])) - np.searchsorted(found[2], found[2]) if len(found[1]) else found[1]
        for read in (words_of, joined_of):
            codes, starts, rows = read(*part, found)
            letters, ends = codes.astype(np.uint8).tobytes(), np.append(starts[1:], len(codes))
            place = number if read is words_of else np.arange(len(starts)) - np.searchsorted(rows, rows)
            for i, j, row, k in zip(starts.tolist(), ends.tolist(), rows.tolist(), place.tolist()):
                if j - i >= 5:
                    bag = held.setdefault((row, k // WINDOW), set())
                    bag.update(letters[x : min(x + LONGEST, j)] for x in range(i, max(i + 1, j - LONGEST // 4), LONGEST * 3 // 4))
        for bag in held.values():
            words = sorted(bag)
            bags[zlib.crc32(b" ".join(words))] = words
        if len(bags) > 4 * OF_A_DOCUMENT:
            bags = {k: bags[k] for k in sorted(bags)[:OF_A_DOCUMENT]}
    return [bags[k] for k in sorted(bags)[:OF_A_DOCUMENT]]


#: Between words and between sentences of what a task gives back; letters are below 32.
WORD_END, BAG_END = b"\xfe", b"\xff"


def fit(documents: list[tuple[bytes, int]]) -> Model:
    """A model of labelled documents (sentences of words, 1 toxic or 0), in an order that does not depend on the labels.

    Its logistic is still that of the plain decision. With one class only, or no word that
    tells them apart, all scores are the rate of toxic documents.
    """
    number: dict[bytes, int] = {}  # of each word
    once: dict[tuple[bytes, int], int] = {}
    for k, (sentences, toxic) in enumerate(documents):
        for bag in filter(None, sentences.split(BAG_END)):
            ids = np.array(sorted(number.setdefault(w, len(number)) for w in bag.split(WORD_END)), "<i4").tobytes()
            once.setdefault((ids, toxic), k)  # a sentence that copies of a document share is evidence once
    spell, size = list(number), len(number)
    del number
    bags, labels, owners = [b for b, _ in once], np.array([t for _, t in once], np.int64), np.array(list(once.values()), np.int64)
    del once
    members = lambda i: np.frombuffer(bags[i], "<i4")
    toxic_docs = sum(t for _, t in documents)
    clean_docs = len(documents) - toxic_docs
    rate = toxic_docs / len(documents) if documents else 0.0
    constant = Model(np.zeros(FOURS, np.float32), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    if not toxic_docs or not clean_docs or not size:
        return constant
    seen = np.zeros((2, size), np.int64)
    for at in np.split(np.argsort(owners, kind="stable"), np.flatnonzero(np.diff(np.sort(owners))) + 1):
        if len(at):
            seen[labels[at[0]], np.unique(np.concatenate([members(i) for i in at]))] += 1
    if not seen[0].any() or not seen[1].any():
        return constant
    # Log-likelihood ratio of a word's documents, signed by where it is more frequent.
    a, c = (seen[1] + 0.1) / (toxic_docs + 0.2), (seen[0] + 0.1) / (clean_docs + 0.2)
    lift = seen[1] * np.log(a / c) + seen[0] * np.log(c / a)
    chance = EVIDENCE[1] + np.log((seen[1] > 0).sum())  # of so many words some stand out by chance
    evident = (seen[1] >= EVIDENCE[0]) & (seen[1] / toxic_docs > seen[0] / clean_docs) & (lift > chance)
    suspects = sorted(np.flatnonzero(evident).tolist(), key=lambda w: (-lift[w], spell[w]))[: LANDMARKS // 2]
    if not suspects:
        return constant
    decode = lambda words: [np.frombuffer(spell[w], np.uint8).astype(np.int64) for w in words]
    strong = np.zeros(size, bool)
    strong[suspects] = True
    # Clean landmarks: the most frequent words, and of those that recur the ones most like the suspects.
    plain = sorted(np.flatnonzero((seen[0] > 0) & ~strong).tolist(), key=lambda w: (-seen[0][w], spell[w]))
    recur = plain[:RECURRING]
    alike = Landmarks(decode(suspects)).kernels(decode(recur)).max(1) if recur else np.zeros(0)
    hard = [recur[k] for k in np.argsort(-alike, kind="stable")[: LANDMARKS // 4]]
    marks = list(dict.fromkeys(suspects + plain[: LANDMARKS // 4] + hard))
    base = Landmarks(decode(marks))
    value, vector = np.linalg.eigh(base.kernels(decode(marks)).astype(np.float64))
    real = value > 1e-3
    whiten = vector[:, real] / np.sqrt(value[real])

    order = sorted(range(len(bags)), key=lambda i: (zlib.crc32(b" ".join(spell[w] for w in members(i)[:3].tolist()) + str(owners[i]).encode()), i))
    positive = [i for i in order if labels[i] and strong[members(i)].any()][: SENTENCES // 2]
    negative = [i for i in order if not labels[i]][:SENTENCES]
    row = np.full(size, -1, np.int64)  # of a word's features
    x = np.zeros((0, int(real.sum())), np.float32)

    def known(words: np.ndarray) -> None:
        nonlocal x
        fresh = words[row[words] < 0]
        row[fresh] = len(x) + np.arange(len(fresh))
        x = np.vstack([x, (base.kernels(decode(fresh.tolist())) @ whiten).astype(np.float32)])

    clean = np.zeros(size, bool)
    for i in negative:
        clean[members(i)] = True
    inside = [members(i) for i in positive]
    known(np.unique(np.concatenate([*inside, np.flatnonzero(clean).astype("<i4")])))
    # Every word of a clean sentence is clean. Of a toxic one its strong words are toxic, and its worst word.
    # Clean words beyond the drawn sentences join once the machine takes them for toxic.
    often = np.zeros(size, np.int64)
    for i in np.flatnonzero(labels == 0):
        often[members(i)] += 1
    pool = np.flatnonzero(often)
    told = np.concatenate([m[strong[m]] for m in inside])
    score = np.where(strong, lift, -1e9)
    for _ in range(TURNS):
        toxic_words, times = np.unique(np.concatenate([told, [m[np.argmax(score[m])] for m in inside]]).astype(np.int64), return_counts=True)
        against = np.flatnonzero(clean)
        y = np.repeat([1.0, -1.0], [len(toxic_words), len(against)])
        cost = np.sqrt(np.concatenate([times, often[against]]))
        cost /= np.where(y > 0, cost[y > 0].sum(), cost[y < 0].sum())
        w, b = _margin(x, row[np.concatenate([toxic_words, against])], y, cost)
        weights = base.weights(whiten @ w)
        worst = np.zeros(len(pool))
        for i in range(0, len(pool), 20_000):
            part = decode(pool[i : i + 20_000].tolist())
            ends = np.cumsum([len(p) for p in part])
            worst[i : i + 20_000] = decisions(weights, b, np.concatenate(part), np.append(0, ends[:-1]))
        worst = pool[[k for k in np.argsort(-worst, kind="stable")[:MINED] if worst[k] > -1]].astype(np.int64)
        known(worst)
        clean[worst] = True
        score = np.where(row >= 0, (x @ w + b)[row], -1e9)
    return Model(weights, b, 1.0, 0.0)


def trained(docs: DataFrame, labels: DataFrame, samples: tuple[int, int] = SAMPLES) -> Model:
    """A model of ``docs`` (doc_id, text) labelled by ``labels`` (doc_id, toxic).

    At most ``samples`` ids of the clean and the toxic, those of least hash, are drawn and
    broadcast. Tasks read their whole texts and give back bounded bags of words.
    A third of the documents is kept from the machine: tasks score them whole, and
    those scores alone set the logistic. An id with both labels counts as toxic; null
    ids and labels teach nothing.
    """
    each = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    clean, toxic = (each.filter(f"toxic = {k}").orderBy(*order).limit(samples[k]) for k in (0, 1))
    drawn = clean.unionByName(toxic)
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(drawn), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("a"), F.sha2("text", 256).alias("b"), F.col("toxic").cast("int").alias("toxic"), "text")
    apart = drawn.count() >= 30
    held = F.pmod(F.hash("a", F.lit("held")), F.lit(3)) == 0
    pack = lambda text: BAG_END.join(WORD_END.join(bag) for bag in sentence_bags(text))
    bags = F.arrow_udf(lambda texts: pa.array([pack(t.as_py()) for t in texts], pa.binary()), "binary")
    taught = (rows.filter(~held) if apart else rows).select("a", "b", "toxic", bags("text").alias("bags")).collect()
    model = fit([(bytes(r.bags), r.toxic) for r in sorted(taught, key=lambda r: (r.a, r.b))[: sum(samples)]])
    del taught
    if model.slope:
        found = scored(rows.filter(held) if apart else rows, model, "_top").select("a", "b", "toxic", "_top").collect()
        found = sorted(found, key=lambda r: (r.a, r.b))[: sum(samples)]
        top = np.array([r["_top"] for r in found])
        top = np.log(np.maximum(top, 1e-12) / np.maximum(1 - top, 1e-12))
        model.slope, model.offset = _logistic(top, np.array([float(r.toxic) for r in found]))
    return model


def _scorer(model: Model) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return run


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 in a column ``name``.

    Null and empty texts score as texts without words, the lowest. Rows,
    repeated ones too, stay as they are; other columns stay, and a taken ``name`` fails.
    """
    return annotated(docs, name, _scorer(model), "double", "text")


def model_of(spark: SparkSession, folder: str) -> Model:
    """What the labels outside the held-out fold teach."""
    labels = table(spark, folder, "labels").filter(~rank_digits("doc_id", 3, 1))
    return trained(table(spark, folder, "documents"), labels)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = scored(docs, model_of(spark, folder))
    held = rank_digits("doc_id", 3, 1).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
