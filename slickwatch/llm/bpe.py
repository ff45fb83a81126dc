"""BPE encoding and decoding of a vocabulary with word ends: speculate and verify.

Greedy longest match (one Aho-Corasick pass over many words) proposes tokens. A
proposal is what BPE yields exactly if each adjacent pair of tokens is
compatible: replaying the merges of both in order of rank, no merge across their
border comes up before one side is merged further. All pairs of a batch are
tested together in NumPy; only words with a failing pair are merged one by one.

Text is normalised as the vocabulary file says (NFC, white space dropped, lower
case, words by its pattern, bytes as letters). Words repeat, so pieces between
white space are remembered, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from slickwatch.llm.common import annotated, table

# The white space of the vocabulary file's normaliser, those of it
# that str.split() takes besides, and the word end mark.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ODD_SPACE = re.compile("[\x1c-\x1f]")
WORD_END = "</w>"
PRIME = 0x1000  # shift of a letter that ends a word
REMEMBERED, LONG, SHORT = 300_000, 60, 24
NO_MERGE = (1 << 40, -1)
NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter of each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary file: tables of merges, the automaton and the memory of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.letters = byte_letters()
        size = max(vocab.values()) + 1
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        new = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        self.left[new], self.right[new], self.made[new] = a, b, np.arange(len(merges))
        keys = a << 20 | b
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merge = {(x, y): (r, z) for r, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), new.tolist()))}
        self.base = {self.form(t): i for t, i in vocab.items() if self.made[i] < 0}
        # A token can be proposed if merging its own letters yields it.
        sound = np.ones(size, bool)
        crossed = self.crossed(a, b, np.arange(len(merges)))
        for r, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), new.tolist())):
            sound[z] = sound[x] and sound[y] and not crossed[r]
        self.longest = ahocorasick.Automaton()
        for t, i in vocab.items():
            if sound[i]:
                self.longest.add_word(self.form(t), i)
        self.longest.make_automaton()
        self.memory: dict[str, tuple[int, str, str]] = {}  # of pieces between white space
        self.spelt: dict[str, tuple[int, str, str]] = {}  # of words, which more pieces share
        self.checked, self.merged = 0, 0

    @staticmethod
    def form(token: str) -> str:
        """A token as letters, the last one shifted if it ends a word."""
        if not token.endswith(WORD_END) or token == WORD_END:
            return token
        body = token[: -len(WORD_END)]
        return body[:-1] + chr(ord(body[-1]) + PRIME)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def crossed(self, a: np.ndarray, b: np.ndarray, limit=None) -> np.ndarray:
        """True where a merge across the border of tokens ``a`` and ``b`` comes first.

        Undoes the merges of both sides from the last one back; at each moment
        the two tokens at the border must not merge before one of them is used.
        """
        out = np.zeros(len(a), bool)
        used_a = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        used_b, rows, a, b = used_a.copy(), np.arange(len(a)), a.copy(), b.copy()
        while len(rows):
            rank = self.rank_of(a, b)
            hit = (rank < used_a) & (rank <= used_b) & (rank < NEVER)
            if limit is not None:
                hit &= rank < limit[rows]
            out[rows[hit]] = True
            undo_a = self.made[a] > self.made[b]
            go = ~hit & (undo_a | (self.made[b] >= 0))
            used_a, used_b = np.where(undo_a, self.made[a], used_a), np.where(undo_a, used_b, self.made[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            rows, a, b, used_a, used_b = rows[go], a[go], b[go], used_a[go], used_b[go]
        return out

    def exact(self, ids: list[int]) -> list[int]:
        """Merges by rank, leftmost first, for words whose proposal failed; long ones use a heap."""
        n, get = len(ids), self.merge.get
        if n <= SHORT:
            pairs = [get(p, NO_MERGE) for p in zip(ids, ids[1:])]
            while pairs:
                best = min(pairs)
                if best is NO_MERGE:
                    break
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = get((ids[i - 1], best[1]), NO_MERGE)
                if i < len(pairs):
                    pairs[i] = get((best[1], ids[i + 1]), NO_MERGE)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.merge[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.merge[pair][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], x, p))
        return [t for t, live in zip(ids, alive) if live]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (lower case, not empty)."""
        if not words:
            return []
        forms = []
        for w in words:
            body = w if w.isascii() and w.isprintable() else "".join([self.letters[x] for x in w.encode()])
            forms.append(body[:-1] + chr(ord(body[-1]) + PRIME))
        found = np.fromiter(self.longest.iter_long("".join(forms)), np.dtype((np.int64, 2)))
        ends, ids = found[:, 0], found[:, 1]
        word = np.searchsorted(np.cumsum([len(f) for f in forms]), ends, "right")
        same = word[1:] == word[:-1]
        pairs, where = np.unique((ids[:-1] << 20 | ids[1:])[same], return_inverse=True)
        bad = self.crossed(pairs >> 20, pairs & (1 << 20) - 1)[where]
        failed = set(word[1:][same][bad].tolist())
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        flat = ids.tolist()
        out = [flat[i:j] for i, j in zip(bounds, bounds[1:])]
        for k in failed:
            out[k] = self.exact([self.base[c] for c in forms[k]])
        self.checked += len(words)
        self.merged += len(failed)
        return out

    def pieces(self, text: str) -> list:
        """Pieces between white space, normalised; a special token is its id."""
        if not text:
            return []
        out: list = []
        for part in self.split.split(text) if self.split and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            odd = ODD_SPACE.search(part)
            low = part.replace("Σ", "σ").lower()
            out += [x for x in re.split(f"[{SPACE}]+", low) if x] if odd else low.split()
        return out

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """For each text its pieces as (tokens, ids, token texts), joined by spaces."""
        for memory in (self.memory, self.spelt):
            if len(memory) > REMEMBERED:
                memory.clear()
        split = [self.pieces(t) for t in texts]
        known, spelt, find = self.memory, self.spelt, self.words.findall
        new = {p for ps in split for p in ps if p not in known}
        words = {p: find(p) if isinstance(p, str) else [] for p in new}
        unspelt = list({w for ws in words.values() for w in ws if w not in spelt})
        long: dict = {}
        for w, ids in zip(unspelt, self.encode_words(unspelt)):
            entry = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
            (spelt if len(w) <= LONG else long)[w] = entry
        own: dict = {}
        for p, ws in words.items():
            if len(ws) == 1:
                entry = spelt.get(ws[0]) or long[ws[0]]
            elif isinstance(p, str):
                each = [spelt.get(w) or long[w] for w in ws]
                entry = (sum([e[0] for e in each]), " ".join([e[1] for e in each]), " ".join([e[2] for e in each]))
            else:
                entry = (1, str(p), self.names[p])
            (own if isinstance(p, str) and len(p) > LONG else known)[p] = entry
        return [[own[p] if p in own else known[p] for p in ps] for ps in split]


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One table in each worker process."""
    return Bpe(path)


KIND = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"


def _digests(path: str):
    def run(texts: pa.Array) -> pa.Array:
        bpe, out = loaded(path), ([], [], [])
        values = texts.to_pylist()
        for i in range(0, len(values), 64):
            for parts in bpe.encode(values[i : i + 64]):
                full = [p for p in parts if p[0]]
                out[0].append(sum([p[0] for p in full]))
                out[1].append(sha256(" ".join([p[1] for p in full]).encode()).hexdigest())
                out[2].append(sha256(" ".join([p[2] for p in full]).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return run


def _coded(path: str):
    def run(texts: pa.Array) -> pa.Array:
        bpe, out = loaded(path), []
        for text in texts.to_pylist():
            parts = [p for p in bpe.encode([text])[0] if p[0]]
            ids = [int(i) for p in parts for i in p[1].split(" ")]
            out.append({"ids": ids, "decoded": " ".join([p[2] for p in parts])})
        return pa.array(out, pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return run


def encoded(docs: DataFrame, path: str, name: str = "tokens") -> DataFrame:
    """``docs`` with a struct of token ids and the text they decode to.

    The file has no decoder, so tokens are joined by spaces, word ends kept.
    Null text is empty (no ids). Rows, repeated ones too, stay as they are.
    """
    return annotated(docs, name, _coded(path), "struct<ids: array<int>, decoded: string>", "text")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``."""
    rows = annotated(docs.select("doc_id", "text"), "d", _digests(path), KIND, "text")
    return rows.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    import public_tokenizers

    return digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
