"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all matches of the vocabulary's pieces; dynamic
programming over them carries, for each position, the best score and the number
of tokens of the best path, and no path. Tie rules are those of the unigram
tokenizer: candidates come by their start from left to right, and only a better
score replaces one, so of equal scores the longest last piece wins. A letter
that no piece holds alone costs ten less than the worst score and counts one
token for each UTF-8 byte, as byte fallback spells it.

No piece runs on over a space, so a text is cut before each run of spaces, and
the pieces between are counted once and remembered, up to a bound.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from slickwatch.llm.common import annotated, table

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer
REMEMBERED, LONG, AT_ONCE = 500_000, 60, 1 << 16
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Unigram:
    """Pieces and scores, the automaton, and the memory of counts."""

    def __init__(self, pieces: list[tuple[str, float]], worst: float):
        self.unknown = worst - UNKNOWN_PENALTY
        self.apart = all(MARK not in p.lstrip(MARK) for p, _ in pieces)
        self.sizes = np.array([len(p) for p, _ in pieces], np.int64)
        self.scores = np.array([s for _, s in pieces], np.float64)
        self.matches = ahocorasick.Automaton()
        for i, (p, _) in enumerate(pieces):
            self.matches.add_word(p, i)
        self.matches.make_automaton()
        self.memory: dict[str, int] = {}

    def count_each(self, parts: list[str]) -> list[int]:
        """Tokens of each part (not empty), all positions of the same distance at once."""
        text = "".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        found = np.fromiter(self.matches.iter(text), np.dtype((np.int64, 2)))
        end, piece = found[:, 0] + 1, found[:, 1]
        start, score = end - self.sizes[piece], self.scores[piece]
        held = np.zeros(len(text), bool)
        held[start[end == start + 1]] = True
        lone = np.flatnonzero(~held)
        width = np.array([len(text[i].encode("utf-8", "surrogatepass")) for i in lone.tolist()], np.int64)
        start = np.concatenate([start, lone])
        end = np.concatenate([end, lone + 1])
        score = np.concatenate([score, np.full(len(lone), self.unknown)])
        tokens = np.concatenate([np.ones(len(piece), np.int64), width])
        part = np.searchsorted(ends, end - 1, "right")
        inside = start >= begins[part]
        start, end, score, tokens, part = (x[inside] for x in (start, end, score, tokens, part))
        level = end - begins[part]
        order = np.lexsort((start, end, level))
        start, end, score, tokens, level = (x[order] for x in (start, end, score, tokens, level))
        # Positions of different parts need one slot more: the start of a part is not the end of the last.
        shift = part[order]
        start, end = start + shift, end + shift
        best = np.full(len(text) + len(parts), -np.inf)
        count = np.zeros(len(text) + len(parts), np.int64)
        best[begins + np.arange(len(parts))] = 0.0
        bounds = np.searchsorted(level, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, e = start[a:b], end[a:b]
            total = best[s] + score[a:b]
            first = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            top = np.maximum.reduceat(total, first)
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
            hits = np.flatnonzero(total == top[row])
            pick = hits[np.append(True, row[hits][1:] != row[hits][:-1])]
            best[e[pick]] = total[pick]
            count[e[pick]] = count[s[pick]] + tokens[a:b][pick]
        return count[ends + np.arange(len(parts))].tolist()

    def parts(self, text: str) -> list[str]:
        """The text with marks for spaces, one more before it, in parts no piece runs over."""
        if not text:
            return []
        if not self.apart:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return RUNS.findall(MARK + text.replace(" ", MARK))
        return (" " + text).replace(" ", " " + MARK).split(" ")[1:]

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        split = [self.parts(t or "") for t in texts]
        known, long = self.memory, {}
        new = list({p for ps in split for p in ps if p not in known})
        at = 0
        while at < len(new):
            group, size = [], 0
            while at < len(new) and (not group or size + len(new[at]) <= AT_ONCE):
                group.append(new[at])
                size += len(new[at])
                at += 1
            for p, n in zip(group, self.count_each(group)):
                (known if len(p) <= LONG else long)[p] = n
        return [sum([long[p] if p in long else known[p] for p in ps]) for ps in split]


@lru_cache(maxsize=2)
def loaded(path: str) -> Unigram:
    """The normal pieces of a SentencePiece file with their scores; control and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    skip = [model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in ids if not skip[i]]
    return Unigram(pieces, min(s for _, s in pieces))


def _counts(path: str):
    def run(texts: pa.Array) -> pa.Array:
        unigram, values = loaded(path), texts.to_pylist()
        out = [n for i in range(0, len(values), 64) for n in unigram.counts(values[i : i + 64])]
        return pa.array(out, pa.int64())

    return run


def counted(docs: DataFrame, path: str, name: str = "n_tokens") -> DataFrame:
    """``docs`` with its number of tokens in a column ``name``.

    Null and empty texts have none; rows, repeated ones too, stay as they are.
    """
    return annotated(docs, name, _counts(path), "long", "text")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and number of tokens of every document."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return counted(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")
