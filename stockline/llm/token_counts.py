"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries,
for each place, the best score and the number of pieces of the path that has it. The rules
for ties are the tokenizer's: a higher score wins, and of equal ones the piece that starts
first. A character that no one-character piece covers may stand alone at the lowest score
less 10 and counts as its UTF-8 bytes (byte fallback).

Blanks are written as ▁ and one is put before the text. No piece has a ▁ after another
character, and no piece has a line break (both are checked), so every path has a node there:
the text falls into parts whose best paths are independent, scores being whole numbers that
add up exactly. Each distinct part is solved once; the table of parts is bounded.

A null or empty text has no tokens. Repeated rows give repeated rows. Control and byte pieces
never match text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
_CUT = "\ufdd0"


def vocabulary(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file that match text, with their scores."""
    from sentencepiece import SentencePieceProcessor

    s = SentencePieceProcessor(model_file=path)
    return {s.id_to_piece(i): s.get_score(i) for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))}


class Counter:
    def __init__(self, pieces: dict[str, float], most: int = 1_000_000, most_chars: int = 24_000_000):
        import ahocorasick

        for p, score in pieces.items():
            if BLANK in p.lstrip(BLANK) or "\n" in p or _CUT in p or score != int(score):
                raise ValueError(f"piece {p!r} does not allow independent parts")
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), float(score)))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.most, self.most_chars = most, most_chars
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.counts: list[int] = []
        self.scores: list[float] = []

    def solve(self, part: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        n, single = len(part), self.single
        best: list[float | None] = [0.0] + [None] * n
        count, done = [0] * (n + 1), 0

        def alone(upto: int) -> None:
            """The characters before ``upto`` that stand for no piece, now that all matches there are in."""
            for i in range(done, upto):
                if part[i] not in single:
                    at = best[i] + self.unknown
                    if best[i + 1] is None or at > best[i + 1]:
                        best[i + 1], count[i + 1] = at, count[i] + len(part[i].encode())

        # Matches come by their ends, and at one end the longest, which starts first, comes first.
        for end, (length, score) in self.automaton.iter(part):
            if done < end:
                alone(end)
                done = end
            at = best[end + 1 - length] + score
            if best[end + 1] is None or at > best[end + 1]:
                best[end + 1], count[end + 1] = at, count[end + 1 - length] + 1
        alone(n)
        return best[n], count[n]

    def _codes(self, parts: list[str]) -> np.ndarray:
        new = [p for p in parts if p not in self.index]
        if self.index and (len(self.index) + len(new) > self.most or self.chars > self.most_chars):
            self._reset()
            new = parts
        for p in new:
            score, n = self.solve(p)
            self.index[p] = len(self.counts)
            self.counts.append(n)
            self.scores.append(score)
            self.chars += len(p)
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

    def count(self, texts: pa.Array, most: int = 16_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and score of each text."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        n, score, first = np.zeros(len(texts), np.int64), np.zeros(len(texts)), 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
            n[first:last], score[first:last] = self._some(texts.slice(first, last - first))
            first = last
        return n, score

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        t = pc.replace_substring(texts, _CUT, "\ufffe")  # no piece has either, and both have three bytes
        t = pc.if_else(pc.equal(t, ""), "", pc.binary_join_element_wise(BLANK, t, ""))
        t = pc.replace_substring(t, " ", BLANK)
        t = pc.replace_substring_regex(t, f"([^{BLANK}\n])({BLANK})", rf"\1{_CUT}\2")
        t = pc.replace_substring(t, "\n", f"{_CUT}\n{_CUT}")
        lists = pc.split_pattern(t, _CUT)
        parts = lists.flatten().dictionary_encode()
        codes = self._codes(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        n = np.concatenate([[0], np.cumsum(np.array(self.counts, np.int64)[codes])])
        score = np.concatenate([[0.0], np.cumsum(np.array(self.scores)[codes])])
        return np.diff(n[edges]), np.diff(score[edges])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n, score = c.count(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
