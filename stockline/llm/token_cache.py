"""Encoding with a published tokenizer, an Arrow column of texts at a time.

Neither tokenizer joins anything across the step from a word to the blank or line break
after it, nor a letter to a single full stop or comma at a word's end. So a text is the
sequence of its pieces between those steps, and the ids of a piece are looked up: the
tokenizer itself sees each distinct piece once. Texts with other white space, white space in
runs, special tokens or letters that normalising ends in something else than a letter go to the
tokenizer whole. The table of pieces is bounded; when full,
the half used least goes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space other than blank and line break, and the start of special tokens.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
_RUN = r"|[ \n][ \n]"
_CUT = "\x1e"
# The letter that stands for each byte: its own where it shows, else the next from 256 on.
_SHOWS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWS))}
_LAST = r"(\pL)([.,])([ \n]|\z)"


def _unfit_letters(normalizer) -> str:
    """The letters that the tokenizer's own normalising turns into a letter and a mark, or the
    like: a stop after them does not stand after a letter."""
    if normalizer is None:
        return ""
    letters = [c for c in map(chr, range(128, 0x110000)) if category(c)[0] == "L"]
    after = normalizer.normalize_str("a".join(f"{c} " for c in letters)).split(" a")
    return "".join(c for c, now in zip(letters, after, strict=True) if not now.strip() or category(now.strip()[-1])[0] != "L")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str, words: bool = False) -> Encoder:
    """One per Python worker, so that its pieces serve all tasks the worker runs."""
    return Encoder(path, words)


class Encoder:
    def __init__(self, path: str, words: bool = False, most: int = 1_000_000, most_chars: int = 16_000_000):
        """words: the tokenizer drops white space and letter case, so pieces are plain words.
        most: pieces the table holds; beyond, the half used least goes."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words, self.most, self.most_chars = words, most, most_chars
        self.vocabulary = 1 + max(self.whole.get_vocab(with_added_tokens=True).values(), default=0)
        unfit = _unfit_letters(self.whole.normalizer)
        self.odd = (_ODD if words else _ODD + _RUN) + (f"|[{unfit}]" if unfit else "")
        self._set([], [], np.zeros(0, np.int64))

    def _set(self, pieces: list[str], ids: list[np.ndarray], uses: np.ndarray) -> None:
        self.index = {p: i for i, p in enumerate(pieces)}
        self.chars = sum(map(len, pieces))
        self.uses = uses
        self.flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        self.lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _make_room(self, wanted: int) -> None:
        if len(self.index) + wanted <= self.most and self.chars <= self.most_chars:
            return
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: min(self.most, len(self.index)) // 2])
        names = list(self.index)
        if self.chars > self.most_chars:
            kept = kept[np.fromiter((len(names[i]) <= 40 for i in kept), bool, len(kept))]
        ids = [self.flat[self.starts[i] : self.starts[i] + self.lengths[i]] for i in kept]
        self._set([names[i] for i in kept], ids, self.uses[kept] // 2)

    def _ids(self, piece: str) -> list[int]:
        """Ids of a piece, by the tokenizer's own steps; plain letters are one word to the model."""
        model = self.whole.model
        body = piece[1:] if piece[:1] == " " else piece
        if self.words and not body.isascii() and is_normalized("NFC", body):
            body = "".join(map(str.lower, body))
        if body.isalpha() and (body.isascii() or not self.words or is_normalized("NFC", body)):
            if not body.isascii():
                body = body.encode().decode("latin-1").translate(_SHOWN)
            return [t.id for t in model.tokenize("Ġ" + body if piece[0] == " " else body)]
        if self.whole.normalizer is not None:
            piece = self.whole.normalizer.normalize_str(piece)
        return [t.id for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(piece) for t in model.tokenize(word)]

    def _learn(self, pieces: list[str]) -> None:
        self._make_room(sum(p not in self.index for p in pieces))
        new = [p for p in pieces if p not in self.index]
        ids = list(map(self._ids, new))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        n = len(self.index)
        self.index.update(zip(new, range(n, n + len(new))))
        self.chars += sum(map(len, new))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Number of pieces of each text, the pieces as places in a list, and that list."""
        t = pc.ascii_lower(texts) if self.words else texts
        t = pc.replace_substring_regex(t, _LAST, rf"\1{_CUT}\2\3")
        for gap in (" ", "\n"):
            t = pc.replace_substring(t, gap, _CUT if self.words else _CUT + gap)
        lists = pc.split_pattern(t, _CUT)
        pieces = lists.flatten().dictionary_encode()
        return pc.list_value_length(lists).to_numpy(), pieces.indices.to_numpy(), pieces.dictionary.to_pylist()

    def _many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts, at, pieces = self._pieces(texts)
        get = self.index.get
        codes = [get(p) for p in pieces]
        if None in codes:
            self._learn(pieces)
            codes = list(map(self.index.__getitem__, pieces))
        codes = np.array(codes, np.int64)[at]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)]
        upto = np.concatenate([[0], ends])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[edges[1:]] - upto[edges[:-1]]

    def encode(self, texts: pa.Array, most: int = 16_000_000) -> Iterator[tuple[int, np.ndarray]]:
        """Yields (number of the text, its ids), in order; a null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            # As many texts as hold ``most`` bytes, at least one; only odd ones or none.
            last = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right"))
            last = max(last, first + 1)
            change = np.flatnonzero(odd[first:last] != odd[first])
            last = first + int(change[0]) if len(change) else last
            if odd[first]:
                for i in range(first, last):
                    yield i, np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                ids, lengths = self._many(texts.slice(first, last - first))
                yield from enumerate(np.split(ids, np.cumsum(lengths)[:-1]), first)
            first = last
