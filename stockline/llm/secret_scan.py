"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

Tokens are runs of word characters (letters, digits, ``+/_.-`` and all beyond ASCII) or of
other signs; a line is a sequence. Each token is tagged as secret begin, inside or outside
from its own shape, length, letters and digits, the words and shapes beside it, and features
of the file (its length, its shares of digits and signs). The field is fitted here, in numpy,
with the patterns' spans as labels, on windows from at most ``SAMPLE`` documents taken by a
hash of the id; it adds what looks like them without matching. Viterbi decodes the lines that
can hold a secret: where no token's scores can outweigh the transitions, staying outside is
the best path, and such lines need no decoding.

The patterns' spans always stay; tagged spans that touch one of them are not repeated. Spans
are in code points, end exclusive. Null and empty texts have no spans; repeated rows are
scanned one by one; without documents or labels nothing is tagged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bytewords import LOWER, mix, slices

SAMPLE = 20_000
WINDOW = 24
MOST_WINDOWS = 8_000
SLICE_BYTES = 1 << 20
KINDS = ("assign", "access", "hex", "crf")
# The patterns, and the lengths below which a match does not count.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_MAY_MATCH = rf"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{{{MIN_ACCESS - 4}}}|[0-9a-f]{{{MIN_HEX}}}"
_LONG_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")

O, B, I = 0, 1, 2
_U = np.uint64
_HASHED = 1 << 11
# Features of a token: word, shape, form (length, digits, cases), hex and length, changes.
_FORM, _HEXED, _CHANGES, _FILE = 160, 20, 8, 64
_OWN = np.cumsum([0, _HASHED, _HASHED, _FORM, _HEXED, _CHANGES])
_SIDE = 2 * _HASHED + _FORM
FEATURES = int(_OWN[-1]) + 2 * _SIDE + _FILE
COLUMNS = 12
_LENGTHS = np.array([2, 3, 4, 6, 9, 13, 17, 25, 41])


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind's place, kind, end, start of the secret itself) of the patterns' matches."""
    out = [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, "hex", m.end(), m.start()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def _byte_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_DIGIT, _UPPER, _LETTER = _byte_table(b"0123456789"), _byte_table(bytes(range(65, 91))), _byte_table(bytes(range(97, 123)))
_HEXDIGIT = _byte_table(b"0123456789abcdef")
_WORD = _DIGIT | _UPPER | _LETTER | _byte_table(b"+/_.-")
_WORD[128:] = True
_SPACE = _byte_table(bytes(range(33)))
_CLASS = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.uint8)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LETTER] = 97
_SHAPE[_UPPER] = 65
_SHAPE[_DIGIT] = 48
_SHAPE[128:] = 97


@dataclass
class Tokens:
    """Byte ranges, the text and the line of each token, and its features."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    features: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    kind = _CLASS[data]
    change = np.append(True, kind[1:] != kind[:-1]) if n else np.zeros(0, bool)
    change[offsets[:-1][offsets[:-1] < n]] = True
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], n)
    full = kind[begins] > 0 if n else np.zeros(0, bool)
    starts, ends = begins[full], ends[full]
    doc = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.append(0, np.cumsum(data == 10))
    line = doc + breaks[starts]  # each text starts a line too

    def upto(marks: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(marks))
        return total[ends] - total[starts]

    length = ends - starts
    digits, upper, lower, hexed = upto(_DIGIT[data]), upto(_UPPER[data]), upto(_LETTER[data]), upto(_HEXDIGIT[data])
    shape = _SHAPE[data]
    new = np.append(True, shape[1:] != shape[:-1]) if n else np.zeros(0, bool)
    new[starts] = True
    changes = upto(new)
    runs = np.append(0, np.cumsum(new))[:n]
    at = np.arange(n)
    owner = np.maximum(np.searchsorted(starts, at, "right") - 1, 0) if len(starts) else np.zeros(n, np.int64)
    within = np.minimum(runs - runs[starts][owner], 15) if len(starts) else runs
    total = np.append(_U(0), np.cumsum(mix(shape.astype(_U) * _U(16) + within.astype(_U)) * new))
    shapes = mix(total[ends] - total[starts]) % _U(_HASHED)
    place = np.minimum(at - starts[owner], 63) if len(starts) else at
    total = np.append(_U(0), np.cumsum(mix(LOWER[data].astype(_U) * _U(64) + place.astype(_U))))
    word = mix(total[ends] - total[starts]) % _U(_HASHED)
    size = np.searchsorted(_LENGTHS, length, "right")
    share = np.searchsorted([1e-9, 0.2, 0.5], digits / np.maximum(length, 1), "right")
    form = ((size * 4 + share) * 2 + (upper > 0)) * 2 + (lower > 0)
    own = [word.astype(np.int64), shapes.astype(np.int64), form, size * 2 + (hexed == length), np.minimum(changes, 7)]
    # Of the file: its length, and its shares of digits and of signs.
    docs = len(offsets) - 1
    per = lambda x: np.bincount(doc, x, docs) / np.maximum(np.diff(offsets), 1)
    signs = per(np.where(kind[starts] == 2, length, 0)) if n else np.zeros(docs)
    file = (np.searchsorted([300, 2000, 10000], np.diff(offsets)) * 4 + np.searchsorted([0.005, 0.03, 0.1], per(digits))) * 4 + np.searchsorted([0.02, 0.05, 0.15], signs)
    features = np.full((len(starts), COLUMNS), -1, np.int32)
    for k, f in enumerate(own):
        features[:, k] = f + _OWN[k]
    for k, (f, skip) in enumerate(zip(own[:3], (0, _HASHED, 2 * _HASHED))):
        near = line[1:] == line[:-1]
        features[1:, 5 + k] = np.where(near, f[:-1] + skip + _OWN[-1], -1)
        features[:-1, 8 + k] = np.where(near, f[1:] + skip + _OWN[-1] + _SIDE, -1)
    features[:, 11] = file[doc] + _OWN[-1] + 2 * _SIDE
    return Tokens(starts, ends, doc, line, features, offsets, data)


def _labels(t: Tokens, texts: list[str]) -> np.ndarray:
    """Tags of the tokens by the patterns."""
    tags = np.zeros(len(t.starts), np.int8)
    for d in np.flatnonzero([re.search(_MAY_MATCH, x) is not None for x in texts]):
        text = texts[d]
        for _, _, _, end, start in base_spans(text):
            a, b = (t.offsets[d] + len(text[:x].encode()) for x in (start, end))
            lo, hi = np.searchsorted(t.ends, a, "right"), np.searchsorted(t.starts, b)
            tags[lo:hi] = np.where(tags[lo:hi] == O, I, tags[lo:hi])
            if lo < hi and (lo == 0 or tags[lo - 1] == O or t.line[lo - 1] != t.line[lo]):
                tags[lo] = B
    return tags


class Field:
    """Weights of features and transitions for three tags."""

    def __init__(self, features: np.ndarray, tags: np.ndarray, mask: np.ndarray, rounds: int = 12, seed: int = 11):
        """features: window, place, column; tags and mask: window, place."""
        rng = np.random.default_rng(seed)
        self.w = np.zeros((FEATURES + 1, 3))  # the last row is for absent features
        self.t = np.zeros((3, 3))
        self.fitted = len(features) > 0 and bool((tags[mask] != O).any())
        if not self.fitted:
            return
        seen = np.zeros(self.w.shape)
        seen_t = np.zeros((3, 3))
        for _ in range(rounds):
            turn = rng.permutation(len(features))
            for a in range(0, len(turn), 128):
                k = turn[a : a + 128]
                # Features are hidden at random, so that no single one is needed.
                f = np.where(rng.random(features[k].shape) < 0.6, -1, features[k])
                gw, gt = self._gradient(f, tags[k], mask[k])
                gw[-1] = 0
                gw += 1e-5 * self.w
                seen += gw * gw
                seen_t += gt * gt
                self.w -= 0.2 * gw / (np.sqrt(seen) + 1e-6)
                self.t -= 0.2 * gt / (np.sqrt(seen_t) + 1e-6)
        self.w = self.w.astype(np.float32)

    def _allowed(self) -> np.ndarray:
        t = self.t.copy()
        t[O, I] = -1e4
        return t

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((*features.shape[:-1], 3), self.w.dtype)
        for c in range(features.shape[-1]):
            out += self.w[features[..., c]]
        return out

    def _gradient(self, f: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean negative log likelihood, by the forward and backward sums."""
        n, m = y.shape
        e, t = self.emissions(f), self._allowed()
        e[:, 0, I] = -1e4
        lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
        fore, back = np.zeros((n, m, 3)), np.zeros((n, m, 3))
        fore[:, 0] = e[:, 0]
        for k in range(1, m):
            step = lse(fore[:, k - 1, :, None] + t, 1) + e[:, k]
            fore[:, k] = np.where(mask[:, k, None], step, fore[:, k - 1])
        for k in range(m - 2, -1, -1):
            step = lse(t + (e[:, k + 1] + back[:, k + 1])[:, None, :], 2)
            back[:, k] = np.where(mask[:, k + 1, None], step, back[:, k + 1])
        whole = lse(fore[:, -1], 1)
        at = np.exp(fore + back - whole[:, None, None]) * mask[..., None]
        at[np.arange(n)[:, None], np.arange(m), y] -= mask
        gw = np.zeros_like(self.w)
        for c in range(COLUMNS):
            np.add.at(gw, f[..., c].reshape(-1), at.reshape(-1, 3))
        two = np.exp(fore[:, :-1, :, None] + t + (e[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * mask[:, 1:, None, None]
        gt = two.sum((0, 1))
        np.add.at(gt, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), -1)
        gt[O, I] = 0
        return gw / n, gt / n

    def decode(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tags; ``line`` numbers the sequences, in order."""
        tags = np.zeros(len(e), np.int8)
        if not self.fitted or not len(e):
            return tags
        t = self._allowed()
        gains = (t - t[O, O])[t > -1e3]
        most = max(float(gains.max()), 0.0)
        live = np.maximum(e[:, B], e[:, I]) - e[:, O] + most > -most
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        last = np.append(first[1:], len(line))
        hold = np.add.reduceat(live, first) > 0
        first, last = first[hold], last[hold]
        order = np.argsort(last - first)
        while len(order):
            # Lines of like lengths together, few enough for the memory.
            m = int((last - first)[order[-1]])
            take = order[-max(1, 200_000 // m) :]
            order = order[: -len(take)]
            self._viterbi(e, first[take], last[take], t, tags)
        return tags

    @staticmethod
    def _viterbi(e: np.ndarray, first: np.ndarray, last: np.ndarray, t: np.ndarray, tags: np.ndarray) -> None:
        m = int((last - first).max())
        best = e[first].astype(np.float64)
        best[:, I] = -1e4
        from_ = np.zeros((m, len(first), 3), np.int8)
        for k in range(1, m):
            on = first + k < last
            ways = best[on][:, :, None] + t
            from_[k][on] = ways.argmax(1)
            best[on] = ways.max(1) + e[first[on] + k]
        tag = best.argmax(1)
        for k in range(m - 1, -1, -1):
            on = np.flatnonzero(first + k < last)
            tags[first[on] + k] = tag[on]
            tag[on] = from_[k][on, tag[on]]


def fit(docs: DataFrame, most: int = SAMPLE) -> Field:
    """From windows around the patterns' spans, and as many others, of at most ``most`` documents."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select(docs["doc_id"].cast("long"), "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                part = batch.column(0).slice(a, b - a)
                t = tokens(part)
                tags = _labels(t, [x or "" for x in part.to_pylist()])
                spans = np.flatnonzero(tags == B)
                # As many windows elsewhere, and one in each 2,000 tokens at least.
                other = np.flatnonzero(mix(np.arange(len(tags)).astype(_U)) % _U(2000) == 0)
                rows = []
                for at, secret in [(x, True) for x in spans] + [(x, False) for x in other]:
                    lo = max(at - WINDOW // 2, int(np.searchsorted(t.line, t.line[at])))
                    hi = min(lo + WINDOW, int(np.searchsorted(t.line, t.line[at], "right")))
                    rows.append((t.features[lo:hi].tobytes(), tags[lo:hi].tobytes(), secret))
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["f", "y", "secret"])

    rows = sample.mapInArrow(run, "f binary, y binary, secret boolean")
    half = [rows.filter(F.col("secret") == s).orderBy(F.xxhash64("f"), "f", "y").limit(MOST_WINDOWS // 2) for s in (True, False)]
    got = half[0].unionByName(half[1]).toArrow()
    n = got.num_rows
    features, tags, mask = np.full((n, WINDOW, COLUMNS), -1, np.int32), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    for i, (f, y) in enumerate(zip(got["f"].to_pylist(), got["y"].to_pylist())):
        features[i, : len(y)] = np.frombuffer(f, np.int32).reshape(-1, COLUMNS)
        tags[i, : len(y)] = np.frombuffer(y, np.int8)
        mask[i, : len(y)] = True
    return Field(features, tags, mask)


def find(texts: pa.Array, field: Field) -> list[list[tuple[int, int, str, int]]]:
    """(start, kind's place, kind, end) of all spans of each text, sorted."""
    texts = pc.fill_null(texts, "")
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(texts))]
    for d in np.flatnonzero(pc.match_substring_regex(texts, _MAY_MATCH).to_numpy(zero_copy_only=False)):
        out[d] = [s[:4] for s in base_spans(texts[int(d)].as_py())]
    t = tokens(texts)
    tags = field.decode(field.emissions(t.features), t.line)
    begins = np.flatnonzero(tags == B)
    if len(begins):
        chars = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))
        inside = (tags == I) & np.append(False, t.line[1:] == t.line[:-1])
        stop = np.flatnonzero(np.append(~inside, True))
        for b in begins:
            e = stop[np.searchsorted(stop, b, "right")] - 1
            d = t.doc[b]
            origin = chars[t.offsets[d]]
            start, end = int(chars[t.starts[b]] - origin), int(chars[t.ends[e]] - origin)
            if not any(s < end and start < x for s, _, _, x in out[d]):
                out[d].append((start, 3, "crf", end))
                out[d].sort()
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and spans."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                found = find(batch.column(1).slice(a, b - a), sent.value)
                line = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
                base = [[s for s in spans if s[1] < 3] for spans in found]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        *[pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)],
                        pa.array([hashlib.sha256(line(spans).encode()).hexdigest() for spans in base]),
                        pa.array([line(spans) for spans in found]),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
