"""Packing: best-fit decreasing over token windows.

A document longer than a window is first cut into full windows; the rest of every document is one piece
shorter than a window. Pieces are placed in decreasing length, each into the open window with the least
remaining capacity that still holds it, found by a segment tree indexed by remaining capacity.

Pieces of one length are interchangeable, and so are open windows of equal remaining capacity. The placement is
therefore decided on the histogram of piece lengths (at most ``window`` rows, whatever the corpus size): the
driver moves runs of windows between capacities and gets a list of placements "pieces r0..r1 of length L go
to windows w0.., m to a window, from this offset". The list is bounded by ``window`` alone: every length
splits at most two runs, and a run takes at most about 90 different lengths before it is full. Spark ranks the
pieces of each length (``common.gapless_rank``) and each piece looks its place up.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, gapless_rank, stored
from .pieces import WordTable, look_up

WINDOW = 4096
END_ID = 2

#: Text that the word caches may assemble: after lower-casing (one to one here, and untouched by NFC) its
#: words are white-space separated, and the tokenizer's own split of a word is ``_PARTS``.
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÿ]")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Bytes of the texts of one slice (or one text); bounds memory, results do not depend on it.
SLICE_BYTES = 2 << 20
#: Kinds of bytes of lower-cased text: 0 white space, 1 letter, 2 digit, 3 other (letters of two bytes are told apart later).
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(9, 14)]] = 0
_KIND[0x61:0x7B], _KIND[0x30:0x3A] = 1, 2
_TOKENIZERS: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordIds:
    """Token ids (little-endian bytes) of a text, from the library's tokenizer.

    The tokenizer drops white space and never merges across it or across its split patterns, so the ids of a text
    are those of its words' parts in order. The words of a slice are cut and looked up as arrays in a table of bounded
    size (``pieces.WordTable``); the parts of an unknown word go to the tokenizer's BPE model. A text with other
    characters than those whose split is known here, or with a special token's opening, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.table = WordTable()

    def _part(self, part: str) -> list[int]:
        raw = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return [t.id for t in self.model.tokenize(raw)]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [[i for part in _PARTS.findall(w.decode()) for i in self._part(part)] for w in words]
        return np.array([i for ids in made for i in ids], np.int32), np.array(list(map(len, made)), np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    @staticmethod
    def _cut_parts(data: np.ndarray, first: np.ndarray) -> None:
        """Mark the parts of words without an apostrophe (whose parts depend on what follows) as words of their own."""
        at = np.flatnonzero(first)
        if not len(at):
            return
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        kind[lead] = kind[lead + 1] = np.where((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7), 3, 1)
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        size = np.diff(np.append(at, len(data)))
        whole = np.repeat(np.add.reduceat((data == 0x27).astype(np.int64), at) > 0, size)
        cut[at[0]:] &= ~whole
        first |= cut

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = [self.encode(t) if "<|" in t or _OTHER.search(t) else None for t in texts]
        plain = [t.lower().encode() for t, ids in zip(texts, out) if ids is None]
        data = np.frombuffer(b"\n".join([*plain, b""]), np.uint8)
        # white space leaves; a word begins where it stood before
        inside = (data != 0x20) & ((data < 9) | (data > 13))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        self._cut_parts(data, first)
        place = np.cumsum(inside)
        at = place[first] - 1
        joined = data[inside].tobytes()
        flat, count = look_up(self.table, joined, at, np.diff(np.append(at, len(joined))), self._learn) if len(at) else (
            np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.cumsum([len(t) + 1 for t in plain], dtype=np.int64)
        words = np.searchsorted(np.flatnonzero(first), np.concatenate([[0], ends]))
        upto = np.concatenate([[0], np.cumsum(count)])[words].tolist()
        found = (flat[a:b] for a, b in zip(upto, upto[1:]))
        return [next(found) if ids is None else ids for ids in out]


def word_ids(path: str) -> WordIds:
    """One tokenizer with its cache per Python worker and vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens.

    A null text counts as empty: its one piece is the end id. Repeated rows are packed as often as they occur.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(ids, texts):
        for d, own in zip(ids, word_ids(vocabulary).ids([t or "" for t in texts])):
            b = own.astype("<u4").tobytes() + end
            n = len(b) // 4
            for s in range(0, n, window):
                yield d, s, min(window, n - s), b[4 * s:4 * (s + window)], n

    return by_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], cut,
                   "doc_id long, start long, length long, ids binary, doc_tokens long", rows=1 << 20, most=SLICE_BYTES)


class CapacityTree:
    """Segment tree over remaining capacities 0..window; answers "least capacity >= x with an open window"."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.open = [False] * (2 * self.half)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.half + capacity
        self.open[i] = is_open
        while i > 1:
            i //= 2
            now = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == now:
                break
            self.open[i] = now

    def least(self, capacity: int) -> int | None:
        i = self.half + capacity
        if self.open[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:  # the right sibling holds the next capacities
                i += 1
                while i < self.half:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.half
            i //= 2
        return None


def best_fit(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """Best-fit decreasing on a histogram of lengths. Returns placements
    (length, first rank, pieces, pieces per window, first window, offset) and the number of windows."""
    tree, at = CapacityTree(window), defaultdict(list)
    made, windows = [], 0

    def put(capacity, first, n):
        if n:
            at[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        n, r = counts[length], 0
        while r < n:
            c = tree.least(length)
            if c is None:
                c, first, k = window, windows, -(-(n - r) // (window // length))
                windows += k
            else:
                first, k = at[c].pop()
                if not at[c]:
                    tree.set(c, False)
            m = c // length  # a window filled once stays the tightest one until no further piece fits
            full = min(k, (n - r) // m)
            if full:
                made.append((length, r, full * m, m, first, window - c))
                put(c - full and c - m * length, first, full)
                r += full * m
            if full < k:
                rest = n - r
                if rest:
                    made.append((length, r, rest, rest, first + full, window - c))
                    put(c - rest * length, first + full, 1)
                    r, full = n, full + 1
                put(c, first + full, k - full)
    return made, windows


def pack(piece: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns doc_id, start, length and any others; read
    three times, so pass a stored table). Sequences hold at most ``window`` tokens, without gaps. Empty in, empty out."""
    hist = {r["length"]: r["n"] for r in piece.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made, windows = best_fit({k: n for k, n in hist.items() if k < window}, window)
    if window in hist:
        made.append((window, 0, hist[window], 1, windows, 0))
    look: dict[int, tuple[list, list]] = {}
    for length, r, _, m, first, offset in sorted(made):
        firsts, rest = look.setdefault(length, ([], []))
        firsts.append(r)
        rest.append((m, first, offset))
    ranked = gapless_rank(piece, ["length"], ["doc_id", "start", "doc_tokens"], "__rank")
    n_at, r_at = ranked.columns.index("length"), ranked.columns.index("__rank")
    out = [f for f in ranked.schema.fields if f.name != "__rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"

    def place(batches):
        for b in batches:
            seq, off = [], []
            for length, r in zip(b.column(n_at).to_pylist(), b.column(r_at).to_pylist()):
                firsts, rest = look[length]
                i = bisect_right(firsts, r) - 1
                m, first, offset = rest[i]
                k, j = divmod(r - firsts[i], m)
                seq.append(first + k)
                off.append(offset + j * length)
            kept = [c for i, c in enumerate(b.columns) if i != r_at]
            names = [n for i, n in enumerate(b.schema.names) if i != r_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (concatenated bytes), n_tokens. ``packed`` has ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
            .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
                    "n_tokens"))


def digest(piece: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return piece.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece with its ids' checksum.

    Only the light piece table is stored and shuffled; ``sequences(pack(stored(pieces(...))))`` gives the ids.
    """
    return pack(stored(digest(pieces(docs, vocabulary, window, end_id))), window)
