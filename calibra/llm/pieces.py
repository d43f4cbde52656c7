"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text becomes symbols as the library's identity normaliser makes them: a space is written U+2581, one more is put
in front, every character is a symbol. The library then merges the adjacent pair whose joined piece has the highest
score, the leftmost of equals, until no pair joins to a piece; a character without a piece becomes its UTF-8 bytes.

Here all words that a slice of texts needs are merged together in flat numpy arrays. In every round each word finds
its least pair rank (a segmented minimum), all its pairs of that rank merge at once from the left, the arrays are
compacted and words without a pair leave. A merge may make a pair that must precede the remaining pairs of the
round (its rank is no worse); the round of that word then ends with this merge, so the order is the library's.

Words are cut where no piece reaches across: runs of Latin letters, single digits and runs of other characters, each with the
U+2581 before it, as far as the vocabulary allows (``CUTS``; every piece must be one word), and within a word between
characters that no piece holds side by side.
Words of more than ``LONG`` symbols would need a round for each rank they hold; these few are merged through a heap,
in the same order with the same result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Symbols of a word above which it is merged through a heap.
LONG = 4096
#: Splits of a text into words, the finest first; the last one cuts nothing. Whether a place is cut depends on the two
#: characters beside it alone, so a split that leaves every piece whole never cuts where a merge could join.
_LATIN = r"A-Za-z\xc0-ȿ"
CUTS = [f"{SPACE}*(?:[{_LATIN}]+|[0-9]|[^{_LATIN}0-9{SPACE}]+)|{SPACE}+", f"{SPACE}*[^{SPACE}]+|{SPACE}+", "(?s:.+)"]
#: Words a worker keeps encoded (about 80 bytes each), and the longest of them in bytes; longer ones are merged anew.
KEPT_WORDS, KEPT_BYTES = 1 << 19, 64
#: Texts of one slice: new words of a slice are merged together.
SLICE_BYTES = 2 << 20
_NONE = np.int64(1) << 40  # the rank of a pair that joins to no piece
_MODELS: dict[str, PieceModel] = {}


def _varint(b: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        v |= (b[at] & 0x7F) << shift
        at += 1
        if b[at - 1] < 128:
            return v, at
        shift += 7


def _fields(b: bytes) -> list[tuple[int, object]]:
    """(number, value) of the fields of one serialised message."""
    out, at = [], 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            v, at = _varint(b, at)
        else:
            n, at = _varint(b, at) if kind == 2 else (8 if kind == 1 else 4, at)
            v, at = b[at:at + n], at + n
        out.append((tag >> 3, v))
    return out


class PieceModel:
    """Vocabulary, pair ranks and merge rounds of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = _fields(f.read())
        # fixed values: field numbers of the public model format
        pieces = [dict(_fields(v)) for n, v in raw if n == 1]
        trainer = dict(next((_fields(v) for n, v in raw if n == 2), []))
        norm = dict(next((_fields(v) for n, v in raw if n == 3), []))
        kinds = [p.get(3, 1) for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) \
                or not norm.get(5, 1) or trainer.get(24, 0) or set(kinds) - {1, 2, 3, 6}:
            raise ValueError("needs a BPE model with byte fallback, identity normaliser, dummy prefix and plain pieces")
        self.size = len(pieces)
        names = [p[1].decode() for p in pieces]
        score = np.array([np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0] for p in pieces])
        self.byte = np.zeros(256, np.int64)
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte[int(names[i][3:5], 16)] = i
        ids = {names[i]: i for i, k in enumerate(kinds) if k == 1}
        self.level = next(k for k, c in enumerate(CUTS) if all(len(re.findall(c, w)) == 1 for w in ids))
        plain = list(ids.values())
        rank = dict(zip(plain, np.unique(-score[plain], return_inverse=True)[1].tolist()))
        symbols = dict(ids)
        for w in ids:
            for c in w:  # a character that is no piece itself can still be merged
                symbols.setdefault(c, self.size + len(symbols))
        self.width = self.size + len(symbols) + 1
        self.char = np.full(0x110000, -1, np.int32)
        for w, i in symbols.items():
            if len(w) == 1:
                self.char[ord(w)] = i
        pairs = {}
        beside = set()
        for w, i in ids.items():
            for k in range(1, len(w)):
                beside.add(symbols[w[k - 1]] * self.width + symbols[w[k]])
                a, b = symbols.get(w[:k]), symbols.get(w[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (rank[i], i)
        self._tabulate(pairs)
        self.beside = np.append(np.array(sorted(beside), np.int64), np.iinfo(np.int64).max)
        # classes of UTF-8 bytes: 0 space, 1 Latin letter (leads of U+00C0 to U+023F too), 2 digit, 3 other, 4 within
        self.kind = np.full(256, 3, np.uint8)
        self.kind[0x20] = 0
        self.kind[0x80:0xC0] = 4
        if self.level == 0:
            self.kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xC9)]] = 1
            self.kind[0x30:0x3A] = 2
        self.words = WordTable()

    def _tabulate(self, pairs: dict[int, tuple[int, int]]) -> None:
        """Pairs in an open-addressing table of numpy arrays: at most one slot in eight is taken."""
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array(list(pairs), np.int64)
        self.keys = np.full((1 << bits) + 64, -2, np.int64)
        self.rank = np.full(len(self.keys), _NONE)
        self.made = np.full(len(self.keys), -1)
        for key, at in zip(keys.tolist(), self._slots(keys).tolist()):
            while self.keys[at] != -2:
                at = at + 1 if at + 1 < len(self.keys) else 0
            self.keys[at], (self.rank[at], self.made[at]) = key, pairs[key]

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of the pairs a, b; characters outside the vocabulary are negative and join nothing."""
        key = np.where((a < 0) | (b < 0), np.int64(-1), a * self.width + b)
        at = self._slots(key)
        found = self.keys[at]
        wrong = np.flatnonzero((found != key) & (found != -2))
        while len(wrong):  # the slot is another pair's: go on to the next
            at[wrong] = np.where(at[wrong] + 1 < len(self.keys), at[wrong] + 1, 0)
            found = self.keys[at[wrong]]
            wrong = wrong[(found != key[wrong]) & (found != -2)]
        return self.rank[at], self.made[at]  # an empty slot holds "none"

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words in one array, and each word's first position (with the end)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        char = self.char[points].astype(np.int64)
        sym = np.where(char < 0, -1 - points, char)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        # segments: words, cut further where no piece holds both characters
        key = np.where((sym[:-1] < 0) | (sym[1:] < 0), np.int64(-1), sym[:-1] * self.width + sym[1:])
        apart = (owner[:-1] != owner[1:]) | (self.beside[np.searchsorted(self.beside, key)] != key)
        seg = np.concatenate([[0], np.cumsum(apart)]) if len(sym) else np.zeros(0, np.int64)
        out_sym, out_seg = [], []
        owner_of = owner[np.flatnonzero(np.diff(seg, prepend=-1))] if len(sym) else owner
        sizes = np.bincount(seg) if len(sym) else np.zeros(0, np.int64)
        for s in np.flatnonzero(sizes > LONG):
            a = int(np.searchsorted(seg, s))
            done = self._heap(sym[a:a + sizes[s]])
            out_sym.append(done)
            out_seg.append(np.full(len(done), s))
        if (sizes > LONG).any():
            keep = sizes[seg] <= LONG
            sym, seg = sym[keep], seg[keep]
        rank, made = self.pairs(sym, seg)
        while len(sym):
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(seg)))
            mine = np.repeat(least, sizes)
            over = mine == _NONE
            if over.any():
                out_sym.append(sym[over])
                out_seg.append(seg[over])
                sym, seg, rank, made, mine = sym[~over], seg[~over], rank[~over], made[~over], mine[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == mine)
            # overlapping pairs: of a run of neighbours the first, third, ... merge
            new_run = np.diff(at, prepend=-9) != 1
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            piece, r, s = made[at], rank[at], seg[at]
            # a pair made by a merge that is due before the remaining ones ends the round of its word
            has_left = (at > 0) & (seg[at - 1] == s)
            left = sym[at - 1]
            touching = np.diff(at, prepend=-9) == 2
            left = np.where(touching, np.roll(piece, 1), left)
            to_right = np.minimum(at + 2, len(sym) - 1)
            has_right = (at + 2 < len(sym)) & (seg[to_right] == s)
            due = (has_left & (self.joined(left, piece)[0] <= r)) | (
                has_right & (self.joined(piece, sym[to_right])[0] <= r))
            if due.any():
                before = np.cumsum(due) - due
                word_first = np.maximum.accumulate(np.where(np.diff(s, prepend=-1) != 0, np.arange(len(at)), 0))
                go = before == before[word_first]
                at, piece = at[go], piece[go]
            sym[at] = piece
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
            here = place[at]
            self._renew(sym, seg, rank, made, np.concatenate([here, np.maximum(here - 1, 0)]))
        if not out_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, seg = np.concatenate(out_sym), np.concatenate(out_seg)
        order = np.argsort(seg, kind="stable")
        count = np.bincount(owner_of[seg], minlength=len(words))
        return sym[order], np.concatenate([[0], np.cumsum(count)])

    def pairs(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1)
        if len(sym) > 1:
            r, m = self.joined(sym[:-1], sym[1:])
            same = seg[:-1] == seg[1:]
            rank[:-1], made[:-1] = np.where(same, r, _NONE), np.where(same, m, -1)
        return rank, made

    def _renew(self, sym, seg, rank, made, at):
        nxt = np.minimum(at + 1, len(sym) - 1)
        r, m = self.joined(sym[at], sym[nxt])
        same = (at + 1 < len(sym)) & (seg[at] == seg[nxt])
        rank[at], made[at] = np.where(same, r, _NONE), np.where(same, m, -1)

    def _heap(self, symbols: np.ndarray) -> np.ndarray:
        """One very long word: the same merges in the same order from a heap of (rank, position)."""
        rank, made = self.pairs(symbols, np.zeros(len(symbols), np.int64))
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.flatnonzero(rank < _NONE)
        heap = list(zip(rank[at].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), made[at].tolist()))
        heapq.heapify(heap)
        gone = bytearray(n)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i, j):
            if i < 0 or j >= n:
                return
            pair = sym[i], sym[j]
            if pair not in known:
                r, m = self.joined(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(m[0])
            r, m = known[pair]
            if m >= 0:
                heapq.heappush(heap, (r, i, *pair, m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = m, 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([s for s, g in zip(sym, gone) if not g], np.int64)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's number of ids."""
        sym, ends = self.merge(words)
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        width = np.ones(len(sym), np.int64)
        if len(odd):  # characters without a piece: their UTF-8 bytes
            point = np.zeros(self.width, np.int64)
            known = np.flatnonzero(self.char >= 0)
            point[self.char[known]] = known
            points = np.where(sym[odd] < 0, -1 - sym[odd], point[np.minimum(sym[odd], self.width - 1)])
            spelt = [self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in points.tolist()]
            width[odd] = list(map(len, spelt))
        place = np.concatenate([[0], np.cumsum(width)])
        ids = np.empty(place[-1], np.int32)
        ids[place[:-1]] = np.where((sym < 0) | (sym >= self.size), 0, sym)
        for at, more in zip(place[odd].tolist(), spelt if len(odd) else ()):
            ids[at:at + len(more)] = more
        return ids, np.diff(place[ends])

    def starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """First bytes of all words of the texts that begin at ``texts`` in ``data`` (by ``CUTS[level]``)."""
        kind = self.kind[data]
        within = np.flatnonzero(kind == 4)
        for _ in range(3):  # bytes within a character are of its first byte's kind
            kind[within] = kind[within - 1]
            within = within[kind[within] == 4]
        first = np.zeros(len(data), bool)
        if self.level < 2:
            space = kind == 0
            lead = (data < 0x80) | (data >= 0xC0)
            first[1:] = np.where(space[1:], ~space[:-1],
                                 ~space[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & lead[1:])
        first[texts] = True
        return np.flatnonzero(first)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), without begin or end ids."""
        space = SPACE.encode()
        texts = [b" " + (t.replace(space, b" ") if space in t else t) if t else b"" for t in texts]
        joined = b"".join(texts)
        if not joined:
            return [np.zeros(0, np.int32) for _ in texts]
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        filled = np.diff(ends, prepend=0) > 0
        at = self.starts(data, (np.diff(ends, prepend=0) * -1 + ends)[filled])
        size = np.diff(np.append(at, len(data)))
        flat, count = look_up(self.words, joined, at, size, lambda words: self.word_ids(
            [w.decode("utf-8", "surrogatepass").replace(" ", SPACE) for w in words]))
        stop = np.cumsum(count)
        upto = np.concatenate([[0], stop])[np.searchsorted(at, np.concatenate([[0], ends]))]
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


def look_up(table: WordTable, joined: bytes, at: np.ndarray, size: np.ndarray,
            learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of ``joined`` (adjoining, beginning at ``at``) in one array, and each word's number of ids. Words
    that the table does not hold go to ``learn`` together, short ones once each, and are kept."""
    data = np.frombuffer(joined, np.uint8)
    table.trim()
    one, two = table.hashes(data, at, size)
    slot = np.where(size <= KEPT_BYTES, table.find(one, two), -1)
    begin, count = table.begin[slot], table.count[slot]
    table.used[slot[slot >= 0]] = True
    new = np.flatnonzero(slot < 0)
    extra = np.zeros(0, np.int32)
    if len(new):
        short = size[new] <= KEPT_BYTES
        key = np.where(short, one[new], np.arange(len(new), dtype=np.uint64))
        _, at_first, where = np.unique(key, return_index=True, return_inverse=True)
        if (short & (two[new] != two[new[at_first[where]]])).any():  # the first hash is shared: take both
            _, at_first, where = np.unique(np.stack([key, np.where(short, two[new], 0)], 1), axis=0,
                                           return_index=True, return_inverse=True)
        some = new[at_first]
        extra, n = learn([joined[a:a + k] for a, k in zip(at[some].tolist(), size[some].tolist())])
        base = np.cumsum(n) - n
        where = where.reshape(-1)
        begin[new], count[new] = base[where] + len(table.ids), n[where]
    held = np.concatenate([table.ids, extra]) if len(extra) else table.ids
    stop = np.cumsum(count)
    flat = held[np.arange(stop[-1]) + np.repeat(begin - (stop - count), count)]
    if len(new):
        keep = np.flatnonzero(size[some] <= KEPT_BYTES)
        table.add(one[some[keep]], two[some[keep]], base[keep], n[keep], extra)
    return flat, count


class WordTable:
    """Ids of words by two 64-bit hashes of their bytes: an open-addressing table of numpy arrays of bounded size.

    When ``KEPT_WORDS`` are held, the words not used since the last trim go (all, if that is under half)."""

    def __init__(self):
        rng = np.random.default_rng(64)
        self.of_byte = rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.of_place = rng.integers(1, 1 << 63, (2, KEPT_BYTES), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.bits = (2 * KEPT_WORDS).bit_length() - 1
        self.clear()

    def clear(self):
        slots = (1 << self.bits) + 64
        self.one, self.two = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.begin, self.count = np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
        self.used = np.zeros(slots, bool)
        self.ids, self.n = np.zeros(0, np.int32), 0

    def hashes(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        place = np.minimum(np.arange(len(data)) - np.repeat(at, size), KEPT_BYTES - 1)
        return [np.add.reduceat(b[data] * p[place], at) for b, p in zip(self.of_byte, self.of_place)]

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 where it is not held."""
        at = (one >> np.uint64(64 - self.bits)).view(np.int64)
        open_ = np.arange(len(at))
        while len(open_):  # another word's slot: go on to the next
            a = at[open_]
            taken = self.count[a] >= 0
            wrong = taken & ((self.one[a] != one[open_]) | (self.two[a] != two[open_]))
            at[open_[~taken]] = -1
            open_ = open_[wrong]
            at[open_] = (at[open_] + 1) % len(self.count)
        return at

    def add(self, one, two, begin, count, ids):
        """Put in words that are not held; ``begin`` counts in ``ids``. A slice with too many new words is not kept."""
        if 2 * (self.n + len(one)) > 3 * KEPT_WORDS:
            self.n = max(self.n, KEPT_WORDS)  # the next trim makes room
            return
        at = (one >> np.uint64(64 - self.bits)).view(np.int64)
        begin = begin + len(self.ids)
        open_ = np.arange(len(at))
        while len(open_):  # the last of several words at a free slot gets it, the others go on
            a = at[open_]
            free = self.count[a] < 0
            claim = open_[free]
            self.begin[at[claim]] = claim
            won = claim[self.begin[at[claim]] == claim]
            w = at[won]
            self.one[w], self.two[w], self.begin[w], self.count[w] = one[won], two[won], begin[won], count[won]
            left = np.ones(len(one), bool)
            left[won] = False
            open_ = open_[left[open_]]
            at[open_] = (at[open_] + 1) % len(self.count)
        self.ids = np.concatenate([self.ids, ids])
        self.n += len(one)

    def trim(self):
        if self.n < KEPT_WORDS:
            return
        keep = np.flatnonzero(self.used & (self.count >= 0))
        one, two, begin, count, ids = self.one[keep], self.two[keep], self.begin[keep], self.count[keep], self.ids
        self.clear()
        if len(keep) <= KEPT_WORDS // 2:
            stop = np.cumsum(count)
            mine = ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - count), count)]
            self.add(one, two, stop - count, count, mine)


def model(path: str) -> PieceModel:
    """The worker's copy of the model at ``path`` (the file has the same path on every executor)."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def decode(ids: list[list[int]], path: str) -> list[str]:
    """Texts of ids, by the library's own decoder."""
    import sentencepiece

    key = f"decoder:{path}"
    if key not in _MODELS:
        _MODELS[key] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [_MODELS[key].decode(i) for i in ids]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (string): one row per input row, whole texts.

    A null text counts as empty (no ids, empty decoded text). Null ids, repeated rows and equal texts are rows like
    any other; other columns of ``docs`` are not read. There are no ties: the result depends on the text alone. An
    empty table gives an empty one. A worker holds one slice of texts (``SLICE_BYTES`` or one text) and a word cache
    of bounded bytes; very long texts and words only lengthen their own slice.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        m = model(path)
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            ends, a = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)), 0
            while a < batch.num_rows:
                base = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
                ids = m.encode([t or b"" for t in column.slice(a, b - a).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    pa.array(decode([i.tolist() for i in ids], path), pa.string())], schema=schema)
                a = b

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string")

