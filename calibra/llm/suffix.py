"""Suffix-array dedup by deep-shallow sorting: remove every byte covered by a 200-byte string that starts twice.

A string occurs twice exactly if its two suffixes share a prefix of that length, so equal neighbours in suffix
order find all of them. Sorting every suffix of the corpus would shuffle it many times over; instead suffixes are
taken at anchors. Each 200-byte window chooses, by its content alone, the 64-byte gram with the least hash in it
(the leftmost of equal ones): equal windows choose the same anchor at the same offset, and about one position in 70
is an anchor. Windows are then compared through their anchors:

1. anchors of all texts, and those whose gram hash occurs at two places (partial counts, then a join AQE may split);
2. texts rejoin their repeated anchors and yield one segment per anchor: the bytes of the windows that chose it;
3. within a gram, the suffixes from the anchor rightwards and, reversed, leftwards are sorted *deep-shallow*:
   multikey quicksort on 8-byte keys to a shallow depth, blind tries (Patricia tries that look at branching bytes
   only and compare once at a leaf) for what still shares a long prefix. Neighbours' common prefixes give, for
   every split of a window into ``a`` bytes before the anchor and the rest from it, classes of equal left and right
   parts; a window occurs twice if its pair of classes does;
4. marked windows become byte intervals per text, which rejoin the text once more.

All comparisons are of bytes; hashes only bring candidates together. Exact copies of a text of at least 200 bytes
are removed whole (each of their windows starts in the copy too) and stand for one text in the other steps. A gram
with more than ``GROUP`` segments is not gathered in one task: its windows are counted by their 128-bit hashes in
partial aggregates instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 200
GRAM = 64
#: Bytes beyond the common start that multikey quicksort looks at before blind tries take over.
SHALLOW = 32
#: Segments of one gram up to which they are sorted in one task (about 300 bytes each).
GROUP = 50_000
_BLOCK = 1 << 19  # window starts hashed at once: bounded memory for very long texts
_POS = 20  # bits of an anchor's position within a block


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, one table per worker."""

    table: tuple[np.ndarray, np.ndarray] | None = None
    base = 0x9E3779B97F4A7C15

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.table is None:
            n = _BLOCK + 2048
            up, down = np.full(n, cls.base, np.uint64), np.full(n, pow(cls.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.table = np.cumprod(up), np.cumprod(down)
        return cls.table


def _mixed(g: np.ndarray) -> np.ndarray:
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by running minima from both ends of blocks of ``w``."""
    n = len(v)
    pad = -n % w
    p = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    front = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], front[w - 1:n])


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the anchors of a text's bytes. A place packs the first window start that chose the
    anchor, the anchor's offset from it and the number of windows: ``first << 16 | offset << 8 | windows``."""
    hashes, places = [], []
    up, down = _Powers.get()
    mask = np.uint64((1 << _POS) - 1)
    for at in range(0, len(text) - length + 1, _BLOCK):
        x = text[at:at + _BLOCK + length - 1]
        n = len(x)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        g = _mixed((total[gram:] - total[:-gram]) * down[:n - gram + 1])
        best = _least((g & ~mask) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & mask
        first = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1])
        windows = np.diff(np.append(first, len(best)))
        p = best[first].astype(np.int64)
        hashes.append(g[p].view(np.int64))
        places.append((first + at << 16) | (p - first << 8) | windows)
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def _buffers(column) -> Iterator[np.ndarray]:
    """The byte arrays of a binary Arrow column (null: empty)."""
    for v in column:
        b = v.as_buffer()
        yield np.frombuffer(b, np.uint8) if b is not None else np.empty(0, np.uint8)


def _batch(columns: list, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


def _find_anchors(length, gram):
    kinds = {"h": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "place": pa.int64()}

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            made: list[tuple] = []
            size = 0
            for i, x in enumerate(_buffers(b.column(2))):
                if len(x) >= length:
                    h, p = anchors(x, length, gram)
                    made.append((h, np.full(len(h), k1[i]), np.full(len(h), k2[i]), p))
                    size += len(h)
                if size > 100_000:
                    yield _batch([np.concatenate(c) for c in zip(*made)], kinds)
                    made, size = [], 0
            if made:
                yield _batch([np.concatenate(c) for c in zip(*made)], kinds)

    return run


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


class _Branch:
    """Inner node of a blind trie: strings below agree on all bytes before ``depth`` and differ in that one."""

    __slots__ = ("depth", "kids")

    def __init__(self, depth, kids):
        self.depth, self.kids = depth, kids


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two different strings of one length that agree before ``at``."""
    low, high = at, len(a)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low:high] != b[low:high] else high


def blind_sort(strings: list[bytes], at: int) -> list[bytes]:
    """Sort distinct strings of one length that agree before ``at``, by a blind trie."""
    root: _Branch | bytes = strings[0]
    for s in strings[1:]:
        node = root
        while isinstance(node, _Branch):  # blind: only branching bytes are looked at
            node = node.kids.get(s[node.depth]) or next(iter(node.kids.values()))
        k = _common(s, node, at)
        above, below = None, root
        while isinstance(below, _Branch) and below.depth < k:
            above, below = below, below.kids[s[below.depth]]
        if isinstance(below, _Branch) and below.depth == k:
            below.kids[s[k]] = s
            continue
        new = _Branch(k, {node[k]: below, s[k]: s})
        if above is None:
            root = new
        else:
            above.kids[s[above.depth]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack.extend(node.kids[c] for c in sorted(node.kids, reverse=True))
        else:
            out.append(node)
    return out


def deep_shallow(strings: list[bytes], at: int, shallow: int = SHALLOW) -> list[bytes]:
    """Sort distinct strings of one length that agree before ``at``: multikey quicksort by 8-byte keys for
    ``shallow`` bytes, then blind tries."""
    out: list[bytes] = []
    stack = [(strings, at)]
    while stack:
        some, d = stack.pop()
        if len(some) == 1:
            out.append(some[0])
        elif d >= at + shallow:
            out.extend(blind_sort(some, d))
        else:
            pivot = some[len(some) // 2][d:d + 8]
            less, same, more = [], [], []
            for s in some:
                key = s[d:d + 8]
                (same if key == pivot else less if key < pivot else more).append(s)
            stack.extend((x, e) for x, e in ((more, d), (same, d + 8), (less, d)) if x)
    return out


def _order(strings: list[bytes], groups: np.ndarray, width: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffix order within each group, and the prefix each entry shares with the one before it (-1
    at a group's start). Equal strings are sorted once."""
    order: list[int] = []
    for x, y in zip(groups[:-1].tolist(), groups[1:].tolist()):
        where: dict[bytes, list[int]] = {}
        for i in range(x, y):
            where.setdefault(strings[i], []).append(i)
        # a colliding hash may bring different grams together: then sort from the start
        keys = list(where)
        start = at if len({s[:at] for s in keys}) == 1 else 0
        for s in deep_shallow(keys, start) if len(keys) > 1 else keys:
            order.extend(where[s])
    o = np.array(order)
    m = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
    common = np.full(len(o), width, np.int64)
    for at_ in range(1, len(o), 8192):
        e = min(at_ + 8192, len(o))
        differ = m[o[at_:e]] != m[o[at_ - 1:e - 1]]
        common[at_:e] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[groups[:-1]] = -1
    return o, common


def repeated(segments: list[bytes], offsets: np.ndarray, windows: np.ndarray, groups: np.ndarray,
             length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For segments sorted by gram (``groups``: starts of the groups, and the end), the matrix of windows that
    another segment of the same gram holds too."""
    n, reach = len(segments), length - gram
    right = [s[o:o + length].ljust(length, b"\0") for s, o in zip(segments, offsets.tolist())]
    left = [s[:o][::-1].ljust(reach, b"\0") for s, o in zip(segments, offsets.tolist())]
    ro, rc = _order(right, groups, length, gram)
    lo, lc = _order(left, groups, reach, 0)
    marked = np.zeros((n, reach + 1), bool)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(reach + 1):
        here = np.flatnonzero((offsets >= a) & (offsets - a < windows))
        if len(here) < 2:
            continue
        rank_r[ro] = np.cumsum(rc < length - a)
        rank_l[lo] = np.cumsum(lc < a)
        key = rank_r[here] * (n + 1) + rank_l[here]
        by = np.argsort(key, kind="stable")
        k = key[by]
        same = k[1:] == k[:-1]
        twin = np.zeros(len(here), bool)
        twin[by[1:][same]] = twin[by[:-1][same]] = True
        hit = here[twin]
        marked[hit, offsets[hit] - a] = True
    return marked


def _intervals(marked: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the byte intervals that runs of marked windows cover."""
    edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, s = np.nonzero(edge == 1)
    _, e = np.nonzero(edge == -1)
    return row, first[row] + s, first[row] + e - 1 + length


_SEGMENT = {"h": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "place": pa.int64(), "seg": pa.binary()}


def _cut_segments(length):
    """k1, k2, text, list of (h, place) -> one row per anchor with the bytes of its windows."""

    def run(batches):
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            rows: list[tuple] = []
            for i, text in enumerate(b.column(2)):
                x = text.as_buffer()
                for a in b.column(3)[i].as_py():
                    first, windows = a["place"] >> 16, a["place"] & 255
                    rows.append((a["h"], k1[i], k2[i], a["place"], x[first:first + windows + length - 1].to_pybytes()))
                if len(rows) >= 8192:
                    yield _batch(list(zip(*rows)), _SEGMENT)
                    rows = []
            if rows:
                yield _batch(list(zip(*rows)), _SEGMENT)

    return run


_MARK = {"k1": pa.int64(), "k2": pa.int64(), "a": pa.int64(), "b": pa.int64()}


def _mark_groups(length, gram, rows=30_000):
    """Segments sorted by gram hash -> byte intervals. Whole groups are gathered up to about ``rows`` segments."""

    def solve(parts):
        h, k1, k2, place = (np.concatenate(c) for c in list(zip(*parts))[:4])
        segs = [s for p in parts for s in p[4]]
        order = np.lexsort((place, k2, k1, h))  # repeated input rows bring the same anchor twice
        o = order[np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(k1[order]) != 0)
                                  | (np.diff(k2[order]) != 0) | (np.diff(place[order]) != 0)])]
        h, k1, k2, place, segs = h[o], k1[o], k2[o], place[o], [segs[i] for i in o]
        groups = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
        big = np.diff(groups) > 1
        keep = np.repeat(big, np.diff(groups))
        if not keep.any():
            return None
        groups = np.concatenate([[0], np.cumsum(np.diff(groups)[big])])
        k1, k2, place = k1[keep], k2[keep], place[keep]
        marked = repeated([s for s, k in zip(segs, keep.tolist()) if k], place >> 8 & 255, place & 255, groups, length, gram)
        row, a, e = _intervals(marked, place >> 16, length)
        return _batch([k1[row], k2[row], a, e], _MARK) if len(row) else None

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            h, k1, k2, place = (b.column(i).to_numpy() for i in range(4))
            segs = b.column(4).to_pylist()
            if not len(h):
                continue
            if size >= rows:  # close before the batch's last group, which may go on
                new = np.flatnonzero(h != held[-1][0][-1])
                if len(new):
                    c = int(new[0])
                    held.append((h[:c], k1[:c], k2[:c], place[:c], segs[:c]))
                    if (got := solve(held)) is not None:
                        yield got
                    held, size = [], 0
                    h, k1, k2, place, segs = h[c:], k1[c:], k2[c:], place[c:], segs[c:]
            held.append((h, k1, k2, place, segs))
            size += len(h)
        if held and (got := solve(held)) is not None:
            yield got

    return run


_WINDOW = {"d1": pa.int64(), "d2": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "s": pa.int64()}


def _windows(length):
    """Segments -> one row per window with its 128-bit hash (only for grams of more than ``GROUP`` segments)."""

    def run(batches):
        for b in batches:
            h, k1, k2, place = (b.column(i).to_numpy() for i in range(4))
            for i, s in enumerate(b.column(4).to_pylist()):
                first, n = int(place[i]) >> 16, int(place[i]) & 255
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s[j:j + length]) for j in range(n)), ">i8")
                d = d.astype(np.int64).reshape(-1, 2)
                yield _batch([d[:, 0], d[:, 1], np.full(n, k1[i]), np.full(n, k2[i]), np.arange(first, first + n)], _WINDOW)

    return run


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{k} {'binary' if t == pa.binary() else 'long'}" for k, t in kinds.items())


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k1, k2, a, b): byte intervals of texts that have no exact copy, possibly overlapping. ``docs``: k1, k2, id, body."""
    first_id = docs.groupBy("k1", "k2").agg(F.min("id").alias("id"))  # one row of each distinct text
    found = stored(docs.select("k1", "k2", "body").mapInArrow(
        _find_anchors(length, gram), "h long, k1 long, k2 long, place long"))
    where = F.xxhash64("k1", "k2", "place")
    twice = (found.groupBy("h").agg(F.min(where).alias("x"), F.max(where).alias("y"), F.count(F.lit(1)).alias("n"))
             .where("x <> y").select("h", (F.col("n") > group).alias("hot")))
    # stored: a join of two plain shuffles, whose hot hashes adaptive execution can split
    used = found.join(stored(twice), "h")
    per = (used.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "place", "hot")).alias("at")).join(first_id, ["k1", "k2"])
           .select("k1", "k2", F.col("id").alias("rep"), "at"))
    full = docs.join(per, ["k1", "k2"]).where("id <=> rep").select("k1", "k2", "body", "at")
    full = stored(full.mapInArrow(_cut_segments_hot(length), _ddl(_SEGMENT) + ", hot boolean"))
    names = list(_SEGMENT)
    cold = (full.where("not hot").select(*names).repartition(F.col("h")).sortWithinPartitions("h")
            .mapInArrow(_mark_groups(length, gram), _ddl(_MARK)))
    win = full.where("hot").select(*names).mapInArrow(_windows(length), _ddl(_WINDOW))
    spot = F.xxhash64("k1", "k2", "s")
    again = (win.groupBy("d1", "d2").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y")
             .select("d1", "d2"))
    hot = win.join(again, ["d1", "d2"]).select("k1", "k2", F.col("s").alias("a"), (F.col("s") + length).alias("b"))
    return cold.unionByName(hot)


def _cut_segments_hot(length):
    cut = _cut_segments(length)

    def run(batches):
        for b in batches:
            hot = {(r["h"], r["place"]) for v in b.column(3) for r in v.as_py() if r["hot"]}
            for out in cut([b]):
                flag = [(h, p) in hot for h, p in zip(out.column(0).to_pylist(), out.column(3).to_pylist())] \
                    if hot else [False] * out.num_rows
                yield out.append_column("hot", pa.array(flag, pa.bool_()))

    return run


def _cut_text(length):
    """id, body, copies, intervals -> the merged removed spans and the kept bytes."""

    def run(batches):
        for b in batches:
            rows = []
            size = 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                whole = b.column(2)[i].as_py() and len(text) >= length
                spans: list[list[int]] = []
                for s in [(0, len(text))] if whole else sorted((x["a"], x["b"]) for x in b.column(3)[i].as_py() or []):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append([s[0], s[1]])
                at, kept = 0, []
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                rows.append((b.column(0)[i].as_py(), len(text), [{"a": x, "b": y} for x, y in spans], b"".join(kept)))
                size += len(text)
                if size > 1 << 23:
                    yield _kept(rows)
                    rows, size = [], 0
            if rows:
                yield _kept(rows)

    return run


def _kept(rows):
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "spans": span, "kept": pa.binary()}
    return _batch(list(zip(*rows)), kinds)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of a, b: removed byte intervals, merged), kept (binary), one row per input row.

    A null text counts as empty; texts shorter than ``length`` bytes lose nothing. Equal rows are copies of each
    other. Kept bytes may split a character: they are bytes, not text.
    """
    if not 8 <= gram <= length or length - gram > 254:
        raise ValueError("the gram is at least 8 bytes, at most the length and within 254 of it")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
    # both joins below deal the texts by (k1, k2), so one shuffle of them can serve both
    d = d.select("id", "body", F.xxhash64("body").alias("k1"), F.coalesce(F.crc32("body"), F.lit(0)).alias("k2"))
    found = marks(d, length, gram, group)
    spans = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("at"))
    copied = d.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", F.lit(True).alias("copied"))
    side = (spans.join(copied, ["k1", "k2"], "full_outer")
            .select("k1", "k2", F.when(F.col("copied").isNull(), F.col("at")).alias("at"), F.coalesce("copied", F.lit(False)).alias("copied")))
    whole = d.join(side, ["k1", "k2"], "left").select("id", "body", F.coalesce("copied", F.lit(False)).alias("copied"), "at")
    return whole.mapInArrow(_cut_text(length), "id long, n_bytes long, spans array<struct<a: long, b: long>>, kept binary"
                            ).withColumnRenamed("id", "doc_id")
