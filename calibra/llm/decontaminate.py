"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question whose figures or names were exchanged keeps its
template. Every window of ``WINDOW`` template tokens of the benchmark (of the whole item if it is shorter) is hashed
into an index; documents look all their windows up (a hash join whose small side is a block of the benchmark of
bounded size; a larger benchmark is taken block by block). Hits on one alignment of document and item are joined
into runs, compared token by token, and their slots are checked: one value of the item must always stand for the
same value in the document, and different names for different names. The case-folded words themselves, nothing replaced,
are indexed and looked up the same way, items shorter than a window as a whole: a verbatim copy needs no literal tokens
and no slot check. Items of fewer than ``SHORT`` words are common phrases: they count only where they are a whole line or sentence. A run that contradicts itself is split into its
maximal consistent parts and its verbatim stretches, each of which counts if it reaches ``RUN`` tokens or half of the
item by itself (``parts``). A document holds an item if what counts covers half of it or reaches ``RUN`` tokens in a row.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, stored

WINDOW = 8
RUN = 13
COVER = 0.5
#: Items of fewer words than this must be a whole line or sentence of the document.
SHORT = 3
#: Fewer literal (not placeholder) tokens than this make a template window too unspecific to be indexed.
LITERALS = 4
#: Benchmark tokens indexed and broadcast at once (about 100 bytes each).
BLOCK_TOKENS = 2_000_000
_CACHE_ROWS = 300_000

#: Units that follow numbers.
UNITS = set("""kg g mg lb lbs oz km m cm mm mi mile miles yard yards foot feet inch inches l ml liter liters litre
litres gallon gallons hour hours hr hrs minute minutes min second seconds sec day days week weeks month months year
years percent dollar dollars euro euros cent cents pound pounds degree degrees mph kmh watt watts volt volts""".split())
#: Given names that count as names wherever they are capitalised.
NAMES = set("""james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan
joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty steven margaret paul sandra andrew
ashley emily george maria anna peter alice bob carol eve hans pierre jean juan carlos marie sophie lucas""".split())
NUMBER, UNIT, NAME, OTHER = 1, 2, 3, 0
_NUMBER = re.compile(r"[$€£]?[0-9]+(?:[.,:/][0-9]+)*%?")
_EDGE = "\"'`.,;:!?()[]{}<>«»“”„‘’…*#|_-–—"
_ENDS = re.compile(r"[.!?:]['\")\]»”]*$")


class Index:
    """A block of the benchmark: vocabulary, window hashes and the items' tokens. Broadcast to the tasks."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, list[str]]] = []
        self.own: list[np.ndarray] = []  # the items' case-folded words, nothing replaced
        for item_id, text in items:
            chunks = (text or "").split()
            codes = np.array([self._code(c, grow=True) for c in chunks], np.int64).reshape(-1)
            self.items.append((item_id, template(codes), [core(c) for c in chunks]))
            self.own.append(codes >> 32)
        self.tables = self._tables([ids for _, ids, _ in self.items], LITERALS)
        self.own_tables = self._tables(self.own, 0)
        self.cache: dict[str, int] | None = None

    def _tables(self, items: list[np.ndarray], literals: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Window length -> (hash, item, place) by hash of the windows with that many literal tokens."""
        found = defaultdict(list)
        for k, ids in enumerate(items):
            w = min(self.window, len(ids))
            if w:
                n = np.concatenate([[0], np.cumsum(ids > NAME)])
                at = np.flatnonzero(n[w:] - n[:-w] >= literals)
                if len(at):
                    found[w].append((window_hashes(ids, w)[at], np.full(len(at), k, np.int64), at))
        tables = {}
        for w in sorted(found):
            h, k, at = (np.concatenate(x) for x in zip(*found[w]))
            order = np.lexsort((at, k, h))
            tables[w] = h[order], k[order], at[order]
        return tables

    def _code(self, chunk: str, grow: bool = False) -> int:
        """Word id << 32 | token id << 3 | name anywhere << 2 | capitalised << 1 | ends a sentence."""
        c = core(chunk)
        low = c.casefold()
        word = self.words.get(low or chunk, OTHER)
        if grow and word == OTHER:
            word = self.words[low or chunk] = len(self.words) + 4
        token = NUMBER if _NUMBER.fullmatch(c) else UNIT if low in UNITS else word
        capital = len(c) > 1 and c[0].isupper() and not c.isupper() and c.isalpha()
        return word << 32 | token << 3 | (capital and low in NAMES) << 2 | capital << 1 | bool(_ENDS.search(chunk))

    def codes(self, chunks: list[str]) -> np.ndarray:
        if self.cache is None:
            self.cache = {}
        known, code = self.cache, self._code
        try:
            return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        except KeyError:
            for c in set(chunks).difference(known):
                known[c] = code(c)
            out = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
            if len(known) > _CACHE_ROWS:
                known.clear()
            return out

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def leaks(self, text: str | None) -> list[tuple[int, int, float, bool]]:
        """(item_id, tokens matched, share of the item, verbatim) of the items that the text holds."""
        chunks = (text or "").split()
        if not chunks or not self.own_tables:
            return []
        codes = self.codes(chunks)
        runs = self._runs(template(codes), self.tables, [ids for _, ids, _ in self.items])
        verbatim = self._runs(codes >> 32, self.own_tables, self.own)
        covered: dict[int, np.ndarray] = {}
        longest: dict[int, int] = defaultdict(int)
        same: dict[int, bool] = defaultdict(lambda: True)
        for (k, shift), windows in runs.items():
            item = self.items[k]
            for run in joined(windows):
                for a, b, exact in parts(item, chunks, *run, shift):
                    covered.setdefault(k, np.zeros(len(item[1]), bool))[a:b] = True
                    longest[k] = max(longest[k], b - a)
                    same[k] &= exact
        edges: tuple[set[int], set[int]] | None = None
        for (k, shift), windows in verbatim.items():
            if len(self.own[k]) < SHORT:
                edges = edges or sentence_edges(text, chunks)
                windows = [(a, b) for a, b in windows if a + shift in edges[0] and b + shift in edges[1]]
            for a, b in joined(windows):
                covered.setdefault(k, np.zeros(len(self.own[k]), bool))[a:b] = True
                longest[k] = max(longest[k], b - a)
        out = []
        for k, c in covered.items():
            if c.sum() >= COVER * len(c) or longest[k] >= RUN:
                out.append((self.items[k][0], int(c.sum()), float(c.mean()), same[k]))
        return out

    def _runs(self, ids: np.ndarray, tables: dict, items: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(item, shift) -> the item's windows that stand in the document on this alignment."""
        runs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        outside = np.concatenate([[0], np.cumsum(ids == OTHER)])
        for w, (hashes, posted, places) in tables.items():
            if len(ids) < w:
                continue
            inside = np.flatnonzero(outside[w:] == outside[:-w])  # all tokens occur in the benchmark
            if not len(inside):
                continue
            h = window_hashes(ids, w)[inside]
            at = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == h)
            for p, a, x in zip(inside[hit].tolist(), at[hit].tolist(), h[hit].tolist()):
                while a < len(hashes) and hashes[a] == x:  # every posting of the hash, compared token by token
                    k, q = int(posted[a]), int(places[a])
                    if np.array_equal(items[k][q:q + w], ids[p:p + w]):
                        runs[k, p - q].append((q, q + w))
                    a += 1
        return runs


def sentence_edges(text: str, chunks: list[str]) -> tuple[set[int], set[int]]:
    """Words of the text at which a line or sentence begins, and before which one has ended."""
    ends, at = {len(chunks)}, 0
    for line in text.splitlines():
        at += len(line.split())
        ends.add(at)
    ends.update(k + 1 for k, c in enumerate(chunks) if _ENDS.search(c))
    return ends | {0}, ends


def core(chunk: str) -> str:
    return chunk.strip(_EDGE)


def template(codes: np.ndarray) -> np.ndarray:
    """Token ids with names replaced: a capitalised word inside a sentence, or a known given name."""
    ids = (codes & 0xFFFFFFFF) >> 3
    ends = np.concatenate([[True], (codes[:-1] & 1).astype(bool)])[:len(codes)]
    name = ((codes >> 2 & 1).astype(bool) | ((codes >> 1 & 1).astype(bool) & ~ends)) & ((ids > NAME) | (ids == OTHER))
    return np.where(name, NAME, ids)


def window_hashes(ids: np.ndarray, w: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - w + 1), np.int64)
    with np.errstate(over="ignore"):
        for k in range(w):
            h = h * np.int64(0x5851F42D4C957F2D) + ids[k:len(ids) - w + 1 + k] + 1
    return h


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def consistent(item: tuple, chunks: list[str], a: int, b: int, shift: int) -> bool | None:
    """None if the slots of the run contradict each other, else whether all slot values are the item's own."""
    forth: dict[tuple[int, str], str] = {}
    back: dict[str, str] = {}
    exact = True
    for q in range(a, b):
        kind = int(item[1][q])
        if kind > NAME:
            continue
        x, y = item[2][q].casefold(), core(chunks[q + shift]).casefold()
        exact &= x == y
        if forth.setdefault((kind, x), y) != y:
            return None
        if kind == NAME and back.setdefault(y, x) != x:
            return None
    return exact


def parts(item: tuple, chunks: list[str], a: int, b: int, shift: int) -> list[tuple[int, int, bool]]:
    """(start, end, all slot values of the run are the item's own) of what counts of the run [a, b).

    The whole run if its slots agree. Else its maximal consistent parts with ``LITERALS`` literal tokens and its
    verbatim stretches that reach ``RUN`` tokens or half of the item by themselves. Where two names of the item became
    one, either place may be the wrong one: both are left out, and only parts of ``RUN`` tokens count beside verbatim
    stretches.
    """
    exact = consistent(item, chunks, a, b, shift)
    if exact is not None:
        return [(a, b, exact)]
    forth: dict[tuple[int, str], tuple[int, str]] = {}
    back: dict[str, tuple[int, str]] = {}
    found, changed, merged, left = [], [a - 1], False, a
    for q in range(a, b):
        kind = int(item[1][q])
        if kind > NAME:
            continue
        x, y = item[2][q].casefold(), core(chunks[q + shift]).casefold()
        if x != y:
            changed.append(q)
        at, was = forth.get((kind, x), (q, y))  # the last place of the value: [left, q) holds it with one partner only
        if was != y and at >= left:
            found.append((left, q))
            left = at + 1
        at, was = back.get(y, (q, x)) if kind == NAME else (q, x)
        if was != x and at >= left:
            found += [(left, at), (at + 1, q)]
            merged, left = True, q + 1
        forth[kind, x] = (q, y)
        if kind == NAME:
            back[y] = (q, x)
    found.append((left, b))
    half = COVER * len(item[1])
    least = RUN if merged else min(RUN, half)
    out = [(s, e, False) for s, e in found if e - s >= least and (item[1][s:e] > NAME).sum() >= LITERALS]
    out += [(s + 1, e, False) for s, e in zip(changed, [*changed[1:], b]) if e - s - 1 >= min(RUN, half)]
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", tokens: int = BLOCK_TOKENS):
    """The benchmark as Index blocks, streamed through the driver one block at a time. Null texts have no windows."""
    held, n = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        n += len((r[1] or "").split())
        if n >= tokens:
            yield Index(held)
            held, n = [], 0
    if held:
        yield Index(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, n_tokens, share, verbatim): the benchmark items that each document holds."""
    schema = "doc_id long, item_id long, n_tokens long, share double, verbatim boolean"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    last = None
    for index in blocks(benchmark, tokens=tokens):
        if last is not None:  # more than one block: each block's result is written before the next is indexed
            out = stored(last) if out is None else out.unionByName(stored(last))
        last = _search(d, index, schema)
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    return last if out is None else out.unionByName(last)


def _search(d: DataFrame, index: Index, schema: str) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast(index)

    def each(ids, texts):
        found = shared.value
        for i, t in zip(ids, texts):
            for leak in found.leaks(t):
                yield i, *leak

    return by_text(d, ["doc_id", "text"], each, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents, with their own columns, that hold no benchmark item. No shuffle: rows are judged in place."""
    for index in blocks(benchmark, tokens=tokens):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(index))(F.col(text_col)))
    return docs


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.leaks(t) for t in texts], dtype=bool)

    return clean
