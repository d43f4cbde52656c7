"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints are 64 bits. Two that differ in at most ``distance`` (3) bits differ in at most 3 of their 8 bytes, so
they share at least 5 positional bytes, the first of them at one of the positions 0 to 3, the second at one up to 4, and
so on. Every distinct fingerprint is posted under its bytes at positions 0 to 3. In a list of at most ``LIST`` members
the shared positional bytes of each pair are tallied, pairs that reach 5 are retained and their bits compared. A longer
list is not tallied: its members are posted again under that byte and each further position at which the next shared
byte may stand, so a pair meets in a short list at last, or under 5 shared bytes (at most 56 lists a fingerprint in all).

Hot lists: equal fingerprints are one entry, so a list of 5 bytes holds at most 2**24 values whatever the corpus. There
long ones look up the 2,324 values within 3 bits of each member, so the work of a list
grows with its length and not with its square. A list yields links that connect all its members that verified
pairs connect (a spanning forest), never all pairs. Components come from large-star/small-star rounds on these links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, stored

SHINGLE = 3
DISTANCE = 3
#: Longest posting list whose pairs are tallied.
LIST = 512
#: Above this length a list under all guaranteed bytes is searched by neighbouring values instead of pair by pair.
PAIRWISE = 1024
#: A fingerprint with at least this share of all rows is hot: there are at most as many as its inverse.
HOT_SHARE = 1 / 10_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit integer: A-Z lower-cased, words between white space, shingles with
    repeats, XXH64 seed 42, a bit set if over half of the hashes set it. Fewer words: one shingle; none: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        h = xxhash.xxh64_intdigest
        view = memoryview(joined)
        hashes = [h(view[a:b], 42) for a, b in zip(starts[:len(words) - shingle + 1].tolist(),
                                                  (ends[shingle - 1:] - 1).tolist())]
    n = len(hashes)
    h64 = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(h64[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint): one row per input row."""

    def each(ids, texts):
        for d, t in zip(ids, texts):
            yield d, fingerprint(t, shingle)

    return by_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], each,
                   "doc_id long, fp long")


def _links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct 64-bit ``values`` within ``distance`` bits."""
    n = len(values)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def link(pairs):
        for i, j in pairs:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(values[i]), int(values[j])))

    v = values.view("<u8")
    if n <= PAIRWISE:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1:]) <= distance)
            if len(near):
                link((i, i + 1 + int(j)) for j in near)
        return out
    order = np.argsort(v)
    s = v[order]
    differing = int(np.bitwise_or.reduce(s ^ s[0]))  # bits in which members differ at all
    bits = [np.uint64(1 << b) for b in range(64) if differing >> b & 1]
    for k in range(1, distance + 1):
        for some in combinations(bits, k):
            mask = np.uint64(0)
            for b in some:
                mask |= b
            other = s ^ mask
            at = np.minimum(np.searchsorted(s, other), n - 1)
            hit = np.flatnonzero((s[at] == other) & (other > s))
            link((int(order[i]), int(order[at[i]])) for i in hit)
    return out


def links(distinct_fp: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what pairs within ``distance`` connect."""
    shared = 8 - distance  # the guaranteed minimum of shared positional bytes
    if not 0 <= distance <= 7:
        raise ValueError("a distance of 0 to 7 bits leaves at least one shared byte")
    posted = _posted(distinct_fp.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("last")), distance)
    out = None
    for level in range(1, shared + 1):
        lists = posted.repartition(F.col("key")).sortWithinPartitions("key")
        if level == shared:
            found = lists.select("fp", "key").mapInArrow(_all_bytes_shared(distance), "a long, b long")
        else:
            made = stored(lists.mapInArrow(_tally(distance, shared), "a long, b long, mask long, last int"))
            found = made.where("mask is null").select("a", "b")
            again = made.where("mask is not null").select(F.col("a").alias("fp"), "mask", "last")
            posted = _posted(again, distance)
        out = found if out is None else out.unionByName(found)
        if level < shared and not again.limit(1).count():
            break
    return out.distinct()


def _posted(entries: DataFrame, distance: int) -> DataFrame:
    """(fp, mask, last, key): entries under the bytes of ``mask``, up to position ``last``, posted under one byte more."""
    n = F.bit_count("mask") / 8  # shared bytes so far: the next one stands at most ``distance`` places late
    at = F.explode(F.sequence(F.col("last") + 1, (n + distance).cast("int"))).alias("at")
    byte = F.expr("shiftleft(255L, 8 * at)")
    return entries.select("fp", "mask", "last", at).select(
        "fp", F.col("mask").bitwiseOR(byte).alias("mask"), F.col("at").alias("last")).withColumn(
        "key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def _tally(distance: int, shared: int):
    """Lists of one key after the other: pairs of short lists tallied and verified, members of long ones handed on."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64()), ("last", pa.int32())])

    def rows(a, b=None, mask=None, last=None):
        cols = [pa.nulls(len(a), f.type) if c is None else pa.array(c, f.type) for c, f in zip((a, b, mask, last), schema)]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def pairs(key, fp):
        """A spanning forest of the pairs that share ``shared`` bytes and differ in at most ``distance`` bits."""
        v = fp.view(np.uint64)
        parts, root = v.view(np.uint8).reshape(-1, 8), {}

        def find(i):
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        at = np.flatnonzero(key[1:] == key[:-1])
        d = 1
        while len(at):
            both = at[(parts[at] == parts[at + d]).sum(1) >= shared]  # the tally reaches the minimum
            both = both[np.bitwise_count(v[both] ^ v[both + d]) <= distance]
            for i in both.tolist():
                x, y = find(i), find(i + d)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(fp[i]), int(fp[i + d])))
            d += 1
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
        return out

    def run(batches):
        empty = np.zeros(0, np.int64)
        held = [empty, empty, empty, empty]  # key, fp, mask, last: the list that may go on in the next batch
        handing = None  # the key of a long list under way
        for b in batches:
            new = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                   for c in ("key", "fp", "mask", "last")]
            key, fp, mask, last = (np.concatenate(x) for x in zip(held, new))
            if not len(key):
                continue
            start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.append(start, len(key)))
            long = np.repeat(size > LIST, size)
            if handing is not None:
                long |= key == handing
            open_ = key == key[-1]
            if long.any():
                yield rows(fp[long], None, mask[long], last[long])
            short = ~long & ~open_
            found = pairs(key[short], fp[short])
            if found:
                yield rows(*zip(*found))
            handing = key[-1] if long[-1] else None
            held = [empty] * 4 if long[-1] else [x[open_] for x in (key, fp, mask, last)]
        found = pairs(held[0], held[1])
        if found:
            yield rows(*zip(*found))

    return run


def _all_bytes_shared(distance: int):
    """Lists under all guaranteed bytes: bits are compared, long lists by neighbouring values."""

    def verify(batches):
        key = None
        held: list[np.ndarray] = []

        def close():
            if sum(map(len, held)) > 1:
                yield from _links(np.unique(np.concatenate(held)), distance)

        made: list[tuple[int, int]] = []
        for b in batches:
            k, v = b.column(1).to_numpy(), b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if k[x] != key:
                    made.extend(close())
                    key, held = k[x], []
                held.append(v[x:y])
            if len(made) > 10_000:
                yield _pairs(made)
                made = []
        made.extend(close())
        yield _pairs(made)

    return verify


def _pairs(made: list) -> pa.RecordBatch:
    a, b = zip(*made) if made else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Large-star and small-star rounds; each round is written to the shared folder, so lineage stays short. A
    hub's edges are grouped by map-side minima and joins that AQE may split, never collected into one row.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # large star: every neighbour above u goes to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stored(large)
        # small star: u and its neighbours below go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        small = stored(small)
        roots = small.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        # done when every node has one edge and no root has an edge of its own
        open_ = (roots.where("n > 1").limit(1).count()
                 + small.select(F.col("v").alias("u")).distinct().join(roots, "u", "left_semi").limit(1).count())
        e = small
        if not open_:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links of at most ``distance`` bits), one row per input
    row. Null and word-less texts have fingerprint 0 and link like any other; rows with a null doc_id take part and
    get their component's least non-null id."""
    fp = stored(fingerprints(docs, shingle))
    least = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    comp = stored(components(links(least.select("fp"), distance)))
    ids = comp.join(least, comp.node == least.fp).select("root", "node", "least_id")
    by_root = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = ids.select("root", "node").join(by_root, "root").select(F.col("node").alias("fp"), "component_id")
    whole = (least.join(members, "fp", "left")
             .select("fp", F.coalesce("component_id", "least_id").alias("component_id"), "n"))
    # rows of hot fingerprints do not meet: these few are broadcast (at most 1 / HOT_SHARE rows), the others joined
    total = least.agg((F.sum("n") * HOT_SHARE).alias("hot_from"))
    whole = stored(whole.crossJoin(F.broadcast(total)).withColumn("hot", F.col("n") >= F.col("hot_from")))
    known = fp.join(F.broadcast(whole.where("hot").select("fp", F.struct("component_id").alias("c"))), "fp", "left")
    rest = known.where("c is null").drop("c").join(whole.where("not hot").select("fp", "component_id"), "fp")
    return known.where("c is not null").select("doc_id", "fp", "c.component_id").unionByName(
        rest.select("doc_id", "fp", "component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each near-duplicate component, the one with the least id, with its own columns.

    Repeated rows (equal id and text) count once. Rows with a null id are kept only where their whole component has
    none. The texts are dealt by id once: the join with the kept ids and the removal of repeated rows use the same
    two columns (the id, and whether it is null).
    """
    found = stored(near_duplicates(docs, shingle, distance))
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null")]
    kept = found.where("doc_id <=> component_id").select(*key).distinct()
    rows = docs.select("*", *key, F.xxhash64("text").alias("__text")).join(kept, ["__id", "__null"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__id", "__null", "__text").orderBy("__text"))
    return rows.withColumn("__row", first).where("__row = 1").select(*docs.columns)
