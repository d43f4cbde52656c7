"""Hard-negative mining: exact integer scores of anchors against all rows by Strassen products of tiles.

Vectors become integers, floor(scale * x). Rows are packed into blocks of ``TILE`` candidates; the anchors among them
into blocks of at most ``ANCHORS``. Every anchor block meets every group of candidate blocks in one task at a time: the
two are multiplied by Strassen's recursion on int64 tiles (zero padded to even halves, exact additions), and of the
product only heaps are kept. A heap holds the best few (score, id) of an anchor; two heaps of the same anchor merge into
one, so results of tasks are merged in rounds of ``FAN`` until one is left. The first pass keeps each anchor's best rows
of its own label (its positives), the second one a heap per anchor and positive of the rows of other labels whose score
lies in the positive's window.

The work is anchors times rows, as asked for; a task holds one group of candidates, one anchor block and their product,
whatever the size of the table or of a label. All scores are exact: tiles whose sums might leave 64 bits are computed
with unbounded integers instead (a score that does not fit into a long is an error).

Defined cases: rows with a null id, label or vector, or with a null or non-finite (also after scaling) component take no
part. Vectors of different lengths are padded with zeros; an empty one scores 0 with all. Equal scores are in order of
id. Repeated rows are rows of their own, each anchor, positive and negative as often as it stands; only the anchor's own
row is not its positive. Empty tables and anchors without a positive or a negative give no rows. Extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Candidates of a block, anchors of a block, heaps merged by one round's task, the side at which recursion ends.
TILE, ANCHORS, FAN, LEAF = 4096, 256, 64, 16
#: Bytes of vectors in one block; long vectors make shorter blocks.
BLOCK_BYTES = 4 << 20
_BLOCK = "g int, kind int, key long, n int, dim int, code string, ids binary, labels binary, vecs binary, extra binary"
_HEAP = "ab long, part int, n int, k int, scores binary, ids binary, full binary"
_FAR = 10 ** 60  # below every score of unbounded integers


def strassen(a: np.ndarray, c: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The products of all rows of ``a`` (m, k) with all rows of ``c`` (n, k): a (m, n) matrix of exact integers."""
    (m, k), n = a.shape, len(c)
    side, depth = min(m, k, n), 0
    while side > leaf:
        side, depth = (side + 1) // 2, depth + 1
    unit = 1 << depth

    def padded(x):
        out = np.zeros([-(-s // unit) * unit for s in x.shape], x.dtype)
        out[:x.shape[0], :x.shape[1]] = x
        return out

    return _product(padded(a), padded(c).T, depth)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    depth -= 1
    p1 = _product(a11 + a22, b11 + b22, depth)
    p2 = _product(a21 + a22, b11, depth)
    p3 = _product(a11, b12 - b22, depth)
    p4 = _product(a22, b21 - b11, depth)
    p5 = _product(a11 + a12, b22, depth)
    p6 = _product(a21 - a11, b11 + b12, depth)
    p7 = _product(a12 - a22, b21 + b22, depth)
    out = np.empty((2 * m, 2 * n), a.dtype)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def _pack_vectors(v: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in doubles, in the shortest type that holds them."""
    most = np.abs(v).max(initial=0)
    code = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<f8"
    return code, v.astype(code).tobytes()


def _vectors(code: str, raw: bytes, n: int, dim: int) -> np.ndarray:
    v = np.frombuffer(raw, code).reshape(n, dim)
    if code == "<f8":
        return np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(n, dim)
    return v.astype(np.int64)


def _batch(rows: list, ddl_schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in ddl_schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ddl_schema)], schema=ddl_schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def blocks(rows: DataFrame, id_col: str, label: Column, vector: str, anchor: Column, scale: float, groups: int) -> DataFrame:
    """Rows as candidate blocks (``_BLOCK``): ``g`` the group, ``key`` the block in it, ``extra`` the anchors' marks."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(vector, lambda c: c.cast("double")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    top = F.lit(float("inf"))
    x = x.where("id is not null and label is not null and v is not null").where(F.forall(
        "v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < top), F.lit(False))))
    schema = _schema(_BLOCK)

    def pack(batches):
        from pyspark import TaskContext

        g, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = np.concatenate([h[0] for h in held])
            dim = max(h[2].shape[1] for h in held)
            v = np.zeros((len(ids), dim))
            at = 0
            for h in held:
                v[at:at + len(h[0]), :h[2].shape[1]] = h[2]
                at += len(h[0])
            code, raw = _pack_vectors(v)
            return (g, 0, seq, len(ids), dim, code, ids.tobytes(), np.concatenate([h[1] for h in held]).tobytes(), raw,
                    np.concatenate([h[3] for h in held]).tobytes())

        for b in batches:
            vec = b.column(2)
            start = np.asarray(vec.offsets)[:b.num_rows + 1].astype(np.int64)
            flat = np.floor(np.asarray(vec.values)[:start[-1]] * scale)
            ids, labels = np.asarray(b.column(0)), np.asarray(b.column(1))
            marks = b.column(3).to_numpy(zero_copy_only=False)
            dims = np.diff(start)
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):  # runs of vectors of one length
                if lo == hi:
                    continue
                step = max(1, min(TILE, BLOCK_BYTES // (8 * max(1, int(dims[lo])))))
                for a in range(lo, hi, step):
                    z = min(a + step, hi)
                    if held and (sum(len(h[0]) for h in held) + z - a > step):
                        yield _batch([close()], schema)
                        seq, held = seq + 1, []
                    held.append((ids[a:z], labels[a:z], flat[start[a]:start[z]].reshape(z - a, int(dims[lo])), marks[a:z]))
        if held:
            yield _batch([close()], schema)

    return x.repartition(groups).mapInArrow(pack, _BLOCK)


def anchor_blocks(packed: DataFrame) -> DataFrame:
    """The marked rows of candidate blocks as anchor blocks: ``key`` names the block, ``extra`` holds the rows' places."""
    schema = _schema(_BLOCK)

    def pick(batches):
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["extra"], bool))
                v = np.frombuffer(r["vecs"], r["code"]).reshape(r["n"], r["dim"])
                for sub, lo in enumerate(range(0, len(at), ANCHORS)):
                    some = at[lo:lo + ANCHORS]
                    yield _batch([(r["g"], 1, (r["g"] << 32) + (r["key"] << 12) + sub, len(some), r["dim"], r["code"],
                                   np.frombuffer(r["ids"], np.int64)[some].tobytes(),
                                   np.frombuffer(r["labels"], np.int64)[some].tobytes(), v[some].tobytes(),
                                   some.astype(np.int64).tobytes())], schema)

    return packed.mapInArrow(pick, _BLOCK)


class _Group:
    """The candidates of one group, in order of id."""

    def __init__(self, parts: list[dict]):
        dim = max(p["dim"] for p in parts)
        vecs = [np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in (
            _vectors(p["code"], p["vecs"], p["n"], p["dim"]) for p in parts)]
        ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.labels = np.concatenate([np.frombuffer(p["labels"], np.int64) for p in parts])[order]
        self.vecs = np.concatenate([v.astype(object) if any(u.dtype == object for u in vecs) else v for v in vecs])[order]
        self.column = np.empty(len(ids), np.int64)
        self.column[order] = np.arange(len(ids))
        self.first = dict(zip([p["key"] for p in parts], np.cumsum([0] + [p["n"] for p in parts]).tolist()))

    def scores(self, vecs: np.ndarray) -> np.ndarray:
        c, dim = self.vecs, max(vecs.shape[1], self.vecs.shape[1])
        a, c = (np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in (vecs, c))
        if object in (a.dtype, c.dtype) or 100 * dim * (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(c).max(initial=0)) + 1) >= 2 ** 63:
            a, c = a.astype(object), c.astype(object)
        return strassen(a, c)


def _best(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best allowed columns; columns are in order of id, so the first of equals is the right one."""
    low = -_FAR if score.dtype == object else np.iinfo(np.int64).min
    x = np.where(allowed, score, low)
    row = np.arange(len(x))
    out, who, full = np.zeros((len(x), k), np.int64), np.zeros((len(x), k), np.int64), np.zeros((len(x), k), bool)
    for i in range(k):
        j = x.argmax(axis=1)
        v = x[row, j]
        full[:, i] = v != low
        if not full[:, i].any():
            break
        out[:, i] = np.where(full[:, i], v, 0).astype(np.int64)  # an error where a score exceeds a long
        who[:, i] = ids[j]
        x[row, j] = low
    return out, who, full


def tiles(packed: DataFrame, anchors: DataFrame, groups: int, kept: int, positives: int | None,
          low: tuple[int, int] = (0, 1), high: tuple[int, int] = (1, 1)) -> DataFrame:
    """Heaps (``_HEAP``) of every anchor block with every group: the best ``kept`` rows of the anchors' labels, or with
    ``positives`` (their number; ``extra`` holds their scores) the best rows of other labels in each one's window."""
    each = anchors.drop("g").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "home", F.shiftright("key", 32))
    both = each.unionByName(packed.withColumn("home", F.col("g").cast("long")))
    parts = min(groups, 4096)
    cols = ["g", "kind", "key", "home", "n", "dim", "code", "ids", "labels", "vecs", "extra"]
    dealt = both.select(*cols).repartitionById(parts, F.col("g") % parts).sortWithinPartitions("g", "kind", "key")
    schema = _schema(_HEAP)

    def heaps(batches):
        g, held, group = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(cols)}
                if r["g"] != g:
                    g, held, group = r["g"], [], None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if group is None:
                    if not held:
                        continue  # a group without candidates
                    group, held = _Group(held), []
                score = group.scores(_vectors(r["code"], r["vecs"], r["n"], r["dim"]))
                label = np.frombuffer(r["labels"], np.int64)[:, None]
                if positives is None:
                    allowed = group.labels == label
                    if r["home"] == g:  # an anchor's own row
                        at = np.frombuffer(r["extra"], np.int64) + group.first[(r["key"] >> 12) & 0xFFFFF]
                        allowed[np.arange(r["n"]), group.column[at]] = False
                    made = [_best(score, allowed, group.ids, kept)]
                else:
                    size = r["n"] * positives
                    best = np.frombuffer(r["extra"][:8 * size], np.int64).reshape(r["n"], positives)
                    there = np.frombuffer(r["extra"][8 * size:], bool).reshape(r["n"], positives)
                    other = group.labels != label
                    made = []
                    for p in range(positives):
                        ps = [int(v) for v in best[:, p]]
                        lo = np.array([-(-low[0] * v // low[1]) for v in ps], object)
                        hi = np.array([high[0] * v // high[1] for v in ps], object)
                        if score.dtype != object:
                            lo, hi = lo.astype(np.int64), hi.astype(np.int64)
                        made.append(_best(score, other & (score >= lo[:, None]) & (score <= hi[:, None])
                                          & there[:, p, None], group.ids, kept))
                out, who, full = (np.stack([m[j] for m in made], 1) for j in range(3))
                yield _batch([(r["key"], g, r["n"] * len(made), kept, out.tobytes(), who.tobytes(), full.tobytes())], schema)

    return dealt.mapInArrow(heaps, _HEAP)


def merged(heaps: DataFrame, parts: int) -> DataFrame:
    """One heap per anchor block: rounds that each merge up to ``FAN`` heaps of a block as a stream."""
    schema = _schema(_HEAP)

    def merge(batches):
        at, held = None, None
        for b in batches:
            for r in b.to_pylist():
                shape = r["n"], r["k"]
                new = [np.frombuffer(r[c], t).reshape(shape) for c, t in (
                    ("scores", np.int64), ("ids", np.int64), ("full", bool))]
                if (r["ab"], r["part"]) != at:
                    if at is not None:
                        yield _batch([(*at, *held[0].shape, *(h.tobytes() for h in held))], schema)
                    at, held = (r["ab"], r["part"]), new
                    continue
                s, i, f = (np.concatenate([x, y], 1) for x, y in zip(held, new))
                order = np.lexsort((i, -s, ~f), axis=-1)[:, :shape[1]]
                held = [np.take_along_axis(x, order, 1) for x in (s, i, f)]
        if at is not None:
            yield _batch([(*at, *held[0].shape, *(h.tobytes() for h in held))], schema)

    while True:
        x = heaps.withColumn("part", F.expr(f"cast(part div {FAN} as int)"))
        heaps = x.repartition("ab", "part").sortWithinPartitions("ab", "part").mapInArrow(merge, _HEAP)
        parts = -(-parts // FAN)
        if parts <= 1:
            return heaps
        heaps = stored(heaps)


def mine(rows: DataFrame, id_col: str, label: Column, vector: str, anchor: Column, scale: float = 256, positives: int = 5,
         negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score: for every row marked
    ``anchor`` and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels
    whose score is at least ``low`` and at most ``high`` (fractions) of the positive's."""
    groups = max(1, -(-rows.count() // TILE))
    packed = stored(blocks(rows, id_col, label, vector, anchor, scale, groups))
    anchors = stored(anchor_blocks(packed))
    best = stored(merged(tiles(packed, anchors, groups, positives, None), groups).select(
        F.col("ab").alias("key"), F.col("scores").alias("p_scores"), F.col("ids").alias("p_ids"), F.col("full").alias("p_full")))
    with_best = stored(anchors.drop("extra").join(best, "key").withColumn("extra", F.concat("p_scores", "p_full")))
    asked = with_best.select("g", "kind", "key", "n", "dim", "code", "ids", "labels", "vecs", "extra")
    hard = merged(tiles(packed, asked, groups, negatives, positives, low, high), groups)
    wide = with_best.select("key", F.col("ids").alias("a_ids"), "p_scores", "p_ids").join(
        hard.select(F.col("ab").alias("key"), "n", "scores", "ids", "full"), "key").drop("key")
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()),
                        ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def emit(batches):
        for b in batches:
            for r in b.to_pylist():
                full = np.frombuffer(r["full"], bool).reshape(-1, negatives)
                row, col = np.nonzero(full)
                take = {c: np.frombuffer(r[c], np.int64) for c in ("a_ids", "p_scores", "p_ids", "scores", "ids")}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    take["a_ids"][row // positives], take["p_ids"][row], (col + 1).astype(np.int32),
                    take["ids"].reshape(-1, negatives)[row, col], take["p_scores"][row],
                    take["scores"].reshape(-1, negatives)[row, col])], schema=schema)

    return wide.mapInArrow(emit, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                                 "negative_score long")
