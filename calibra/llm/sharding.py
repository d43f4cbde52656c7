"""Sharding: a k-d tree over document metadata (DataFrame functions only).

Every document is a point in metadata space (length, source, language, id), each dimension scaled to the same
range. A node with more than one shard left to give is split along its widest dimension at the weighted median:
the point below which the bytes for half of its shards (rounded up) lie. Ties along a dimension, such as one source
with a third of all rows, are ordered by a hash of the row, so a split may go through them. Leaves reach the target
bytes (total / shards) up to ``tolerance``.

Medians are found exactly on the data by narrowing histograms: each pass sums bytes per node and one of
``BINS`` equal bins of the node's current interval (partial sums before the shuffle), the driver keeps the bin that
holds the median and the next pass looks into it only. The driver sees at most shards x BINS sums per pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, stored

SHARDS = 40
BINS = 1024
TOLERANCE = 0.0005
BITS = 30
_SPAN = 1 << BITS


def _scaled(c: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.lit(0).cast("long")
    return F.floor((c - low) / (high - low) * (_SPAN - 1)).cast("long")


def points(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
           lang_col: str = "lang") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32 and one long per dimension (``__d0``..), ties broken by a hash.
    Nulls stand at the start of their dimension."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.crc32(F.coalesce(F.col(source_col).cast("string"), F.lit("")).cast("binary")).alias("__source"),
        F.crc32(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).cast("binary")).alias("__lang")))
    dims = [F.ln(F.col("size")), F.col("__source").cast("double"), F.col("__lang").cast("double"),
            F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")]
    ends = light.agg(*(f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("a", F.min), ("b", F.max)))).first()
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(_SPAN))
    return light.select("doc_id", "size", "text_crc32", *(
        (_scaled(d, ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0) * _SPAN + tie).alias(f"__d{i}")
        for i, d in enumerate(dims)))


def _looked_up(states: dict[int, dict], names: list[str]) -> Column:
    """The state of the row's node as a struct of longs; null for other nodes."""
    return F.create_map(*(x for k, s in states.items() for x in (F.lit(k).cast("long"), F.struct(*(
        F.lit(s[n]).cast("long").alias(n) for n in names)))))[F.col("__node")]


def _key(table: DataFrame, dim: Column) -> Column:
    return F.get(F.array(*sorted(c for c in table.columns if c.startswith("__d"))), dim.cast("int"))


def kd_tree(points: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``points`` plus ``__node``, the first shard of the row's node; at the end every node is one shard.

    A level of the tree (there are log2 of the shards) reads the light table a few times and writes it once with its
    new nodes, so each plan stays small.
    """
    table = stored(points.withColumn("__node", F.lit(0).cast("long")))
    dims = [c for c in table.columns if c.startswith("__d")]
    width = {0: shards}  # node -> its number of shards
    while grow := {k: n for k, n in width.items() if n > 1}:
        at = table.where(F.col("__node").isin(list(grow)))
        seen = at.groupBy("__node").agg(F.sum("size").alias("bytes"), *(
            f(c).alias(f"{n}{i}") for i, c in enumerate(dims) for n, f in (("a", F.min), ("b", F.max)))).collect()
        open_, cuts = {}, {}
        for r in seen:
            k, left = r["__node"], (grow[r["__node"]] + 1) // 2
            extents = [(r[f"b{i}"] // _SPAN) - (r[f"a{i}"] // _SPAN) for i in range(len(dims))]
            dim = max(range(len(dims)), key=lambda i: extents[i])
            open_[k] = {"dim": dim, "low": r[f"a{dim}"], "high": r[f"b{dim}"], "before": 0,
                        "target": r["bytes"] * left / grow[k], "slack": tolerance * r["bytes"] / grow[k]}
        while open_:
            _narrow(at, open_, cuts)
        for k, n in grow.items():
            left = (n + 1) // 2
            width |= {k: left, k + left: n - left}
            if k in cuts:
                cuts[k]["right"] = k + left
        cut = _looked_up(cuts, ["dim", "cut", "right"])
        beyond = _key(table, F.col("__s.dim")) > F.col("__s.cut")
        table = stored(table.withColumn("__s", cut).withColumn(
            "__node", F.when(beyond, F.col("__s.right")).otherwise(F.col("__node"))).drop("__s"))
    return table


def _narrow(at: DataFrame, open_: dict, cuts: dict) -> None:
    """One histogram pass: keep the bin with the median in ``open_``, or move the node to ``cuts``."""
    states = {k: s | {"width": (s["high"] - s["low"]) // BINS + 1} for k, s in open_.items()}
    bins = (at.withColumn("__s", _looked_up(states, ["dim", "low", "high", "width"])).where("__s is not null")
            .withColumn("__k", _key(at, F.col("__s.dim"))).where("__k between __s.low and __s.high")
            .groupBy("__node", F.expr("(__k - __s.low) div __s.width").alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    by: dict[int, list] = {}
    for r in bins.collect():
        by.setdefault(r["__node"], []).append((r["bin"], r["bytes"], r["rows"]))
    for k, s in list(open_.items()):
        step, sum_ = (s["high"] - s["low"]) // BINS + 1, s["before"]
        for b, n, rows in sorted(by[k]):
            low, high = s["low"] + b * step, min(s["high"], s["low"] + (b + 1) * step - 1)
            if sum_ + n >= s["target"]:
                if n <= s["slack"] or rows == 1 or high == low:
                    nearer = sum_ + n - s["target"] <= s["target"] - sum_
                    cuts[k] = {"dim": s["dim"], "cut": high if nearer else low - 1}
                    del open_[k]
                else:
                    s["low"], s["high"], s["before"] = low, high, sum_
                break
            sum_ += n
        else:  # rounding of the target only: everything goes left
            cuts[k] = {"dim": s["dim"], "cut": s["high"]}
            del open_[k]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard): one row per input row; equal rows too
    get slots of their own. Empty in, empty out."""
    at = points(docs)
    if at.isEmpty():
        return at.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = kd_tree(at, shards).select("doc_id", "size", "text_crc32", F.col("__node").cast("int").alias("shard"))
    return gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
