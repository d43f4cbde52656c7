"""Conversation prefix trie with subtree totals by parallel tree contraction.

A node of depth d is a distinct sequence of the first d turns (role, text); its members are the conversations that
begin with it. A prefix is known by the sum of hashes of (position, turn) over its turns, kept as four 32-bit sums: a
sum of prefixes can be taken in pieces, so a conversation of any length is split over tasks. Nodes are groups of
equal sums (128 bits together), counted map-side, so a turn shared by a third of all rows costs one partial row a task.

Totals over subtrees come from tree contraction, whose number of rounds grows with the logarithm of the depth and
never with the length of a chain. Every round

* rakes: leaves give what they hold to their parent and leave;
* compresses: of the nodes with a single child, those whose coin shows 1 while their parent's shows 0 are taken out,
  which never takes two neighbours; the child moves up to the grandparent and keeps on its edge what they held. Coins
  are the bits of the depth, lowest first, so a chain halves from round to round; then bits of a hash.

Every round is one table written to the shared folder. When the root alone is left, the rounds are undone in reverse:
a node taken out gets its own share plus its child's total, and so every node gets its total.

Defined cases: turns are in order of ``turn`` (null first), then role, then text; equal rows are turns each. A null role
or text counts as empty. Rows without a conversation id belong to none. An empty table has no nodes. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

#: Turn numbers (or positions) of one piece of a conversation; a piece is ranked in one task, its offset by counts.
PIECE_BITS = 10
#: Conversation ids of one piece of a member list.
LIST_BITS = 12
LIMBS = ["s0", "s1", "s2", "s3"]


def words(text: Column) -> Column:
    """Number of maximal runs without white space."""
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")).cast("long")


def ordered_turns(convs: DataFrame) -> DataFrame:
    """conv_id, rank (from 0 in the conversation's order), words, t0..t3 (32-bit hashes of role and text).

    A conversation is cut into pieces of ``2**PIECE_BITS`` turn numbers; rows are ranked within a piece, and a piece's
    offset is the running sum of the (few) piece counts before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        text.alias("text"))
    x = x.withColumn("piece", F.shiftright("turn", PIECE_BITS))
    own = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # the texts' sizes keep role and text apart in the hash
    parts = [F.length("role"), F.col("role"), F.col("text")]
    one, two = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts, F.lit(2))
    return _offset(stored(x.select(
        "conv_id", F.coalesce("piece", F.lit(-(1 << 62))).alias("piece"), (F.row_number().over(own) - 1).alias("place"),
        words(F.col("text")).alias("words"), *_limbs(one, two, "t"))), "rank")


def _limbs(one: Column, two: Column, name: str) -> list[Column]:
    low = F.lit(0xFFFFFFFF)
    return [c.alias(f"{name}{i}") for i, c in enumerate(
        [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)])]


def _offset(x: DataFrame, out: str) -> DataFrame:
    """Turn ``place`` within (conv_id, piece) into ``out``, the place in the conversation."""
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    off = x.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return x.join(off, ["conv_id", "piece"]).withColumn(out, F.col("place") + F.col("off")).drop("place", "off", "piece")


def rebuild(turns: DataFrame, stride: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt from ``turns`` (``ordered_turns``): the first h turns of conversation c - c % stride,
    then its own turns after its first h, with h = crc32(decimal c) % kinds. Returns (rows with ``pos`` for ``rank``,
    all conversations with their length)."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base_id = F.col("conv_id") - F.col("conv_id") % stride
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(kinds))
    c = sizes.select("conv_id", "n", base_id.alias("base"), h.alias("h"))
    lead = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("lead"))
    c = stored(c.join(lead, "base", "left").select(
        "conv_id", "base", "n", "h", F.least("h", F.coalesce("lead", F.lit(0))).alias("kept")))
    first = turns.where((F.col("rank") < kinds) & (F.col("conv_id") % stride == 0)).withColumnRenamed("conv_id", "base")
    light = ["words", "t0", "t1", "t2", "t3"]
    copied = c.join(first, "base").where("rank < h").select("conv_id", F.col("rank").alias("pos"), *light)
    own = turns.join(c.select("conv_id", "h", "kept"), "conv_id").where("rank >= h").select(
        "conv_id", (F.col("rank") - F.col("h") + F.col("kept")).alias("pos"), *light)
    lengths = c.select("conv_id", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return copied.unionByName(own), lengths


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), words of the last turn, s0..s3 (sums over the prefix) and p0..p3 (without its last turn)."""
    t = [F.col(f"t{i}") for i in range(4)]
    terms = _limbs(F.xxhash64(F.lit(3), "pos", *t), F.xxhash64(F.lit(4), "pos", *t, F.lit(4)), "s")
    x = stored(rows.select("conv_id", F.shiftright("pos", PIECE_BITS).alias("piece"), "pos", "words", *terms))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    off = x.groupBy("conv_id", "piece").agg(*(F.sum(s).alias(s) for s in LIMBS)).select(
        "conv_id", "piece", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"o{s}") for s in LIMBS))
    upto = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("conv_id", "piece", "pos", "words", *LIMBS, *(F.sum(s).over(upto).alias(f"u{s}") for s in LIMBS))
    x = x.join(off, ["conv_id", "piece"])
    whole = {s: F.col(f"u{s}") + F.col(f"o{s}") for s in LIMBS}
    low = F.lit(0xFFFFFFFF)
    return x.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "words",
                    *(whole[s].bitwiseAND(low).alias(s) for s in LIMBS),
                    *((whole[s] - F.col(s)).bitwiseAND(low).alias(f"p{i}") for i, s in enumerate(LIMBS)))


def nodes(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, words, s0..s3."""
    known = ["depth", *LIMBS]
    above = [f"p{i}" for i in range(4)]
    deep = paths.groupBy(*known).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                     F.first("words").alias("words"), *(F.first(p).alias(p) for p in above))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(s) for s in LIMBS), "conv_id", "n_convs",
        F.lit(0).cast("long").alias("words"), *(F.lit(None).cast("long").alias(p) for p in above))
    x = stored(deep.unionByName(root))
    kids = x.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"),
                                        *(F.col(p).alias(s) for p, s in zip(above, LIMBS))).agg(
        F.count(F.lit(1)).alias("n_children"))
    # a node and all its children: the parent's side has one row a key, a hot parent's children may be split
    up = x.select((F.col("depth") + 1).alias("depth"), *(F.col(s).alias(p) for p, s in zip(above, LIMBS)),
                  F.col("conv_id").alias("parent_conv_id"))
    return x.join(kids, known, "left").join(up, ["depth", *above], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "words", *LIMBS)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """conv_id, depth and the totals of the ``values`` (long) over each node's subtree, the node included.

    ``tree`` holds conv_id, depth (together the node's name), parent_conv_id (null: root), n_children. Any number of
    trees may be given. Rounds of rake and compress, then the expansion (see the module's text).
    """
    edge, name = [f"e_{v}" for v in values], ["conv_id", "depth"]
    zero = F.lit(0).cast("long")
    live = tree.select(*name, F.col("parent_conv_id").alias("up_conv"), F.when(
        F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"), *values,
        *(zero.alias(e) for e in edge), (F.col("n_children") == 0).alias("leaf"))
    raked, spliced = [live.where("leaf").select(*name, *values)], []
    bits = int(tree.agg(F.max("depth")).first()[0] or 0).bit_length()
    while True:
        r = len(spliced)
        # rake: what the leaves hold, and how many other children (one of them by name) are left
        child = F.when(~F.col("leaf"), F.struct(*name, *edge))
        given = live.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
            *(F.sum(F.when(F.col("leaf"), F.col(v) + F.col(e)).otherwise(0)).alias(f"g_{v}") for v, e in zip(values, edge)),
            F.count(child).alias("left"), F.min(child).alias("child"))

        def coin(conv, depth):
            return (F.shiftright(depth, r) if r < bits else F.xxhash64(F.lit(r), conv, depth)).bitwiseAND(F.lit(1))

        state = stored(live.where("not leaf").join(given, name).select(
            *name, "up_conv", "up_depth", *((F.col(v) + F.col(f"g_{v}")).alias(v) for v in values), *edge,
            (F.col("left") == 0).alias("leaf"), F.col("child"),
            ((F.col("left") == 1) & F.col("up_conv").isNotNull() & (coin(F.col("conv_id"), F.col("depth")) == 1)
             & (coin(F.col("up_conv"), F.col("up_depth")) == 0)).alias("out")))
        if not state.count():
            break
        raked.append(state.where("leaf").select(*name, *values))
        # compress: the child of a node taken out moves up and keeps the node's share on its edge
        gone = state.where("out")
        spliced.append(gone.select(*name, F.col("child.conv_id").alias("low_conv"), F.col("child.depth").alias("low_depth"),
                                   *((F.col(v) + F.col(f"child.{e}")).alias(f"own_{v}") for v, e in zip(values, edge))))
        moved = gone.select(F.col("child.conv_id").alias("conv_id"), F.col("child.depth").alias("depth"),
                            F.col("up_conv").alias("to_conv"), F.col("up_depth").alias("to_depth"),
                            *((F.col(v) + F.col(e)).alias(f"m_{v}") for v, e in zip(values, edge)))
        live = state.where("not out").join(moved, name, "left").select(
            *name, F.coalesce("to_conv", "up_conv").alias("up_conv"), F.coalesce("to_depth", "up_depth").alias("up_depth"),
            *values, *((F.col(e) + F.coalesce(f"m_{v}", F.lit(0))).alias(e) for v, e in zip(values, edge)), "leaf")
    # expansion: a node taken out in round r hangs above one that stayed longer, whose total is known by then
    known = raked[-1]
    for r in range(len(spliced) - 1, -1, -1):
        x = spliced[r].join(known.select(F.col("conv_id").alias("low_conv"), F.col("depth").alias("low_depth"), *values),
                            ["low_conv", "low_depth"])
        back = stored(x.select(*name, *((F.col(v) + F.col(f"own_{v}")).alias(v) for v in values)))
        known = known.unionByName(back).unionByName(raked[r])
    return known


def member_digests(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, s0..s3, ends_sha256: SHA-256 of the comma-joined decimal ids, ascending, of the conversations that end at
    a node. Ids are joined in pieces of ``2**LIST_BITS``; a node's pieces then pass one task as a stream, in order."""
    known = ["depth", *LIMBS]
    ends = paths.join(lengths, "conv_id").where("depth = length").select("conv_id", *known).unionByName(
        lengths.where("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in known)))
    lists = ends.groupBy(*known, F.shiftright("conv_id", LIST_BITS).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = lists.repartition(*known).sortWithinPartitions(*known, "piece")
    schema = pa.schema([*((c, pa.int64()) for c in known), ("ends_sha256", pa.string())])

    def digest(batches):
        at, state, made = None, None, []
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(5)))
            for key, ids in zip(keys, b.column(6).to_pylist()):
                if key != at:
                    if at is not None:
                        made.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(made) > 10_000:
                yield _rows(made, schema)
                made = []
        if at is not None:
            made.append((*at, state.hexdigest()))
        yield _rows(made, schema)

    return dealt.mapInArrow(digest, "depth long, s0 long, s1 long, s2 long, s3 long, ends_sha256 string")


def _rows(made: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*made)) if made else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations given as ``rows`` (conv_id, pos from 0, words, t0..t3) and ``lengths`` (conv_id, length,
    turnless ones included): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stored(prefixes(rows))
    lengths = stored(lengths)
    tree = stored(nodes(paths, lengths).withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    own = tree.drop("n_leaves", "saved_tokens").join(member_digests(paths, lengths), ["depth", *LIMBS], "left")
    return own.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(convs: DataFrame) -> DataFrame:
    """The trie of ``convs`` (conv_id, turn, role, text) as they stand."""
    turns = stored(ordered_turns(convs))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return trie(turns.withColumnRenamed("rank", "pos"), lengths)


def rebuilt_trie(convs: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (``rebuild``)."""
    return trie(*rebuild(stored(ordered_turns(convs))))
