"""The registered queries of the corpus operators: thin contracts over whole tables.

Each ``opN_`` query runs its operator over its whole table and derives the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, hardnegatives, license, linededup, packing, pieces, pii, prefixtrie, quality, sharding,
               simhash, suffix, urlfilter)
from .common import documents, stored
from .oracles import ORACLES  # noqa: F401  the queries' SQL, where SQL can express them

QUERIES: dict = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def piece_model() -> str:
    """The SentencePiece BPE model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary() -> str:
    """The word BPE file of the installed public tokenizers (the same path on every executor)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    light = quality.measure(documents(spark, sf_dir)).select("doc_id", "lang", "__q")
    measured = stored(light)
    d = quality.judge(measured, stored(quality.cutoffs(measured, labels)))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select("doc_id", *(F.col("__q")[k].alias(k) for k in fields), F.col("__failed").alias("base_failed"),
                    F.col("__kept").alias("kept"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_documents(documents(spark, sf_dir))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op9_urlfilter")
def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op10_linededup")
def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.drop_boilerplate(documents(spark, sf_dir))
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op4_suffix")
def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_license")
def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license.scan_documents(documents(spark, sf_dir))
    return d.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    d = pii.find_spans(documents(spark, sf_dir))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *map(count, pii.BASE),
                    F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query("op13_pieces")
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.encode_documents(documents(spark, sf_dir), piece_model())
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_hardnegatives")
def op11_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardnegatives.mine(rows, "vec_id", label, "embedding", F.col("vec_id") % 50 == 0)


@query("op12_prefixtrie")
def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
