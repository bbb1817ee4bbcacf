"""Registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.llm import (chat, decontaminate, langid, packing, simhash, substring_dedup, suffix_dedup, tokencount,
                         topk, toxicity, trie, warc, whitening)
from millrun.llm.common import table

REGISTRY = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@register
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


@register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), capacity=2048)


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted", "worst_sentence")


@register
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.train(docs))


@register
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


@register
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and index of all pages, then every URL looked up and its records fetched."""
    pages = table(spark, sf_dir, "pages")
    _, index = warc.archived(spark, pages)
    records = warc.fetch(warc.lookup(warc.url_keys(pages), index))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))


@register
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), length=50)


@register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, then three edits of each, at places given by a hash of its id:
    a replacement, an insertion and a deletion."""
    trees = tokencount.built(table(spark, sf_dir, "documents"))
    chars = F.char_length("text")

    def edit(n: int, removed: int, inserted: str):
        at = F.pmod(F.crc32(F.concat_ws(":", F.lit(n), F.col("doc_id").cast("string")).cast("binary")), chars + 1)
        return F.struct(F.lit(n).alias("edit_no"), at.cast("long").alias("start"), F.lit(removed).alias("removed"),
                        F.lit(inserted).alias("inserted"))

    edits = F.array(edit(0, 12, "edited words"), edit(1, 0, " an insertion, with\n\nlines "), edit(2, 25, ""))
    out = tokencount.edited_in_place(trees.withColumn("edits", edits))
    return out.select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"),
                      "n_encoded", "n_chars_encoded")


@register
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat.digest(chat.formatted(given.unionByName(extra), budget=1024, history=256))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.sequences(table(spark, sf_dir, "conversations"), group=20, most=4))


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(table(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@register
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"), length=50)
