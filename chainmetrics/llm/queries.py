"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmetrics.llm import (
    bpe,
    chat_format,
    embedding_dedup,
    hard_negatives,
    line_dedup,
    merkle,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    url_reputation,
)
from chainmetrics.llm.common import bounded_batches, read
from chainmetrics.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"

#: Fixed rules of op6.
URL_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

#: Fixed turns of conversation -1 of op10.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(read(spark, sf_dir, "documents"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
    return judged.select("doc_id", *columns)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(read(spark, sf_dir, "documents"), vocabulary())
    back = bpe.decode(tokens.withColumn("doc", F.struct("doc_id", "ids")), vocabulary(), key="doc")
    return back.select(
        "doc.doc_id",
        F.expr("octet_length(doc.ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("doc.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_reputation.judge(read(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_later_runs(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -1 as JSON records, their texts beside them, in the layout that their roles call for.

    A user's and an assistant's turn become a prompt and its response, with a system's
    turn before them a system, instruction and output; all others stay messages.
    """
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(EXTRA_TEXT).alias("text"))
                    for i, role in enumerate(("user", "assistant"))
                )
            )
        ),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    grouped = chat_format.messages_of_rows(rows)
    roles = F.transform("messages", lambda m: m.role)
    texts = F.transform("messages", lambda m: m.content)
    full = F.forall(texts, lambda t: t != "")

    def record(*names: str) -> Column:
        return F.to_json(F.struct(*(F.lit(str(i)).alias(n) for i, n in enumerate(names))))

    numbered = F.transform("messages", lambda m, i: F.struct(m.role.alias("role"), i.cast("string").alias("content")))
    layout = (
        F.when((roles == F.array(F.lit("user"), F.lit("assistant"))) & full, record("prompt", "response"))
        .when(
            (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & full,
            record("system", "instruction", "output"),
        )
        .otherwise(F.to_json(F.struct(numbered.alias("messages"))))
    )
    return grouped.select("conv_id", layout.alias("record"), texts.alias("texts"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_records(spark, sf_dir)
    done = chat_format.formatted(chat_format.canonical_turns(records, texts="texts"))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        "formatted",
        chat_format.read_turns(F.col("formatted")).alias("read"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.shares(docs, mixing.cycled_weights(docs)).drop("repeats")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.audited(docs, lowered, tampered).drop("own_nodes")


_ALL: tuple[Query, ...] = (
    op1_suffix_dedup,
    op2_quality_rules,
    op3_simhash_dedup,
    op4_quality_classifier,
    op5_bpe,
    op6_url_reputation,
    op7_line_dedup,
    op8_packing,
    op9_embedding_dedup,
    op10_chat_format,
    op11_mixing,
    op12_hard_negatives,
    op13_merkle_manifest,
)

QUERIES: dict[str, Query] = {
    q.__name__: (lambda spark, sf_dir, q=q: q(bounded_batches(spark), sf_dir)) for q in _ALL
}

__all__ = ["ORACLES", "QUERIES"]
