"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardstats.llm import audit, bpe, chat, decontam, embed, lm, minhash, mix, pii, quality, urls, variants, warc
from yardstats.llm.shared import read, write_through


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, base: str) -> DataFrame:
    rows = read(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    control = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    rows = rows.unionByName(spark.createDataFrame(control, "conv_id long, turn long, role string, text string"))
    tree = write_through(chat.conversation_tree(rows), "chat-tree")
    formatted = write_through(chat.format_branches(tree), "chat-format")
    return chat.read_back(formatted).drop("leaf").withColumnRenamed("tree", "conv_id")


def op2_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    leaks = decontam.find_contamination(read(spark, base, "documents"), read(spark, base, "benchmark"))
    return leaks.drop("mark")


def op3_embedding_dedup(spark: SparkSession, base: str) -> DataFrame:
    return embed.near_duplicate_vectors(read(spark, base, "embeddings"), cosine=0.95)


def op4_pii(spark: SparkSession, base: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, base, "documents"))
    counts = [pii.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    digest = F.sha2(pii.span_list(F.col("spans"), pii.BASE_KINDS), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op5_mix(spark: SparkSession, base: str) -> DataFrame:
    plan = mix.plan_mix(read(spark, base, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_warc(spark: SparkSession, base: str) -> DataFrame:
    pages = read(spark, base, "pages")
    found = warc.read_archives(warc.archive_pages(pages), pages.schema["page_id"].dataType)
    return found.drop("url")


def op7_lm_score(spark: SparkSession, base: str) -> DataFrame:
    good = read(spark, base, "labels").filter("quality = 1")
    return lm.score_documents(read(spark, base, "documents"), good)


def op8_quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.rate_documents(read(spark, base, "documents"), read(spark, base, "labels"))


def op9_minhash(spark: SparkSession, base: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, base, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_url_filter(spark: SparkSession, base: str) -> DataFrame:
    return urls.judge_urls(read(spark, base, "pages"), urls.rule_table(spark))


def op11_bpe(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers  # where the vocabulary lies is known on the driver only

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bpe.encode(read(spark, base, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def op12_source_audit(spark: SparkSession, base: str) -> DataFrame:
    return audit.audit_sources(read(spark, base, "documents"))


def op13_spelling_variants(spark: SparkSession, base: str) -> DataFrame:
    return variants.spelling_variants(read(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii": op4_pii,
    "op5_mix": op5_mix,
    "op6_warc": op6_warc,
    "op7_lm_score": op7_lm_score,
    "op8_quality": op8_quality,
    "op9_minhash": op9_minhash,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_source_audit": op12_source_audit,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat.CHAT_SQL,
    "op5_mix": mix.MIX_SQL,
    "op10_url_filter": urls.URLS_SQL,
    "op12_source_audit": audit.AUDIT_SQL,
    "op13_spelling_variants": variants.VARIANTS_SQL,
}
