"""The thin queries over the given tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, word_count, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import without_boilerplate

    out = without_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("piece_bpe_32k.model"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import scan_report

    return scan_report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_filter import judged

    out = judged(table(spark, sf_dir, "pages"))
    return out.select("page_id", *[F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")], F.round("__score", 6).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.identified(docs, langid.language_models(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy", "accepted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import chat

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    return chat.read_back(chat.formatted(chat.events_of_rows(rows))).withColumnRenamed("conversation", "conv_id")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixed

    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = mixed(written(sized, "sizes"), size="size")
    return mix.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.round("__target", 3).alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import audited

    return audited(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import fill_middle

    out = fill_middle.transformed(table(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
