"""The registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmart.llm import (
    ctw,
    decontaminate,
    extract,
    language,
    mixing,
    negatives,
    packing,
    quality,
    rules,
    runs,
    simhash,
    urls,
)
from trialmart.llm import toxicity as toxic
from trialmart.llm.scratch import ship_package
from trialmart.llm.words import WORD, fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge_urls(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "ratio", "threshold")


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    found = ctw.score_documents(_table(spark, sf_dir, "documents"), trains=~held_out)
    return found.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", "bits_per_byte",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language.train(documents.filter(~held_out))
    found = language.predict(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxic.train(documents.filter(~held_out), _table(spark, sf_dir, "labels"))
    found = toxic.toxicity(documents, model)
    predicted = (F.col("score") >= toxic.THRESHOLD).cast("int")
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted")
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_quality(_table(spark, sf_dir, "documents"), clean_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_lines",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    found = quality.quality(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), teaches=~held_out
    )
    return found.select(
        "doc_id", held_out.alias("held_out"), "evidence", "host_posterior", "path_posterior",
        "score", "kept",
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = _table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    )
    return negatives.hard_negatives(rows, anchor=F.col("vec_id") % 100 == 0, scale=256)


def _repeating(doc_id: F.Column, text: F.Column) -> F.Column:
    """The text, in a tenth of the documents with its later words repeating the same few."""
    chance = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(chance / 10)

    def repeat(words: F.Column) -> F.Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = F.floor((n - first) / (g % 8 + 3)).cast("int") + 1
        times = F.ceil((n - first) / period).cast("int")
        piece = F.slice(words, first + 1, period)
        later = F.slice(F.flatten(F.array_repeat(piece, times)), F.lit(1), n - first)
        return F.array_join(F.concat(F.slice(words, F.lit(1), first), later), " ")

    # A lambda binds the words, which are otherwise cut once for every mention.
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    repeated = F.get(F.transform(F.array(words), repeat), 0)
    some = F.regexp_like(text, F.lit(WORD))
    return F.when((chance % 10 == 0) & some, repeated).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select(
        "doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = runs.periodic_runs(documents).withColumn("best", runs.strongest(F.col("runs")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.main_texts(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_simhash, op2_mixing, op3_urls, op4_ctw, op5_packing, op6_language, op7_toxicity,
        op8_rules, op9_decontamination, op10_quality, op11_negatives,
        op12_runs, op13_html,
    )
}
