"""The queries of the text operators and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, exact_dedup, jaccard_join, language, line_dedup, mixing, oracles, packing, periodic, quality, secrets, sharding, substrings, token_files
from .common import let, words_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.train_and_identify(table(spark, sf_dir, "documents"))


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(table(spark, sf_dir, "documents"))


def op4_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public byte-level BPE; the path is the operators' parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_elkan_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(table(spark, sf_dir, "embeddings"))


def with_periods(doc_id: Column, text: Column) -> Column:
    """The contract's input: in a tenth of the texts the words from one on repeat with a period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def from_words(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        i = lambda k: F.when(k < a, k).otherwise(a + (k - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(w, i(k))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words_of(text), from_words)).otherwise(text)


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.run_digests(periodic.find_runs(docs, ["doc_id"]))


def op13_compacted_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digest(substrings.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_cross_parsing_language, op3_chosen_path_join, op4_histogram_sort_shards, op5_exact_dedup, op6_best_two_fit_packing, op7_quality_rules, op8_mixing, op9_line_dedup, op10_huffman_token_files, op11_elkan_clustering, op12_harmonic_runs, op13_compacted_substrings)
}
ORACLES: dict[str, str] = oracles.ORACLES | {
    "op5_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
