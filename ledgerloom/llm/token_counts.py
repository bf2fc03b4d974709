"""Token counts with a digest cache: only content that the cache does not hold is encoded, and once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch, tokens, words

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
_SPACES = r"[\x09-\x0D\x20]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Content that has the same tokens: ASCII white space as one space, ASCII capitals as small letters.

    Capitals stay in texts that hold "<|", where they decide whether a special string is there.
    """
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " "))
    return F.when(plain.contains("<|"), plain).otherwise(F.translate(plain, _CAPITALS, _SMALL))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row a digest; empty where nothing is stored yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # two runs at a time may both have stored a digest; its count is the same
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counted(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.counts(batch.column(1)), pa.int64())], ["digest", "n_tokens"])

    return count


def fill_cache(docs: DataFrame, text: str, cache: str, vocabulary: str) -> None:
    """Encode the distinct contents that the cache lacks, and append their counts to it."""
    spark, tokenizer = docs.sparkSession, tokens.version(vocabulary)
    content = docs.select(normalised(F.col(text)).alias("content")).select(F.sha2("content", 256).alias("hex"), "content").select(F.unhex("hex").alias("digest"), "content")
    misses = content.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
    # copies meet on their digest; each task keeps one of its own before the shuffle
    misses = misses.groupBy("digest").agg(F.first("content").alias("content"))
    misses.mapInArrow(words.frugal(_counted(vocabulary)), "digest binary, n_tokens long").select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens, the tokens of the whole text by the vocabulary, without added special tokens.

    cache: a folder that all executors reach; it need not exist. Null and empty texts have 0 tokens.
    Every row gets its count, repeated rows and rows with null ids alike. A column of docs that is
    called n_tokens is replaced. An empty table gives an empty table.
    """
    vocabulary = vocabulary or tokens.vocabulary_path()
    scratch.text_batches(docs.sparkSession)
    fill_cache(docs, text, cache, vocabulary)
    counts = read_cache(docs.sparkSession, cache, tokens.version(vocabulary)).select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__n_tokens"))
    keyed = docs.withColumn("__digest", F.unhex(F.sha2(normalised(F.col(text)), 256)))
    return keyed.join(counts, "__digest", "left").withColumn("n_tokens", F.col("__n_tokens")).drop("__digest", "__n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Tokens of every document; without a folder of stored counts, the run has one of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    narrow = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = token_counts(narrow, cache or scratch.new_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
