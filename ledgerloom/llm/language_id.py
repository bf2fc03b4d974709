"""Language identification by fusing evidence: the text, the declared language, and who publishes it.

A text's likelihood in each language comes from hashed three-byte sequences. What a language declared in
markup (or metadata) says is learnt by grouping the declarations with what the texts themselves
show; so are the priors of hosts, each smoothed towards its domain, that towards its address suffix, and
that towards all rows. The posterior is their product. One more hypothesis, "und", is text without the
habits of any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch, words

#: Rows of known language to learn from, at most about; buckets of sequences; bytes that a sequence spans.
SAMPLE_ROWS, BUCKETS, SPAN = 8_000, 1 << 16, 3
#: Rows that the next wider group counts for in a prior; rows that one unseen declaration counts for.
STRENGTH, UNSEEN = 10.0, 0.5
#: Share of rows expected in no language, and the least posterior that is kept.
UNKNOWN, LEAST = 1e-3, 0.5
#: A host is dealt over salts from one part in so many of a partition's share of all rows.
PARTS = 4
UND = "und"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_CLASS[~_LETTER[_CLASS]] = 32


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (bucket, language and then UND): log probabilities


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the sequences that hold a letter, with a space around each text, and for each text the number of them before it."""
    small = np.insert(_CLASS[data], np.concatenate([offsets[:-1], offsets[1:]]), 32).astype(np.uint32)
    offsets = offsets + 2 * np.arange(len(offsets))
    if len(small) < SPAN:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (small[:-2] << np.uint32(16)) | (small[1:-1] << np.uint32(8)) | small[2:]
    ok = code != 0x202020
    for back in (1, 2):  # not over the ends of texts
        cut = offsets[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    at = np.flatnonzero(ok)
    bucket = ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return bucket, np.searchsorted(at, offsets)


def _counted(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            label = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for low, high, data, offsets in words.chunks(batch.column(0)):
                bucket, bounds = _codes(data, offsets)
                own = np.repeat(label[low:high], np.diff(bounds))
                table += np.bincount(own * BUCKETS + bucket, minlength=table.size).reshape(table.shape)
        for k, row in enumerate(table):
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(seen.astype(np.int32)), pa.array(row[seen])], ["language", "bucket", "n"])

    return count


def learn_text(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> TextModel:
    """Likelihoods from a bounded sample of rows with a label, chosen by the hash of their key."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where((F.length("label") > 0) & F.col("text").isNotNull())
    sizes = known.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row a language
    total = sum(r["n"] for r in sizes)
    languages = sorted(r["label"] for r in sizes if r["label"] != UND)
    table = np.full((BUCKETS, len(languages) + 1), 0.1)
    if languages:
        # as many rows of each language as an equal share of the sample, or all that there are
        share = F.create_map(*[x for r in sizes for x in (F.lit(r["label"]), F.lit(min(1.0, rows / len(sizes) / r["n"])))])
        draw = F.pmod(F.xxhash64("key", F.lit(21)), F.lit(1_000_000)) < F.try_element_at(share, F.col("label")) * 1_000_000
        chosen = known.where(draw & F.col("label").isin(languages)) if total > rows else known.where(F.col("label").isin(languages))
        counts = chosen.select("text", "label").mapInArrow(words.frugal(_counted(languages)), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
        np.add.at(table, (counts["bucket"].to_numpy(), counts["language"].to_numpy()), counts["n"].to_numpy())
    table[:, -1] = 1.0
    return TextModel(languages, np.log(table / table.sum(0)).astype(np.float32))


def _likely(model: TextModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.table.shape[1]
        for batch in batches:
            out, letters = [], []
            for low, high, data, offsets in words.chunks(batch.column(0)):
                bucket, bounds = _codes(data, offsets)
                total = np.zeros((high - low, width))
                for k in range(width):
                    sums = np.concatenate([[0.0], np.cumsum(model.table[:, k][bucket], dtype=np.float64)])
                    total[:, k] = np.diff(sums[bounds])
                out.append(total / SPAN)  # neighbours overlap
                letters.append(np.diff(bounds))
            scores = np.concatenate(out) if out else np.zeros((0, width))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * width), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([column, pa.array(np.concatenate(letters) if letters else [], pa.int64()), batch.column(1)], ["likelihood", "letters", "rest"])

    return score


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda total, y: total + y))


def _sums(group: list[str], width: int) -> list[Column]:
    return [F.array(*[F.sum(F.col("shown")[k]) for k in range(width)]).alias("n")]


def _smoothed(rows: DataFrame, wider: DataFrame, by: list[str], to: list[str], width: int, name: str) -> DataFrame:
    """by -> (what its rows show + STRENGTH * the wider group's prior) / (rows + STRENGTH)."""
    total = F.aggregate("n", F.lit(STRENGTH), lambda a, x: a + x)
    prior = F.zip_with("n", "wider", lambda x, y: (x + STRENGTH * y) / total)
    counted = rows.groupBy(*by).agg(*_sums(by, width))
    return counted.join(wider.withColumnRenamed("prior", "wider"), to).select(*by, prior.alias(name))


def identify(docs: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, domain: Column, suffix: Column, languages: list[str] | None = None) -> DataFrame:
    """docs with language, posterior and accepted.

    The columns say where each piece of evidence stands; a null or unknown declaration says nothing, a null
    host counts as a host of its own. A text without letters (also a null or empty one) is "und". accepted:
    the language is known, is one of `languages` where these are given, and has a posterior of LEAST or
    more. Each row is judged by itself: rows with null or repeated keys alike. Columns of docs with these
    three names are replaced, all others pass through. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch.text_batches(spark)
    partitions = scratch.shuffle_partitions(spark)
    docs = docs.drop("language", "posterior", "accepted")
    names = [*model.languages, UND]
    width = len(names)
    value = lambda c: F.coalesce(F.lower(c.cast("string")), F.lit(""))
    known = F.when(value(declared).isin(names), value(declared)).otherwise(F.lit(""))
    rest = F.struct(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), known.alias("declared"), value(host).alias("host"), value(domain).alias("domain"), value(suffix).alias("suffix"))
    source = docs.select(text.alias("text"), rest.alias("rest"))
    kind = source.schema["rest"].dataType.simpleString()
    scored = source.mapInArrow(words.frugal(_likely(model)), f"likelihood array<double>, letters long, rest {kind}")
    start = [float(np.log((1 - UNKNOWN) / max(1, width - 1)))] * (width - 1) + [float(np.log(UNKNOWN))]
    shown = _softmax(F.zip_with("likelihood", F.array(*map(F.lit, start)), lambda x, y: x + y))
    narrow = scored.select("likelihood", "letters", *[F.col(f"rest.{c}").alias(c) for c in ("declared", "host", "domain", "suffix")], shown.alias("shown"))
    # what the texts show by host and declaration: a few rows a host, from which all priors roll up
    lettered = [F.coalesce(F.sum(F.when(F.col("letters") > 0, F.col("shown")[k])), F.lit(0.0)) for k in range(width)]
    seen = scratch.stored(narrow.groupBy("suffix", "domain", "host", "declared").agg(F.array(*lettered).alias("shown"), F.count("*").alias("rows")), "shown")
    overall = seen.agg(*[F.sum(F.col("shown")[k]).alias(f"n{k}") for k in range(width)], F.sum("rows").alias("rows")).first()
    all_rows = overall["rows"] or 1
    sums = np.array([overall[k] or 0.0 for k in range(width)])
    overall = (sums + np.exp(start)) / (sums.sum() + 1)
    by_declared = {r["declared"]: np.array(r["n"]) for r in seen.groupBy("declared").agg(*_sums([], width)).collect()}  # a row a language at most
    given = np.array([by_declared.get(name, np.zeros(width)) for name in [*names, ""]]) + UNSEEN
    said = np.log(given / given.sum(0))
    said[-1] = 0.0  # no declaration says nothing
    said = F.create_map(*[x for k, name in enumerate([*names, ""]) for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in said[k]]))])
    wide = seen.select("suffix").distinct().withColumn("prior", F.array(*[F.lit(float(x)) for x in overall]))
    by_suffix = _smoothed(seen, wide, ["suffix"], ["suffix"], width, "prior")
    by_domain = _smoothed(seen, by_suffix, ["suffix", "domain"], ["suffix"], width, "prior")
    by_host = _smoothed(seen, by_domain, ["suffix", "domain", "host"], ["suffix", "domain"], width, "prior")
    # a host may have a third of all rows: hosts of more than a part of a partition's share are dealt over salts
    place, parts = F.xxhash64("suffix", "domain", "host").alias("place"), PARTS * partitions
    counts = seen.groupBy(place).agg(F.sum("rows").alias("n"))
    # fewer than `parts` hosts can have more than that share: a hash and a number each
    hot = F.broadcast(counts.where(F.col("n") * parts > all_rows).select("place", F.ceil(F.col("n") * parts / all_rows).cast("int").alias("salts")))
    dealt = lambda df: df.withColumn("place", place).join(hot, "place", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop("place")
    priors = dealt(by_host).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    hashed = [f"row.`{c.name.replace('`', '``')}`" for c in docs.schema if not any(k in c.dataType.simpleString() for k in ("map<", "variant"))]
    rows = dealt(scored.select("likelihood", "letters", "rest.*")).withColumn("salt", F.pmod(F.xxhash64("likelihood", *hashed), F.col("salts")).cast("int")).drop("salts")
    joined = rows.join(priors, ["suffix", "domain", "host", "salt"], "left")
    prior = F.coalesce("prior", F.array(*[F.lit(float(x)) for x in overall]))
    fused = F.zip_with(F.zip_with("likelihood", prior, lambda x, y: x + F.log(y)), F.element_at(said, F.col("declared")), lambda x, y: x + y)
    out = joined.withColumn("posteriors", _softmax(fused)).withColumn("posterior", F.when(F.col("letters") > 0, F.array_max("posteriors")).otherwise(F.lit(0.0)))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("posteriors", F.array_max("posteriors")).cast("int"))
    out = out.withColumn("language", F.when(F.col("letters") > 0, best).otherwise(F.lit(UND)))
    allowed = F.col("language").isin(languages if languages is not None else model.languages)
    return out.select("row.*", "language", "posterior", (allowed & (F.col("posterior") >= LEAST)).alias("accepted"))


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """Documents: the declared language is `lang`, the host is `source`; there is no address."""
    return identify(docs, model, F.col("text"), F.col("lang"), F.col("source"), F.lit(None), F.lit(None))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it is accepted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_documents(docs.select("doc_id", "text", "lang", "source"), learn_text(docs))
    return found.select("doc_id", "language", "posterior", F.col("accepted").alias("kept"))


def page_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[A-Za-z0-9#]+;", " ")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its text, its html element, its address and its host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    model = learn_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = identify(pages, model, page_text(F.col("html")), declared, host, domain, suffix)
    return found.select("page_id", host.alias("host"), declared.alias("declared"), "language", "posterior", "accepted")
