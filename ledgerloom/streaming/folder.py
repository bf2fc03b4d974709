"""New documents of a folder, each processed once.

The file source remembers in its checkpoint which paths it has seen; a run handles what is
new and stops. Uploads are also told by name and size, whatever folder they come in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.trial_balance import OK, read_trial_balance
from ledgerloom.plans.upload import prepare


def stream_texts(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).selectExpr("_metadata.file_path AS doc_id", "value AS texto")


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.csv", files_per_batch: int | None = None) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    found = reader.load(folder)
    return found.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("nome"), "length", "modificationTime", "content")


def each_once(files: DataFrame, forget_after: str | None = None) -> DataFrame:
    """Uploads of a stream whose name and size no earlier one has, in this run or any before.

    The names taken are keyed state in the checkpoint. They are kept for good, or, with ``forget_after``
    (such as ``"90 days"``), until files that much newer have come.
    """
    if forget_after is None:
        return files.dropDuplicates(["nome", "length"])
    return files.withWatermark("modificationTime", forget_after).dropDuplicatesWithinWatermark(["nome", "length"])


def _run(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    query = (
        source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def ingest_trial_balances(
    spark: SparkSession, folder: str, out: str, checkpoint: str, fallback_date: str | None = None
) -> StreamingQuery:
    """New texts to ``out/status`` and ``out/lancamentos``. A document that cannot be read gets
    its status and never stops the others. A batch that is repeated after a failure writes the
    same folder again."""

    def handle(batch: DataFrame, number: int) -> None:
        # parsed once; status and entries both read the stored documents
        read = read_trial_balance(batch, fallback_date=fallback_date).stored()
        target = f"lote={number}"
        read.status.write.mode("overwrite").parquet(f"{out}/status/{target}")
        read.lancamentos.write.mode("overwrite").parquet(f"{out}/lancamentos/{target}")

    return _run(stream_texts(spark, folder), checkpoint, handle)


def ingest_uploads(spark: SparkSession, folder: str, out: str, checkpoint: str, forget_after: str | None = None) -> StreamingQuery:
    """New files to ``out/registros``, ``out/erros`` and ``out/arquivos``, each upload once (:func:`each_once`)."""

    def handle(batch: DataFrame, number: int) -> None:
        data = prepare(batch).stored()
        target = f"lote={number}"
        files = data.arquivos.select("doc_id", "nome", "entrada.*", "document_type")
        files.write.mode("overwrite").parquet(f"{out}/arquivos/{target}")
        data.registros.drop("_contabil", "_nomes").write.mode("overwrite").parquet(f"{out}/registros/{target}")
        data.erros.write.mode("overwrite").parquet(f"{out}/erros/{target}")

    return _run(each_once(stream_files(spark, folder), forget_after), checkpoint, handle)


def any_success(status: DataFrame) -> bool:
    """True when at least one document of a run could be used."""
    return not status.filter(F.col("status") == OK).isEmpty()
