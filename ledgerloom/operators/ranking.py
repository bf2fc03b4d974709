"""Positions and running totals inside keys of any size, and top rows per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import round_scaled
from ledgerloom.session import ensure_checkpoint_dir

_SLICE = "_slice"


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    position: str = "posicao",
    running: str | None = None,
    measure: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each key 1..n and, if asked, add the running and the whole sum.

    A window over the key would put a whole company into one task. Instead the rows are
    range-partitioned on key and order, so that a large key covers many slices; each slice
    is numbered by itself and shifted by what the slices before it hold. ``order`` must
    leave no ties. The slice numbers are written with the rows by a reliable checkpoint, so
    a lost executor cannot move a row to another slice.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = list(by)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        df.repartitionByRange(slices, *[F.col(k) for k in by], *order)
        .withColumn(_SLICE, F.spark_partition_id())
        .checkpoint()
    )
    inside = Window.partitionBy(*by, _SLICE).orderBy(*order)
    numbered = laid.withColumn("_n", F.row_number().over(inside))
    sizes = [F.count(F.lit(1)).alias("_size")]
    if measure:
        until_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = numbered.withColumn("_run", F.sum(measure).over(until_here))
        sizes.append(F.sum(measure).alias("_sum"))

    # one row per key and slice: at most `slices` rows in any window below
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy(*by, _SLICE).agg(*sizes)
    shift = [F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")]
    if measure:
        shift.append(F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"))
        shift.append(F.sum("_sum").over(Window.partitionBy(*by)).alias("_all"))
    offsets = offsets.select(*by, _SLICE, *shift)

    joined = numbered.alias("r").join(
        offsets.alias("o"),
        reduce(
            lambda a, b: a & b,
            [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*by, _SLICE]],
        ),
    )
    out = [F.col(f"r.{c}").alias(c) for c in df.columns]
    out.append((F.col("_n") + F.col("_before")).cast("bigint").alias(position))
    if measure and running:
        out.append((F.col("_run") + F.col("_sum_before")).alias(running))
    if measure and total:
        out.append(F.col("_all").alias(total))
    return joined.select(*out)


def top_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, position: str = "posicao"
) -> DataFrame:
    """First ``n`` rows of each key. Spark keeps only ``n`` rows per key and map task before
    the shuffle, so a hot key costs no more than a small one."""
    if not by:
        df = df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= n)


def spend_totals(expenses: DataFrame, by: Sequence[str], dimension: str) -> DataFrame:
    return expenses.groupBy(*by, dimension).agg(
        F.sum("valor").alias("total"), F.count("valor").alias("quantidade")
    )


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))


def spend_ranking(expenses: DataFrame, by: Sequence[str], dimension: str) -> DataFrame:
    """Largest spend first; equal totals go by name."""
    totals = spend_totals(expenses, by, dimension)
    order = [F.desc("total"), F.asc(dimension)]
    placed = ranked(totals, by, order, measure="total", total="_whole")
    return placed.select(
        *by,
        F.col("posicao"),
        dimension,
        "total",
        "quantidade",
        round_scaled(share_of(F.col("total"), F.col("_whole"))).alias("percentual_do_total"),
    )


def spend_rankings(expenses: DataFrame, by: Sequence[str]) -> dict[str, DataFrame]:
    rankings = {
        "por_categoria": spend_ranking(expenses, by, "categoria"),
        "por_fornecedor": spend_ranking(expenses, by, "fornecedor"),
    }
    if "produto" in expenses.columns:
        rankings["por_produto"] = spend_ranking(expenses, by, "produto")
    return rankings


def all_rankings(expenses: DataFrame, by: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """The rankings of several dimensions in one pass over the ledger, in long form."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dimensao"), F.col(d).alias("nome")) for d in dimensions])
    ).alias("_d")
    long = expenses.select(*by, "valor", pairs).select(*by, "valor", "_d.dimensao", "_d.nome")
    totals = long.groupBy(*by, "dimensao", "nome").agg(
        F.sum("valor").alias("total"), F.count("valor").alias("quantidade")
    )
    placed = ranked(
        totals, [*by, "dimensao"], [F.desc("total"), F.asc("nome")], measure="total", total="_whole"
    )
    return placed.select(
        *by, "dimensao", "posicao", "nome", "total", "quantidade",
        round_scaled(share_of(F.col("total"), F.col("_whole"))).alias("percentual_do_total"),
    )
