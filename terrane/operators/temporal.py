"""Change between periods: turnover of cells, and the status of each species in each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import ratio
from terrane.operators.facts import periods_of

#: Status by presence in the first, second and third period (fixed labels).
STATUS = {
    (1, 1, 1): "Présence continue jusqu'à aujourd'hui",
    (1, 0, 1): "Colonisation 2011-2024",
    (1, 0, 0): "Disparition 1801-1990",
    (1, 1, 0): "Disparition 1991-2011",
    (0, 1, 1): "Colonisation 1991-2010",
    (0, 0, 1): "Colonisation 2011-2024",
    (0, 1, 0): "Présence 1991-2010 mais absent aujourd'hui",
}


def in_period(column: Column, k: int) -> Column:
    return F.coalesce(F.startswith(column, F.lit(f"Période {k}:")), F.lit(False))


def turnover(facts: DataFrame, cell: str = "cell", species: str = "species_id", period: str = "period") -> DataFrame:
    """By cell: rows, species in period 1, in 2, in both, in one alone; percent lost of period 1, percent new of all rows.

    One sum by cell and species and one by cell.
    """
    flag = lambda k: F.max(in_period(F.col(period), k).cast("int"))
    pairs = facts.dropna(subset=[cell, species]).groupBy(cell, species).agg(flag(1).alias("p1"), flag(2).alias("p2"), F.count("*").alias("rows"))
    both = F.col("p1") * F.col("p2")
    out = pairs.groupBy(cell).agg(F.sum("rows").alias("n_total"), F.sum("p1").alias("n_p1"), F.sum("p2").alias("n_p2"), F.sum(both).alias("n_p1_and_p2"))
    lost, new = F.col("n_p1") - F.col("n_p1_and_p2"), F.col("n_p2") - F.col("n_p1_and_p2")
    return out.withColumns({"n_p1_not_p2": lost, "n_p2_not_p1": new, "rate_lost": ratio(lost, "n_p1") * 100, "rate_new": ratio(new, "n_total") * 100})


def status_of(periods: Column, labels: dict[tuple[int, int, int], str] = STATUS) -> Column:
    """The status of a list of period labels; null if it holds none of the first three."""
    holds_period = lambda k: F.exists(periods, lambda p: in_period(p, k)).cast("int")
    seen = [holds_period(k) for k in (1, 2, 3)]
    out = F.lit(None).cast("string")
    for key, label in labels.items():
        holds = (seen[0] == key[0]) & (seen[1] == key[1]) & (seen[2] == key[2])
        out = F.when(holds, F.lit(label)).otherwise(out)
    return out


def status_map(facts: DataFrame, cell: str = "cell", species: str = "species_id") -> DataFrame:
    """cell, species, periods, status."""
    return periods_of(facts, cell, species).withColumn("status", status_of(F.col("periods")))


def two_periods(rows: DataFrame, old: list[str], labels: tuple[str, str], period: str = "period") -> DataFrame:
    """Periods renamed to two: those of ``old`` to the first label, other known ones to the second."""
    return rows.withColumn(period, F.when(F.col(period).isin(old), F.lit(labels[0])).when(F.col(period).isNotNull(), F.lit(labels[1])))
