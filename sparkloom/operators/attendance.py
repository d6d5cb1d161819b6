"""The attendance survey as columns: cleaning, career classes, flags, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of careers, replaced one after the other wherever they occur; stems of the sciences.
CAREERS = [
    ("ciencias de la computacion", "ciencias de la computación"), ("ingenieria de software", "ingeniería de software"), ("ingenieria de sistemas", "ingeniería de sistemas"),
    ("ingeniera de sistemas", "ingeniería de sistemas"), ("ingeniería física", "física"),
]
STEM = ["ingeniería", "computación", "física", "ciberseguridad", "artificial"]


def flag(c: Column) -> Column:
    """1 or 0 of the literals VERDADERO and FALSO; anything else is null."""
    return F.when(c == "VERDADERO", 1).when(c == "FALSO", 0)


def clean_career(c: Column) -> Column:
    """Trimmed, lower case, one spelling; null counts as empty."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), CAREERS, F.lower(F.trim(F.coalesce(c, F.lit("")))))


def career_class(career: Column) -> Column:
    return F.when(reduce(Column.__or__, (career.contains(k) for k in STEM)), "STEM").otherwise("No STEM")


def with_flags(df: DataFrame, days: list[str], commitments: list[str]) -> DataFrame:
    """Adds total attendance, dropping out after the first day, and the number of commitments that aren't empty."""
    d = [F.coalesce(F.col(x).cast("int"), F.lit(0)) for x in days]
    filled = [(F.coalesce(F.trim(x), F.lit("")) != "").cast("int") for x in commitments]
    only_first = reduce(Column.__and__, [d[0] == 1, *(x == 0 for x in d[1:])])
    return df.withColumns({"total": reduce(Column.__add__, d), "dropout": only_first.cast("int"), "commitment_days": reduce(Column.__add__, filled) if filled else F.lit(0)})


def day_sums(df: DataFrame, days: list[str]) -> DataFrame:
    """How many attended each day; one row."""
    return df.agg(*(F.coalesce(F.sum(F.coalesce(F.col(x).cast("int"), F.lit(0))), F.lit(0)).alias(x) for x in days))
