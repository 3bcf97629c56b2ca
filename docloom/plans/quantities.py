"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.units import equal_in_other_units, identities, quantities
from docloom.session import read


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of spec and table_row as a number in the common unit of its dimension, or unknown."""
    return quantities(read(spark, sf_dir, "spec"), read(spark, sf_dir, "table_row"), read(spark, sf_dir, "unit_ref"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one book and subject in different units that say the same."""
    return equal_in_other_units(quantities(read(spark, sf_dir, "spec"), read(spark, sf_dir, "table_row"), read(spark, sf_dir, "unit_ref")))


def p3_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each book and pair of spellings the units under which values and pages agree."""
    return identities(read(spark, sf_dir, "spec"))


QUERIES = {f.__name__: f for f in (p3_found, p3_values, p3_identities)}
SQL: dict[str, str] = {}
