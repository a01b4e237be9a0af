"""Cohorts: transactions chosen by table, time, shape and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deps import classify
from .log import restrict, tracked_writes


def select_cohort(history: DataFrame, *, table: str | None = None, fingerprint: str | None = None, since=None, until=None, predicate: Column | None = None) -> DataFrame:
    """Per transaction with a matching row: matching changes, first and last time, and least fingerprint where the log has one.

    The predicate is over after-images, so deletes never match one.
    """
    rows = restrict(tracked_writes(history), table=table, fingerprint=fingerprint, since=since, until=until)
    if predicate is not None:
        rows = rows.filter(predicate)
    return rows.groupBy("txid").agg(F.count("*").alias("ops"), F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_at"), *[F.min("fingerprint").alias("fingerprint")] * ("fingerprint" in history.columns))


def cohort_classes(history: DataFrame, read_set: DataFrame, cohort: DataFrame) -> DataFrame:
    """The cohort with the classification of each member."""
    return cohort.join(classify(history, read_set).select("txid", "classification"), "txid")


def preview_cohort(history: DataFrame, read_set: DataFrame, cohort: DataFrame) -> DataFrame:
    classed = cohort_classes(history, read_set, cohort)
    return classed.agg(F.count("*").alias("txn_count"), F.count_if(F.col("classification") == "clean").alias("clean"), F.count_if(F.col("classification") == "dependent").alias("dependent"))
