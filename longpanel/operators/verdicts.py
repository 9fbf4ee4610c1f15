"""Verdict rules: plain CASE logic over summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def improvement(relative: Column, high: Column) -> Column:
    """Supported when the change and its whole interval are below zero."""
    return F.when((relative < 0) & (high < 0), "supported").when(relative < 0, "direction only").otherwise("not supported")


def reliability(sb: Column, low: Column, least: float = 0.5, floor: float = 0.2) -> Column:
    return F.when((sb >= least) & (low > floor), "reliable").when(sb >= least, "uncertain").otherwise("unreliable")


def against_null(p: Column, alpha: float = 0.0125) -> Column:
    return F.when(p <= alpha, "beyond the null").otherwise("within the null")


def future_gain(gain_percent: Column, high: Column, r: Column, p: Column, alpha: float = 0.0125) -> Column:
    return F.when((gain_percent > 10) & (high < 0) & (r > 0) & (p <= alpha), "predictable").otherwise("not predictable")
