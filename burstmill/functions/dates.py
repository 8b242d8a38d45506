"""Dates as the burst catalogue, file names and job documents spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings, tried in this order.
FORMATS = ("yyyy-M-d", "yyyyMMdd", "yyyy-M-d'T'H:m:s'Z'", "yyyyMMdd'T'HHmmss", "yyyy-M-d'T'H:m:s.SSSSSS'Z'", "yyyy-M-d'T'H:m:s.SSS'Z'")


def try_parse_date(text: Column) -> Column:
    """The time that text spells, null if it fits none of the formats."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    """try_parse_date, which fails the job where a text fits none; null stays null."""
    wrong = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp_ntz")
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(try_parse_date(text), wrong))


def start_of(text: Column) -> Column:
    """A date alone begins at midnight; a text with a time stays."""
    return F.when(text.contains("T"), text).otherwise(F.concat(text, F.lit("T00:00:00Z")))


def end_of(text: Column) -> Column:
    """A date alone ends at 23:59:59; a text with a time stays."""
    return F.when(text.contains("T"), text).otherwise(F.concat(text, F.lit("T23:59:59Z")))


def iso_z(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def band_date(d: Column) -> Column:
    """As in band names: 09Aug2024."""
    return F.date_format(d, "ddMMMyyyy")


def file_time(t: Column) -> Column:
    """As in file names: 20240809T170739."""
    return F.date_format(t, "yyyyMMdd'T'HHmmss")


def folder_time(path: Column) -> Column:
    """The third `_` token of the folder that holds the file."""
    return F.get(F.split(F.element_at(F.split(path, "/"), F.lit(-2)), "_"), F.lit(2))


def folder_date(path: Column) -> Column:
    return F.to_date(F.substring(folder_time(path), 1, 8), "yyyyMMdd")


def product_date(name: Column) -> Column:
    """The sixth `_` token of a product's name, its start day."""
    return F.to_date(F.substring(F.get(F.split(name, "_"), F.lit(5)), 1, 8), "yyyyMMdd")
