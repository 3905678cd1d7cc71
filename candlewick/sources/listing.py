"""Bucket listings (XML pages) to a download manifest, and the selections a
loader makes from it (S8, F9, F10, J9)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("Prefix", T.StringType()),
    T.StructField("Contents", T.ArrayType(T.StructType([
        T.StructField("Key", T.StringType()), T.StructField("LastModified", T.StringType())]))),
    T.StructField("IsTruncated", T.BooleanType()),
    T.StructField("NextMarker", T.StringType()),
])


def parse_listing(pages: DataFrame, value_col: str = "value") -> DataFrame:
    """Listing pages (one XML document per row) to (prefix, key, symbol,
    last_modified). The symbol is the third part from the end of the prefix
    ('.../klines/<SYMBOL>/<interval>/')."""
    doc = pages.select(F.from_xml(F.col(value_col), LISTING).alias("d"))
    rows = doc.select(F.col("d.Prefix").alias("prefix"), F.explode("d.Contents").alias("c"))
    return rows.select(
        "prefix",
        F.col("c.Key").alias("key"),
        F.element_at(F.split("prefix", "/"), -3).alias("symbol"),
        F.to_timestamp_ntz(F.col("c.LastModified"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("last_modified"),
    )


SYMBOL_LISTING = T.StructType([
    T.StructField("Prefix", T.StringType()),
    T.StructField("CommonPrefixes", T.ArrayType(T.StructType([T.StructField("Prefix", T.StringType())]))),
])


def list_symbols(pages: DataFrame, value_col: str = "value") -> DataFrame:
    """Distinct symbols of a folder listing (S8): the last part of each common prefix
    ('.../klines/<SYMBOL>/'), over all pages of the listing."""
    doc = pages.select(F.from_xml(F.col(value_col), SYMBOL_LISTING).alias("d"))
    prefix = F.rtrim(F.col("p.Prefix"), F.lit("/"))
    return (doc.select(F.explode("d.CommonPrefixes").alias("p"))
            .select(F.element_at(F.split(prefix, "/"), -1).alias("symbol")).distinct())


def with_local_path(manifest: DataFrame, root: str) -> DataFrame:
    """Where a downloaded manifest entry belongs: ``<root>/<daily|monthly>_klines/<SYMBOL>/<file>``."""
    kind = F.regexp_extract("prefix", r"/(daily|monthly)/", 1)
    name = F.element_at(F.split("key", "/"), -1)
    return manifest.withColumn("local_path", F.concat(
        F.lit(root.rstrip("/") + "/"), kind, F.lit("_klines/"), F.col("symbol"), F.lit("/"), name))


def select_daily(manifest: DataFrame, marker_day: _dt.date, start: _dt.date | None = None) -> DataFrame:
    """Daily CHECKSUM keys listed after the marker ``<prefix><SYM>-<iv>-<marker_day - 1>.zip.CHECKSUM``
    (listing order is key order) whose file date is on/after ``start``; keys
    without a date pass (F9)."""
    key = F.col("key")
    name_head = F.regexp_extract(key, r"^(.*-)\d{4}-\d{2}-\d{2}\.zip\.CHECKSUM$", 1)
    marker = F.concat(name_head, F.lit((marker_day - _dt.timedelta(days=1)).isoformat()), F.lit(".zip.CHECKSUM"))
    file_date = F.to_date(F.regexp_extract(key, r"(\d{4}-\d{2}-\d{2})", 1))
    dated_ok = F.lit(True) if start is None else F.coalesce(file_date >= F.lit(start), F.lit(True))
    after_marker = F.when(name_head == "", F.lit(True)).otherwise(key > marker)
    return manifest.filter(key.endswith("CHECKSUM") & after_marker & dated_ok)


def select_monthly(manifest: DataFrame, start_month: str, end_month: str) -> DataFrame:
    """Monthly CHECKSUM keys whose 'YYYY-MM' (7 characters ending 13 before the
    end of the key) lies in [start_month, end_month] (F10)."""
    month = F.substring("key", -20, 7)
    return manifest.filter(F.col("key").endswith("CHECKSUM") & month.between(F.lit(start_month), F.lit(end_month)))


def stale_or_missing(manifest: DataFrame, local: DataFrame) -> DataFrame:
    """Manifest entries to fetch: no local copy under the same file name, or
    the local copy is older than the remote one (J9).

    ``local`` has (file_name, local_mtime)."""
    m = manifest.withColumn("file_name", F.element_at(F.split("key", "/"), -1))
    x = m.join(local.select("file_name", "local_mtime"), "file_name", "left")
    need = F.col("local_mtime").isNull() | (F.col("local_mtime") < F.col("last_modified"))
    return x.filter(need).withColumn("reason", F.when(F.col("local_mtime").isNull(), "missing").otherwise("stale"))
