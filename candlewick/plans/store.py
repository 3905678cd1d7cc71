"""The bar store: an archive tier and a recent tier per market, plus
instruments and a small key/value state table, and the query API on top.

Storage layout under ``root`` (all Parquet, Hive-style partitions)::

    archive/market=<m>/interval=<n>m/period=<YYYY-MM>/part-*.parquet
    activity/market=<m>/interval=<n>m/period=<YYYY-MM>/part-*.parquet   (a row per symbol)
    recent/market=<m>/interval=<n>m/period=<YYYY-MM>/part-*.parquet
    instruments/market=<m>/part-*.parquet
    state/part-*.parquet                       (append-only key/value log)

A store can also be built over DataFrames (``frames=``) that carry a
``market`` column; the registered queries use that form over the fixtures.

Every query method returns a lazy DataFrame. Range and symbol predicates are
column expressions, so they reach the Parquet scan as pushed filters, and a
``period`` predicate derived from the range prunes partitions.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.timegrid import latest_complete_period, period_label
from candlewick.operators.resample import merge_tiers, resample
from candlewick.plans.joins import materialize, without_keys
from candlewick.schema import (
    BAR_COLUMNS, BAR_SCHEMA, QUERY_MARKETS, REDUNDANCY_HOURS, RESAMPLED_SCHEMA, SENTINEL_TIME,
    STATE_SCHEMA,
)
from candlewick.session import drop_path, own_job

log = logging.getLogger(__name__)

TIERS = ("archive", "recent")

# Bytes of bars that one file of a period is meant to hold, and the buckets of the
# symbol hash that a period has at most; a larger period is cut along its time as well, a
# small one gets as many buckets as leave SMALL_BYTES each.
FILE_BYTES, SMALL_BYTES, SYMBOL_BUCKETS = 128 << 20, 4 << 20, 8
# Bytes that a bar counts for before it is written.
BAR_BYTES = 96
# Row groups that a scan can share out among tasks and skip one by one.
ROW_GROUP_BYTES = 16 << 20
# The state log is compacted when it has grown to this many files.
STATE_FILES = 200


def to_time(value, default: _dt.datetime | None = None) -> _dt.datetime:
    """Naive UTC datetime with whole seconds from text, datetime or None."""
    if value is None:
        value = default
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value.strip().replace("T", " ").replace("Z", ""))
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return value.replace(microsecond=0)


def validate(market: str, interval: int, offset: int, base: int) -> None:
    """Reject a query before planning: unknown market, interval not dividing
    an hour, offset not a multiple of base or not below the interval."""
    if market not in QUERY_MARKETS:
        raise ValueError(f"unsupported market {market!r}; supported: {', '.join(QUERY_MARKETS)}")
    if not isinstance(interval, int) or interval <= 0 or interval > 60 or 60 % interval:
        raise ValueError("interval must be a positive number of minutes dividing 60")
    if offset >= interval or offset % base:
        raise ValueError(f"offset must be a multiple of {base} and less than the interval")


def choose_tier(begin: _dt.datetime, end: _dt.datetime, threshold: _dt.datetime) -> str:
    """'recent' when both ends are at/after the archive watermark, 'archive'
    when both are before, otherwise 'hybrid'."""
    if begin >= threshold and end >= threshold:
        return "recent"
    if begin < threshold and end < threshold:
        return "archive"
    return "hybrid"


def empty_resampled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESAMPLED_SCHEMA)


class BarStore:
    def __init__(self, spark: SparkSession, root: str | None = None, *, frames: dict | None = None,
                 base_minutes: int = 15, redundancy_hours: int = REDUNDANCY_HOURS,
                 period_months: int = 1, as_of: _dt.datetime | None = None):
        if root is None and frames is None:
            raise ValueError("give a storage root or frames")
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self.frames = frames or {}
        self.base = int(base_minutes)
        self.redundancy = _dt.timedelta(hours=redundancy_hours)
        self.period_months = int(period_months)
        self.as_of = as_of
        if self.redundancy < _dt.timedelta(minutes=self.base):
            raise ValueError("redundancy must cover at least one base interval")

    # ------------------------------------------------------------------ paths
    @property
    def interval_label(self) -> str:
        return f"{self.base}m"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def now(self) -> _dt.datetime:
        return to_time(self.as_of or _dt.datetime.now(_dt.timezone.utc))

    # ------------------------------------------------------------------ scans
    def tier(self, tier: str, market: str) -> DataFrame:
        """All bars of one tier and market (lazy; filters added later reach the scan)."""
        if tier not in TIERS:
            raise ValueError(f"unknown tier {tier!r}")
        if tier in self.frames:
            df = self.frames[tier]
            return df.filter(F.col("market") == F.lit(market)) if "market" in df.columns else df
        if self.root is None:
            return self.spark.createDataFrame([], BAR_SCHEMA).withColumn("market", F.lit(market))
        schema = T.StructType(BAR_SCHEMA.fields + [
            T.StructField("market", T.StringType()), T.StructField("interval", T.StringType()),
            T.StructField("period", T.StringType())])
        folder = self._folder(tier, market)      # only this market and interval is listed
        if path_exists(self.spark, folder):
            return self.spark.read.schema(schema).option("basePath", self.path(tier)).parquet(folder)
        return self.spark.createDataFrame([], schema)          # an absent tier reads as empty

    def _folder(self, tier: str, market: str) -> str:
        return f"{self.path(tier)}/market={market}/interval={self.interval_label}"

    def _period_filter(self, df: DataFrame, begin: _dt.datetime | None, end: _dt.datetime | None) -> DataFrame:
        if "period" not in df.columns:
            return df
        if begin is not None:
            df = df.filter(F.col("period") >= F.lit(_period_text(begin, self.period_months)))
        if end is not None:
            df = df.filter(F.col("period") <= F.lit(_period_text(end, self.period_months)))
        return df

    def scan(self, tier: str, market: str, begin=None, end=None, symbol: str | None = None,
             closed: bool = True) -> DataFrame:
        """Bars of a tier in [begin, end] (``closed``) or [begin, end) (F1, F2),
        optionally one symbol (F3). Partition pruning on ``period`` is added."""
        df = self.tier(tier, market)
        b = to_time(begin) if begin is not None else None
        e = to_time(end) if end is not None else None
        df = self._period_filter(df, b, e)
        t = F.col("open_time")
        if b is not None:
            df = df.filter(t >= F.lit(b))
        if e is not None:
            df = df.filter(t <= F.lit(e) if closed else t < F.lit(e))
        if symbol is not None:
            df = df.filter(F.col("symbol") == F.lit(symbol))
        return df.select(*BAR_COLUMNS)

    # ------------------------------------------------------------------ watermarks
    def periods(self, tier: str, market: str) -> list[str]:
        """Stored ``period`` partition values of a tier, from one directory glob
        (one entry per period, never a per-file listing)."""
        if tier in self.frames or self.root is None:
            return []
        return partition_values(self.spark, self._folder(tier, market), "period")

    def latest_period(self, tier: str, market: str) -> str | None:
        """Newest ``period`` partition value."""
        ps = self.periods(tier, market)
        return ps[-1] if ps else None

    def _archive_key(self, market: str) -> str:
        return f"{market}_{self.interval_label}_archive_time"

    def archive_watermark(self, market: str) -> _dt.datetime:
        """max(open_time) of the archive, the sentinel when it holds nothing.

        Read per query (so fresh exports count) from the state table, where
        every archive write records it; without a record only the newest
        period partition is scanned."""
        if self.root is not None and "archive" not in self.frames:
            stored = self.get_state_value(self._archive_key(market))
            if stored is not None:
                return to_time(stored)
        return self._scan_archive_watermark(market)

    def _scan_archive_watermark(self, market: str) -> _dt.datetime:
        df = self.tier("archive", market)
        newest = self.latest_period("archive", market)
        if newest is not None:
            df = df.filter(F.col("period") == F.lit(newest))
        value = df.agg(F.max("open_time")).first()[0]
        return value if value is not None else SENTINEL_TIME

    def recent_watermark(self, market: str) -> _dt.datetime:
        """Exclusive upper bound of committed recent bars, from the state table.

        The sentinel when missing or more than 30 days away from now."""
        raw = self.get_state_value(f"{market}_recent_time")
        if raw is None:
            return SENTINEL_TIME
        value = to_time(raw)
        if abs(value - self.now()) > _dt.timedelta(days=30):
            log.warning("%s recent watermark %s is more than 30 days from now", market, value)
            return SENTINEL_TIME
        return value

    def ready(self, market: str) -> str:
        """Latest committed time as text (Q9)."""
        return str(self.recent_watermark(market))

    # ------------------------------------------------------------------ query API (Q1, Q2, Q5, Q7)
    def get_market(self, market: str, interval: int, offset: int, begin=None, end=None,
                   symbol: str | None = None, order: bool = True, clip: bool = False) -> DataFrame:
        """Resampled bars of a market; the tier is chosen from the archive watermark.

        Defaults: end = now, begin = now - 90 days. The result is ordered by
        (resample_time, symbol) unless ``order`` is False.
        """
        validate(market, interval, offset, self.base)
        now = self.now()
        b = to_time(begin, now - _dt.timedelta(days=90))
        e = to_time(end, now)
        threshold = self.archive_watermark(market)
        strategy = choose_tier(b, e, threshold)
        if strategy != "recent" and threshold == SENTINEL_TIME:
            log.warning("%s archive holds no bars; answering from the recent tier", market)
            strategy = "recent"
        log.info("%s %s..%s: %s (threshold %s)", market, b, e, strategy, threshold)
        if strategy == "hybrid":
            out = self.resample_hybrid(market, interval, offset, b, e, threshold, symbol, clip=clip)
        else:
            bars = self.scan(strategy, market, b, e, symbol, closed=True)
            out = resample(bars, interval, offset, self.base)
        if not order:
            return out
        return out.orderBy("resample_time", "symbol")

    def get_symbol(self, market: str, symbol: str, interval: int, offset: int, begin=None, end=None,
                   order: bool = True) -> DataFrame:
        return self.get_market(market, interval, offset, begin, end, symbol=symbol, order=order)

    def resample_hybrid(self, market: str, interval: int, offset: int, begin, end,
                        threshold: _dt.datetime | None = None, symbol: str | None = None,
                        clip: bool = False) -> DataFrame:
        """Resample both tiers over ranges widened by the redundancy, then merge;
        the recent tier wins any (symbol, resample_time) both produce.

        archive branch: [begin - r, min(end, threshold) + r)   (half-open)
        recent branch:  [max(begin, threshold) - r, end + r]   (closed)
        Without ``clip`` up to ``r`` extra hours appear on either side.
        """
        b, e = to_time(begin), to_time(end)
        thr = threshold if threshold is not None else self.archive_watermark(market)
        r = self.redundancy
        hb, he = b - r, min(e, thr) + r
        rb, re_ = max(b, thr) - r, e + r
        arch = rec = None
        if hb < he:
            arch = resample(self.scan("archive", market, hb, he, symbol, closed=False), interval, offset, self.base)
        if rb < re_:
            rec = resample(self.scan("recent", market, rb, re_, symbol, closed=True), interval, offset, self.base)
        out = merge_tiers(arch, rec)
        if out is None:
            return empty_resampled(self.spark)
        if clip:
            out = out.filter(F.col("resample_time").between(F.lit(b), F.lit(e)))
        return out

    # ------------------------------------------------------------------ instruments (Q3)
    def instruments(self, market: str | None = None) -> DataFrame:
        if "instruments" in self.frames:
            df = self.frames["instruments"]
        else:
            df = self.spark.read.parquet(self.path("instruments"))
        return df.filter(F.col("market") == F.lit(market)) if market else df

    def get_instruments(self, market: str) -> DataFrame:
        if market not in QUERY_MARKETS:
            raise ValueError(f"unsupported market {market!r}")
        df = self.instruments(market)
        if df.isEmpty():
            raise ValueError(f"no instruments stored for market {market!r}")
        return df

    # ------------------------------------------------------------------ metadata (Q8)
    def describe_tables(self) -> DataFrame:
        """(table, market, rows) for every tier, the instruments and the state log
        (which belongs to no market), as one DataFrame."""
        parts = []
        for table in (*TIERS, "instruments", "state"):
            src = self.frames[table] if table in self.frames else (self._raw(table) if self.root else None)
            if src is None:
                continue
            market = F.col("market") if "market" in src.columns else F.lit(None).cast("string")
            parts.append(src.groupBy(market.alias("market")).agg(F.count(F.lit(1)).alias("rows"))
                         .select(F.lit(table).alias("table"), "market", "rows"))
        if not parts:
            return self.spark.createDataFrame([], "table string, market string, rows bigint")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _raw(self, tier: str) -> DataFrame | None:
        if not path_exists(self.spark, self.path(tier)):
            return None
        return self.spark.read.parquet(self.path(tier))

    def table_schema(self, table: str) -> DataFrame:
        """(column, type) rows of one stored table; unknown names raise."""
        src = self.frames.get(table) if table in self.frames else (self._raw(table) if self.root else None)
        if src is None:
            raise ValueError(f"unknown table {table!r}")
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in src.schema.fields]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean")

    def table_profile(self, table: str) -> DataFrame:
        """(column, type, non_null): every column of a table with its type and how many
        values it holds, from one aggregate over the table."""
        src = self.frames.get(table) if table in self.frames else (self._raw(table) if self.root else None)
        if src is None:
            raise ValueError(f"unknown table {table!r}")
        counts = src.agg(*[F.count(f"`{c}`").alias(c) for c in src.columns])
        types = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                   F.col(f"`{f.name}`").alias("non_null")) for f in src.schema.fields])
        return counts.select(F.inline(types))

    # ------------------------------------------------------------------ state (K3, K4)
    def state_log(self) -> DataFrame:
        if "state" in self.frames:
            return self.frames["state"]
        if self.root is None or not path_exists(self.spark, self.path("state")):
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(self.path("state"))

    def put_state(self, key: str, value: str, when: _dt.datetime | None = None) -> None:
        """Append one (key, value, updated_at) record; readers take the latest per key."""
        stamp = when or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        row = [(key, str(value), stamp)]
        self.spark.createDataFrame(row, STATE_SCHEMA).coalesce(1).write.mode("append").parquet(self.path("state"))
        if self._state_signature()[0] > STATE_FILES:
            self.compact_state()

    def compact_state(self) -> None:
        """Replace the state log's files by one that keeps each key's first and latest
        record. The new file is added before the old ones go, so a failure in
        between leaves records twice, which readers do not notice."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path("state"))
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        records = self.spark.read.schema(STATE_SCHEMA).parquet(*[f.toString() for f in old])
        kept = latest_state(records).union(latest_state(records, keep_first=True)).distinct()
        materialize(kept, "state").coalesce(1).write.mode("append").parquet(self.path("state"))   # a few rows a key
        for f in old:
            fs.delete(f, False)

    def _state_signature(self):
        """(file count, newest modification time) of the state folder: one
        metadata call; every state write changes it."""
        if self.root is None or "state" in self.frames:
            return None
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path("state"))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return (0, 0)
        stats = fs.listStatus(p)
        return (len(stats), max((st.getModificationTime() for st in stats), default=0))

    def get_state_value(self, key: str, keep_first: bool = False):
        """Latest (or first) value of one key: a top-1 over that key's records.

        Answers are cached against the state folder's signature, so an
        unchanged state costs a listing instead of a Spark job, and any new
        write is seen by the next call."""
        sig = self._state_signature()
        cache = self.__dict__.setdefault("_state_cache", {})
        ck = (key, keep_first)
        if sig is not None and cache.get(ck, (None, None))[0] == sig:
            return cache[ck][1]
        order = F.col("updated_at").asc() if keep_first else F.col("updated_at").desc()
        row = self.state_log().filter(F.col("key") == F.lit(key)).orderBy(order).select("value").first()
        value = None if row is None else row["value"]
        if sig is not None:
            cache[ck] = (sig, value)
        return value

    def check_base_interval(self) -> None:
        """Store the base interval on first use; refuse a different one later (K4)."""
        stored = self.get_state_value("base_interval", keep_first=True)
        if stored is None:
            self.put_state("base_interval", self.interval_label)
        elif stored != self.interval_label:
            raise ValueError(f"store holds {stored} bars, this session uses {self.interval_label}")

    # ------------------------------------------------------------------ maintenance (K1, K2, K5-K9)
    def write_archive(self, bars: DataFrame, market: str) -> int:
        """Add bars to the archive, one partition a period (K1); returns how many were given.

        Periods that ``bars`` does not touch stay as they are. A touched period
        that is already stored is merged: stored bars stay unless ``bars`` has
        the same (open_time, symbol), which replaces them (a corrected reload).
        Only touched periods are read and rewritten. ``bars`` is read twice, once for the
        keys of its periods; new and stored rows are shuffled once together, and compared only if
        there is a key that both have.
        """
        x = bars.select(*BAR_COLUMNS).withColumn("period", period_label("open_time", self.period_months))
        folder = self._folder("archive", market)
        rows, held, met = self._meet("archive", market, x)
        if not rows:
            return 0
        sizes = self._sizes(folder, rows, held)
        # the newest bar written is observed during the write itself (no extra pass)
        obs = Observation("archive_write")
        x = x.observe(obs, F.max("open_time").alias("max_time"))
        if held:
            before = self.tier("archive", market).filter(F.col("period").isin(*held)).select(*BAR_COLUMNS, "period")
            x = x.withColumn("_new", F.lit(True)).unionByName(before.withColumn("_new", F.lit(False)))
        out = dealt(x, sizes)
        if met:
            latest = F.rank().over(Window.partitionBy("symbol", "open_time", "_file").orderBy(F.desc("_new")))
            out = out.withColumn("_rank", latest).filter(F.col("_rank") == 1)
        else:
            out = out.sortWithinPartitions("symbol", "open_time")
        _write_periods(out, folder, "overwrite")
        written = obs.get.get("max_time")
        if written is not None:
            self.refresh_activity(market, sorted(rows))
            before = self.get_state_value(self._archive_key(market))
            top = max(written, to_time(before)) if before else written
            self.put_state(self._archive_key(market), top.isoformat(sep=" "))
        return sum(span.rows for span in rows.values())

    def _meet(self, tier: str, market: str, x: DataFrame) -> tuple[dict[str, Row], list[str], int]:
        """What a write of ``x`` (bars and their ``period``) comes upon: (rows, first and last time, copies of keys)
        a period; the periods that are stored already; how many of its keys are. Keys are
        counted as cells (``key_cells``); of the stored periods only the time of ``x`` is read."""
        stored, path = set(self.periods(tier, market)), f"{self.path('_cells')}/{uuid.uuid4().hex}"
        if not stored and tier == "archive":
            return period_spans(x), [], 0                                  # the archive keeps copies
        cells = key_cells(x, self.base)
        if not stored:
            return _cell_periods(cells), [], 0
        with own_job(self.spark):
            cells.write.parquet(path)                                      # keys of ``x`` are looked at twice
        cells = self.spark.read.schema(cells.schema).parquet(path)
        rows, met = _cell_periods(cells), 0
        held = sorted(stored & set(rows))
        if held:
            there = self.tier(tier, market).filter(F.col("period").isin(*held) & F.col("open_time").between(
                F.lit(min(rows[p].first for p in held)), F.lit(max(rows[p].last for p in held))))
            there = key_cells(there, self.base).select(*_CELL, F.col("mask").alias("_there"))
            with own_job(self.spark):
                met = cells.join(there, _CELL).agg(F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("_there"))))).first()[0] or 0
        drop_path(self.spark, path)
        return rows, held, met

    def _sizes(self, folder: str, rows: dict[str, Row], held: list[str]) -> dict[str, tuple]:
        """(bytes, first, last time) a period of what a write adds, the bytes with those stored already."""
        return {p: (span.rows * BAR_BYTES + (folder_bytes(self.spark, f"{folder}/period={p}") if p in held else 0), span.first, span.last)
                for p, span in rows.items()}

    def refresh_activity(self, market: str, periods: list[str]) -> None:
        """Summarise the symbols of archive periods anew (A7, A8): a row a symbol and period."""
        bars = self.tier("archive", market).filter(F.col("period").isin(*periods))
        traded = F.when(F.col("volume") > 0, F.col("open_time"))
        with own_job(self.spark):
            (bars.groupBy("market", "interval", "period", "symbol")
             .agg(F.min(traded).alias("first_candle"), F.max(traded).alias("last_candle"), F.sum("volume").alias("total_volume"))
             .repartition("market", "interval", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("market", "interval", "period").parquet(self.path("activity")))

    def activity(self, market: str) -> DataFrame:
        """(symbol, first_candle, last_candle, total_volume) of the archive, merged from the summaries
        of its periods: no bar is read. Periods written before there were summaries get theirs first."""
        folder = f"{self.path('activity')}/market={market}/interval={self.interval_label}"
        stored, held = self.periods("archive", market), partition_values(self.spark, folder, "period")
        lacking = sorted(set(stored) - set(held))
        if lacking:
            self.refresh_activity(market, lacking)
        if not stored:
            return self.spark.createDataFrame([], ACTIVITY_SCHEMA)
        rows = self.spark.read.schema(ACTIVITY_SCHEMA + ", period string").parquet(folder)
        return merge_activity(rows.filter(F.col("period").isin(*stored)))

    def append_recent(self, new: DataFrame, market: str) -> None:
        """Insert bars into the recent tier; on (open_time, symbol) conflict the
        stored bar stays (K2).

        The batch is read twice, once for the keys of its periods, so the stored side
        is read in the batch's periods and time only, however far apart they lie. If it has copies of a
        key, or keys that are stored, its rows and the stored keys are shuffled once together; of a
        key's copies in the batch the one with the smallest row hash counts, as in ``one_bar_per_key``."""
        x = new.select(*BAR_COLUMNS).withColumn("period", period_label("open_time", self.period_months))
        folder = self._folder("recent", market)
        rows, held, met = self._meet("recent", market, x)
        copies = sum(span.copies for span in rows.values())
        if met == sum(span.rows for span in rows.values()) - copies:
            return                                                         # nothing that is not stored
        sizes, order = self._sizes(folder, rows, held), [F.xxhash64(*BAR_COLUMNS)]
        if met:
            order = [F.desc("_stored"), *order]
            stored = self.tier("recent", market).filter(F.col("period").isin(*held)).select(*_KEY).filter(
                F.col("open_time").between(F.lit(min(rows[p].first for p in held)), F.lit(max(rows[p].last for p in held))))
            x = (x.withColumn("_stored", F.lit(False))
                 .unionByName(stored.withColumn("_stored", F.lit(True)), allowMissingColumns=True))
        # files are sorted by time in steps of CELL slots (latest bars, conflict checks), so pages and row groups prune on
        # open_time, and by symbol within a step, which packs the rows of idle symbols; step and hashed
        # symbol are one number, which the sort mostly compares without a look at the rows
        step = F.floor(F.unix_seconds(F.col("open_time").cast("timestamp")) / F.lit(CELL * self.base * 60))
        at = F.shiftleft(step, 30).bitwiseOR(F.xxhash64("symbol").bitwiseAND(F.lit((1 << 30) - 1)))
        fresh = dealt(x, sizes).withColumn("_at", at)
        if met or copies:
            first = F.row_number().over(Window.partitionBy("_at", "symbol", "open_time", "_file").orderBy(*order))
            fresh = fresh.withColumn("_first", first).filter(F.col("_first") == 1)
        else:
            fresh = fresh.sortWithinPartitions("_at", "symbol", "open_time")
        _write_periods(fresh.filter(~F.col("_stored")) if met else fresh, folder, "append")

    def compact_recent(self, market: str) -> None:
        """Rewrite the recent tier's periods, many small appended files each, as files
        sorted by (symbol, open_time), which prune on symbol as well."""
        folder, periods = self._folder("recent", market), self.periods("recent", market)
        if periods:
            bars, size = self.tier("recent", market), {p: folder_bytes(self.spark, f"{folder}/period={p}") for p in periods}
            spans = period_spans(bars)
            _write_periods(dealt(bars, {p: (size.get(p, 0), span.first, span.last) for p, span in spans.items()})
                           .sortWithinPartitions("symbol", "open_time"), folder, "overwrite")

    def commit_batch(self, bars: DataFrame, market: str, watermark: _dt.datetime) -> None:
        """Bars first, watermark last (K9). Plain Parquet has no multi-table
        transaction; a retry after a failure between the two writes re-inserts
        nothing (K2 skips stored keys) and then records the watermark, so the
        visible end state equals a single successful commit."""
        self.append_recent(bars, market)
        self.put_state(f"{market}_recent_time", to_time(watermark).isoformat(sep=" "))

    def replace_instruments(self, instruments: DataFrame, market: str) -> None:
        """Replace one market's instruments; other markets are untouched (K5)."""
        x = instruments.filter(F.col("market") == F.lit(market))
        x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("market").parquet(self.path("instruments"))

    def export_period(self, market: str, as_of: _dt.datetime | None = None,
                      retention_days: int = 7) -> dict | None:
        """Bring the archive up to the last period closed before ``as_of - retention``
        (K6), then expire recent rows older than its end minus one day (K7).

        Every recent bar before the period's end that the archive lacks is
        merged into it, whether the archive has none, a part or all of the
        period, and bars of older periods too; bars it has stay as they are.
        ``as_of`` defaults to the recent watermark (the newest committed bar),
        falling back to now when none is recorded."""
        if as_of is None:
            wm = self.recent_watermark(market)
            as_of = wm if wm != SENTINEL_TIME else self.now()
        cutoff = to_time(as_of) - _dt.timedelta(days=retention_days)
        row = self.spark.range(1).select(
            latest_complete_period(F.lit(cutoff), self.period_months).alias("p")).first()["p"]
        if row is None:
            return None
        start = _dt.datetime.combine(row["period_start"], _dt.time())
        end = _dt.datetime.combine(row["period_end"], _dt.time())
        exported = self.write_archive(self._not_archived(self.tier("recent", market), market, end), market) > 0
        self.expire_recent(market, end)
        return {"period_start": start, "period_end": end, "exported": exported}

    def _not_archived(self, bars: DataFrame, market: str, end: _dt.datetime) -> DataFrame:
        """Rows of ``bars`` before ``end`` whose (open_time, symbol) the archive lacks; the
        archive is read in the recent tier's periods only."""
        last = _period_text(end - _dt.timedelta(microseconds=1), self.period_months)
        periods = [p for p in self.periods("recent", market) if p <= last]
        old = bars.filter(F.col("period").isin(*periods) & (F.col("open_time") < F.lit(end)))
        held = sorted(set(periods) & set(self.periods("archive", market)))
        if not held:
            return old
        return without_keys(old, self.tier("archive", market).filter(F.col("period").isin(*held)), list(_KEY))

    def expire_recent(self, market: str, period_end: _dt.datetime) -> None:
        """Drop recent rows with open_time < period_end - 1 day that the archive holds (K7).

        A row that the archive lacks stays, whatever its age. Only period
        partitions holding expired rows are touched: partitions with survivors
        are rewritten (dynamic overwrite), partitions left empty are deleted.
        The day of overlap keeps the tiers overlapping, which the hybrid merge
        relies on. One writer at a time: if files have come to the affected periods
        since they were read, nothing is replaced and the job starts over; after
        three such turns it raises."""
        limit = to_time(period_end) - _dt.timedelta(days=1)
        last_label = _period_text(limit, self.period_months)
        affected_periods = [p for p in self.periods("recent", market) if p <= last_label]
        if not affected_periods:
            return
        folder = self._folder("recent", market)
        for turn in range(3):
            seen = period_files(self.spark, folder, affected_periods)
            affected = self.tier("recent", market).filter(F.col("period").isin(*affected_periods))
            late = affected.filter(F.col("open_time") >= F.lit(limit))
            # mostly none: only keys are compared, and rows are looked up for those that are lacking
            lacking = materialize(self._keys_not_archived(affected, market, affected_periods, limit), "lacking")
            if not lacking.isEmpty():
                late = late.unionByName(affected.filter(F.col("open_time") < F.lit(limit))
                                        .join(lacking.hint("merge"), list(_KEY), "left_semi").select(*late.columns))
            keep = materialize(late.groupBy("period").agg(F.count(F.lit(1)).alias("rows")), "keep")
            if period_files(self.spark, folder, affected_periods) != seen:
                continue
            survivors = [r.period for r in keep.select("period").collect()]
            if not survivors:
                break
            # survivors keep the order of their files, so nothing is dealt or sorted again
            staged = f"{self.path('_expiring')}/{uuid.uuid4().hex}"
            _write_periods(late, staged, "overwrite")
            if period_files(self.spark, folder, affected_periods) == seen:
                _replace_partitions(self.spark, staged, folder, survivors)
                break
            drop_path(self.spark, staged)
        else:
            raise RuntimeError(f"bars kept coming into {folder} while it was to expire")
        _delete_partitions(self.spark, self.path("recent"), market, self.interval_label,
                           [p for p in affected_periods if p not in survivors])

    def _keys_not_archived(self, bars: DataFrame, market: str, periods: list[str], end: _dt.datetime) -> DataFrame:
        """Keys of ``bars`` before ``end`` that the archive lacks; both sides meet as cells (``key_cells``)."""
        old = bars.filter(F.col("open_time") < F.lit(end))
        held = sorted(set(periods) & set(self.periods("archive", market)))
        if not held:
            return old.select(*_KEY)
        there = self.tier("archive", market).filter(F.col("period").isin(*held) & (F.col("open_time") < F.lit(end)))
        there = key_cells(there, self.base).select(*_CELL, F.col("mask").alias("_there"))
        left = (key_cells(old, self.base).join(there, _CELL, "left")
                .withColumn("_left", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_there", F.lit(0).cast("long")))))
                .filter(F.col("_left") != 0))
        bits = left.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(CELL - 1)))).filter(F.expr("shiftright(_left, _bit) & 1") == 1)
        micros = (F.col("_cell") * CELL + F.col("_bit")) * (self.base * 60_000_000) + F.col("_off")
        return bits.select("period", F.timestamp_micros(micros).cast("timestamp_ntz").alias("open_time"), "symbol")

    def bootstrap_recent(self, market: str, as_of: _dt.datetime | None = None, days: int = 30) -> _dt.datetime:
        """Seed the recent tier from the archive (K8): rows at or after the
        period boundary ``days`` before ``as_of`` minus one day, and the whole
        newest (partial) archive period, which moves to the recent tier however
        old it is. Returns the recent watermark (exclusive bound = newest bar +
        one base interval)."""
        from candlewick.functions.timegrid import period_cutoff
        now = to_time(as_of or self.now())
        cut = self.spark.range(1).select(period_cutoff(F.lit(now), days, self.period_months).alias("c")).first()["c"]
        cutoff = _dt.datetime.combine(cut, _dt.time()) - _dt.timedelta(days=1)
        newest = self.latest_period("archive", market)
        if newest is None:
            self.put_state(f"{market}_recent_time", SENTINEL_TIME.isoformat(sep=" "))
            return SENTINEL_TIME
        first = min(newest, _period_text(cutoff, self.period_months))
        seed = self.tier("archive", market).filter(
            (F.col("period") >= F.lit(first))
            & ((F.col("period") == F.lit(newest)) | (F.col("open_time") >= F.lit(cutoff))))
        self.append_recent(seed, market)
        last = seed.agg(F.max("open_time")).first()[0]
        for table in ("archive", "activity"):
            _delete_partitions(self.spark, self.path(table), market, self.interval_label, [newest])
        self.put_state(self._archive_key(market), self._scan_archive_watermark(market).isoformat(sep=" "))
        watermark = (last + _dt.timedelta(minutes=self.base)) if last else SENTINEL_TIME
        self.put_state(f"{market}_recent_time", watermark.isoformat(sep=" "))
        return watermark


# ---------------------------------------------------------------------- helpers

def _period_text(t: _dt.datetime, period_months: int) -> str:
    k = ((t.year - 2019) * 12 + (t.month - 1)) // period_months * period_months
    y, m = 2019 + k // 12, k % 12 + 1
    return f"{y:04d}-{m:02d}"


_KEY = ("period", "open_time", "symbol")


ACTIVITY_SCHEMA = "symbol string, first_candle timestamp_ntz, last_candle timestamp_ntz, total_volume double"


def merge_activity(*summaries: DataFrame) -> DataFrame:
    """One row a symbol from summaries (symbol, first_candle, last_candle, total_volume)."""
    rows = summaries[0]
    for more in summaries[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("symbol").agg(F.min("first_candle").alias("first_candle"), F.max("last_candle").alias("last_candle"),
                                      F.sum("total_volume").alias("total_volume"))


def layout(size: int) -> tuple[int, int]:
    """(buckets of the symbol hash, stretches of time) of a period of ``size`` bytes."""
    files = max(1, -(-size // FILE_BYTES), min(SYMBOL_BUCKETS, size // SMALL_BYTES))
    symbols = min(SYMBOL_BUCKETS, files)
    return symbols, -(-files // symbols)


def period_spans(bars: DataFrame) -> dict[str, Row]:
    """Rows, first and last time a ``period``: one row a period comes to the driver."""
    with own_job(bars.sparkSession):
        found = bars.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.min("open_time").alias("first"),
                                           F.max("open_time").alias("last")).collect()
    return {r["period"]: r for r in found}


#: Slots of a cell, as many as a number has bits besides its sign.
CELL = 63
_CELL = ["period", "symbol", "_cell", "_off"]


def key_cells(bars: DataFrame, base: int) -> DataFrame:
    """The keys of ``bars`` (with a ``period``): a row for each run of 63 slots in which a symbol has any, with a bit
    for each slot that it has (``mask``), its rows, first and last time. Exact: times off the grid have
    cells of their own, by their distance from it (``_off``)."""
    slot, micros = base * 60_000_000, F.unix_micros(F.col("open_time").cast("timestamp"))
    x = bars.select("period", "symbol", "open_time", F.pmod(micros, F.lit(slot)).alias("_off"), micros.alias("_micros"))
    x = x.withColumn("_slot", F.expr(f"(_micros - _off) DIV {slot}")).withColumn("_in", F.pmod("_slot", F.lit(CELL)))
    x = x.withColumns({"_cell": F.expr(f"(_slot - _in) DIV {CELL}"), "_bit": F.expr("shiftleft(1L, CAST(_in AS INT))")})
    return x.groupBy(*_CELL).agg(F.bit_or("_bit").alias("mask"), F.count(F.lit(1)).alias("rows"),
                                 F.min("open_time").alias("first"), F.max("open_time").alias("last"))


def _cell_periods(cells: DataFrame) -> dict[str, Row]:
    """Rows, first and last time and rows beyond one a key, of each ``period`` of some cells."""
    keys = F.coalesce(F.bit_count("mask").cast("long"), F.lit(1).cast("long"))
    with own_job(cells.sparkSession):
        found = cells.groupBy("period").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"),
                                            F.sum(F.col("rows") - keys).alias("copies")).collect()
    return {r["period"]: r for r in found}


def dealt(df: DataFrame, sizes: dict[str, tuple]) -> DataFrame:
    """Deal rows to tasks, one a file (column ``_file``).

    ``sizes``: (bytes, first, last time) a period; its files follow from the bytes (``layout``), without
    a sampling pass. A period is dealt to buckets of the symbol hash and, beyond
    ``SYMBOL_BUCKETS`` files, to stretches of the time that its rows have, so a symbol that holds a third
    of a large period is spread over all stretches; what lies outside goes to the first or last one. Small
    periods in a row share a task."""
    shape, files, shared = {}, 0, SMALL_BYTES + 1
    for p, (size, first, last) in sorted((kv for kv in sizes.items() if kv[0] is not None and kv[1][1] is not None), key=lambda kv: kv[0]):
        symbols, stretches = layout(size)
        shared = shared + size if symbols == stretches == 1 else SMALL_BYTES + 1
        if not files or shared > SMALL_BYTES:
            shared, start, files = size if symbols == stretches == 1 else shared, files, files + symbols * stretches
        low, high = (int(t.replace(tzinfo=_dt.timezone.utc).timestamp()) for t in (first, last))
        shape[p] = (start, symbols, stretches, low, max(1, -(-(high - low + 1) // stretches)))
    if not shape:
        return df.withColumn("_file", F.lit(0)).repartitionById(1, "_file")
    names = ("start", "symbols", "stretches", "low", "length")
    of = {p: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)]) for p, values in shape.items()}
    one = next(iter(of.values()))
    if len(of) > 1:
        one = F.coalesce(F.create_map(*[x for p, v in of.items() for x in (F.lit(p), v)])[F.col("period")], one)
    start, symbols, stretches, low, length = (one[n] for n in names)
    stretch = F.floor((F.unix_seconds(F.col("open_time").cast("timestamp")) - low) / length)
    file = (start + F.greatest(F.lit(0), F.least(stretch, stretches - 1)) * symbols
            + F.pmod(F.hash("symbol"), symbols)).cast("int")
    return df.withColumn("_file", F.coalesce(file, F.lit(0))).repartitionById(files, "_file")


def _write_periods(rows: DataFrame, folder: str, mode: str) -> None:
    """Write rows that ``dealt`` has dealt into the ``period`` partitions of a folder, in the order that they
    have; ``overwrite`` replaces the partitions that there are rows for. New files move in place only
    when the job is done, so ``rows`` may read the partitions that it replaces."""
    with own_job(rows.sparkSession):
        (rows.select(*BAR_COLUMNS, "period").write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("period").parquet(folder))


def period_files(spark: SparkSession, folder: str, periods: list[str]) -> set[str]:
    """Names of the files of some period partitions."""
    out = set()
    for period in periods:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/period={period}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            out |= {f"{period}/{st.getPath().getName()}" for st in fs.listStatus(path)}
    return out


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes under a folder, from one metadata call."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(path).getLength()) if fs.exists(path) else 0


def partition_values(spark: SparkSession, folder: str, column: str) -> list[str]:
    """Values of a folder's ``column=`` subfolders, from one directory glob."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{column}=*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(st.getPath().getName().split("=", 1)[1] for st in (fs.globStatus(pattern) or []) if st.isDirectory())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _replace_partitions(spark: SparkSession, staged: str, folder: str, periods: list[str]) -> None:
    """Put the ``period`` partitions of ``staged`` in place of those of ``folder``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in periods:
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{top}/period={p}") for top in (staged, folder))
        fs = old.getFileSystem(conf)
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise RuntimeError(f"{new.toString()} could not be moved to {old.toString()}")
    drop_path(spark, staged)


def _delete_partitions(spark: SparkSession, base: str, market: str, interval: str, periods: list[str]) -> None:
    """Remove whole period partitions through the Hadoop FileSystem API (works
    the same on HDFS, object stores and local disks)."""
    if not periods:
        return
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in periods:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/market={market}/interval={interval}/period={p}")
        path.getFileSystem(conf).delete(path, True)


def latest_state(log_df: DataFrame, keep_first: bool = False) -> DataFrame:
    """Current value per key of an append-only (key, value, updated_at) log;
    ``keep_first`` returns the first value ever written instead (K3)."""
    pick = F.min_by if keep_first else F.max_by
    edge = F.min if keep_first else F.max
    return log_df.groupBy("key").agg(pick("value", "updated_at").alias("value"),
                                     edge("updated_at").alias("updated_at"))


def one_bar_per_key(bars: DataFrame) -> DataFrame:
    """Copies of one (open_time, symbol) collapse to the copy with the smallest row
    hash: a deterministic choice made by a hash aggregate, combined map-side,
    so even a key repeated across a third of the batch never lands in one task."""
    values = [c for c in BAR_COLUMNS if c not in ("open_time", "symbol")]
    hashed = bars.select(*BAR_COLUMNS).withColumn("_h", F.xxhash64(*BAR_COLUMNS))
    return (hashed.groupBy("open_time", "symbol").agg(*[F.min_by(c, "_h").alias(c) for c in values])
            .select(*BAR_COLUMNS))


def rows_to_insert(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new``, one a key, whose (open_time, symbol) is not stored yet.
    The anti join shuffles on the full key, which has no hot values."""
    return without_keys(one_bar_per_key(new), existing, ["open_time", "symbol"])
