"""Bar payloads to BAR_SCHEMA rows: REST kline arrays (S4), streamed kline
messages (S5) and zipped CSV archives (S3) with checksum verification (J8)
and the monthly/daily de-duplication (W2).

Only listing and reading of landed files run in Python (``mapInArrow``);
parsing, casting and de-duplication are JVM expressions.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.scalars import avg_price, epoch_to_time
from candlewick.schema import BAR_COLUMNS

# Column order of a 12-field kline record (REST array and CSV line).
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_num",
    "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume", "ignore",
]

_DOUBLE_FIELDS = ["open", "high", "low", "close", "volume", "quote_volume",
                  "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume"]


def _typed(fields: dict[str, Column], symbol: Column) -> DataFrame:
    """Projection list from raw text fields to BAR_SCHEMA columns."""
    cols = {
        "open_time": epoch_to_time(fields["open_time"]),
        "symbol": symbol,
        **{c: fields[c].cast("double") for c in _DOUBLE_FIELDS},
        "trade_num": fields["trade_num"].cast("double").cast("int"),
    }
    cols["avg_price"] = avg_price(cols["quote_volume"], cols["volume"])
    return [cols[c].alias(c) for c in BAR_COLUMNS]


# ---------------------------------------------------------------------------- S4

def parse_rest_bars(pages: DataFrame, value_col: str = "value", symbol_col: str = "symbol") -> DataFrame:
    """REST kline pages (one JSON array of 12-element arrays per row, plus the
    requested symbol) to bars. close_time and the ignore field are dropped;
    numbers and numeric strings both arrive as text and are cast."""
    k = pages.select(F.col(symbol_col).alias("_sym"),
                     F.explode(F.from_json(F.col(value_col), "array<array<string>>")).alias("k"))
    fields = {name: F.get(F.col("k"), i) for i, name in enumerate(KLINE_FIELDS)}
    return k.select(*_typed(fields, F.col("_sym")))


# ---------------------------------------------------------------------------- S5

# The kline object mixes keys that differ only in case (t/T, v/V, q/Q), and
# Spark resolves struct fields case-insensitively, so it is read as a map.
STREAM_MESSAGE = T.StructType([T.StructField("stream", T.StringType()),
                               T.StructField("data", T.StructType([
                                   T.StructField("e", T.StringType()), T.StructField("s", T.StringType()),
                                   T.StructField("k", T.MapType(T.StringType(), T.StringType()))]))])


def parse_stream_bars(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Kline stream messages to closed bars. A message counts only when it
    parses, carries ``data`` with event type 'kline' and a kline whose closed
    flag ``x`` is true; everything else (unclosed updates, other event types,
    malformed text) is dropped. Works on batch and streaming frames."""
    m = messages.select(F.from_json(F.col(value_col), STREAM_MESSAGE).alias("m"))
    kk = F.col("m.data.k")
    closed = F.lower(F.element_at(kk, F.lit("x"))) == F.lit("true")
    k = m.filter((F.col("m.data.e") == "kline") & kk.isNotNull() & F.coalesce(closed, F.lit(False)))
    key = {"open_time": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v",
           "quote_volume": "q", "trade_num": "n", "taker_buy_base_asset_volume": "V",
           "taker_buy_quote_asset_volume": "Q"}
    fields = {name: F.element_at(kk, F.lit(k)) for name, k in key.items()}
    return k.select(*_typed(fields, F.col("m.data.s")))


# ---------------------------------------------------------------------------- S3, W2, J8

#: Characters of CSV text that leave the unzip step together.
_CHUNK_CHARS = 4_000_000


def _unzip_text(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """The text of a zip in chunks of whole lines, so one large file never has to fit in a
    task's memory as one frame. Lines are cut and parsed by Spark."""
    def chunk_of(text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], ["path", "chunk"])

    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        for member in zf.namelist():
            with zf.open(member) as fh:
                text, rest = io.TextIOWrapper(fh, encoding="utf-8"), ""
                while chunk := text.read(_CHUNK_CHARS):
                    whole, cut, rest = (rest + chunk).rpartition("\n")
                    if cut:
                        yield chunk_of(whole)
                if rest:
                    yield chunk_of(rest)


# -- landed files: folders are listed and files read by tasks, so neither names nor contents pass
# through the driver, however many there are

_FOLDERS = "path string, own boolean"                #: own: only the files in the folder itself
_FILES = "path string, modified timestamp, length long, sidecar boolean"
_SIDECAR = ".CHECKSUM"


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, name in it, what turns a name into a path again) of a path of any scheme."""
    if "://" not in path or path.startswith("file://"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:"), "file://"
    store, name = fs.FileSystem.from_uri(path)
    return store, name, path[:path.rindex(name)]


def _seen(name: str) -> bool:
    """Whether Spark's readers would look at a file or folder of that name."""
    return not name.startswith(("_", "."))


def _subfolders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: the folders in folders, a row each, and each of these once more for its own files."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name, prefix = _store(path)
            found = store.get_file_info(fs.FileSelector(name))
            out = [prefix + i.path for i in found if i.type == fs.FileType.Directory and _seen(i.base_name)]
            own = [False] * len(out)
            if any(i.type == fs.FileType.File for i in found):
                out, own = [*out, path], [*own, True]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(own, pa.bool_())], ["path", "own"])


def _list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: the files in folders and all that lies below them, and whether a checksum lies beside each."""
    for batch in batches:
        for path, own in zip(batch.column("path").to_pylist(), batch.column("own").to_pylist()):
            store, name, prefix = _store(path)
            found = [i for i in store.get_file_info(fs.FileSelector(name, recursive=not own))
                     if i.type == fs.FileType.File and all(map(_seen, i.path[len(name):].strip("/").split("/")))]
            names = {i.path for i in found}
            yield pa.RecordBatch.from_arrays(
                [pa.array([prefix + i.path for i in found], pa.string()),
                 pa.array([i.mtime_ns // 1_000_000 * 1000 for i in found], pa.timestamp("us", "UTC")),
                 pa.array([i.size for i in found], pa.int64()), pa.array([i.path + _SIDECAR in names for i in found], pa.bool_())],
                ["path", "modified", "length", "sidecar"])


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length, sidecar) of every file under ``root``, by tasks: one lists the root, one each
    folder in it, and the folders in those (one a symbol) are dealt to all. No content is read."""
    tasks = _listing_tasks(spark)            # a given number, or folders (small rows) would be put into one task
    folders = (spark.createDataFrame([(root.rstrip("/"), False)], _FOLDERS).mapInArrow(_subfolders, _FOLDERS)
               .repartition(tasks, "path"))
    below = folders.filter("NOT own").mapInArrow(_subfolders, _FOLDERS).union(folders.filter("own"))
    return below.repartition(tasks, "path").mapInArrow(_list_files, _FILES)


def _listing_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _read(path: str) -> bytes:
    store, name, _ = _store(path)
    with store.open_input_stream(name) as f:
        return f.read()


def _expected(path: str, sidecar: bool) -> str | None:
    """The SHA-256 that a zip's sidecar names: its first word."""
    words = _read(path + _SIDECAR).decode().split() if sidecar else []
    return words[0].lower() if words else None


def _digests(with_content: bool):
    """Task code: the expected digest of each zip and, if wanted, that of its content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sidecars = batch.column("path").to_pylist(), batch.column("sidecar").to_pylist()
            expected = pa.array([_expected(*z) for z in zip(paths, sidecars)], pa.string())
            actual = pa.array([hashlib.sha256(_read(p)).hexdigest() if with_content else None for p in paths], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("modified"), batch.column("length"),
                                              batch.column("sidecar"), expected, actual],
                                             ["path", "modified", "length", "sidecar", "expected", "actual"])
    return run


def zip_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length, sidecar) of every *.zip under ``root``; no content is read."""
    return listed_files(spark, root).filter(F.col("path").endswith(".zip"))


def zip_digests(zips: DataFrame, with_content: bool) -> DataFrame:
    """Zips with the digest ``expected`` by their sidecars and, if wanted, the ``actual`` one of their contents."""
    return zips.select("path", "modified", "length", "sidecar").mapInArrow(
        _digests(with_content), f"{_FILES}, expected string, actual string")


def _unzip(verified_only: bool):
    """Task code: the text of each zip, of verified ones only if so wanted; a zip is read once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sidecar in zip(batch.column("path").to_pylist(), batch.column("sidecar").to_pylist()):
                content = _read(path)
                if not verified_only or hashlib.sha256(content).hexdigest() == _expected(path, sidecar):
                    yield from _unzip_text(path, content)
    return run


def zip_lines(spark: SparkSession, root: str, verified_only: bool = False, files: DataFrame | None = None) -> DataFrame:
    """(path, line, fields) of every non-empty CSV line of the zips under ``root`` (only
    those in ``files``, rows of ``zip_files``, if given), header rows (first field 'open_time') left out.

    With ``verified_only`` a zip is read only when its content hashes to its
    sidecar's checksum; the hash is taken in the same scan."""
    zips = zip_files(spark, root) if files is None else files.repartition(_listing_tasks(spark), "path")
    lines = (zips.select("path", "sidecar").mapInArrow(_unzip(verified_only), "path string, chunk string")
             .select("path", F.explode(F.split("chunk", "\n")).alias("line"))
             .select("path", F.trim(F.regexp_replace("line", "\r$", "")).alias("line")).filter(F.col("line") != ""))
    return (lines.withColumn("fields", F.split("line", ","))
            .filter(F.col("fields")[0] != "open_time"))


def rejected_lines(spark: SparkSession, root: str, verified_only: bool = False) -> DataFrame:
    """(path, line) of CSV lines that do not have the twelve fields of a kline record:
    what ``read_zip_csv`` leaves out."""
    return (zip_lines(spark, root, verified_only).filter(F.size("fields") != len(KLINE_FIELDS))
            .select("path", "line"))


def read_zip_csv(spark: SparkSession, root: str, verified_only: bool = False, files: DataFrame | None = None) -> DataFrame:
    """All CSV bars from zips under ``root`` (only those in ``files``, if given) with source
    path, before de-duplication.

    The symbol is the folder holding the zip; daily files rank above monthly
    ones and, within a kind, later file dates rank higher (``source_rank``).
    Lines with another number of fields than a kline record are left to
    ``rejected_lines``.
    """
    lines = zip_lines(spark, root, verified_only, files).filter(F.size("fields") == len(KLINE_FIELDS))
    fields = {name: F.col("fields")[i] for i, name in enumerate(KLINE_FIELDS)}
    symbol = F.regexp_extract("path", r"/([^/]+)/[^/]+\.zip$", 1)
    daily = F.col("path").contains("/daily_klines/")
    date_key = F.regexp_replace(F.regexp_extract("path", r"-(\d{4}-\d{2}(-\d{2})?)\.zip$", 1), "-", "")
    date_key = F.when(F.length(date_key) == 6, F.concat(date_key, F.lit("00"))).otherwise(date_key).cast("long")
    rank = F.when(daily, F.lit(2)).otherwise(F.lit(1)).cast("long") * F.lit(100_000_000) + date_key
    return lines.select(*_typed(fields, symbol), rank.alias("source_rank"))


def dedup_bars(bars: DataFrame, rank_col: str = "source_rank") -> DataFrame:
    """One bar per (symbol, open_time): the copy with the highest ``rank_col``
    wins (daily files over monthly ones) (W2).

    Resolved with per-column ``max_by`` over a numeric rank, so the plan is a
    hash aggregate on the full key (no sort, no hot keys)."""
    values = [c for c in BAR_COLUMNS if c not in ("open_time", "symbol")]
    out = bars.groupBy("symbol", "open_time").agg(*[F.max_by(c, rank_col).alias(c) for c in values])
    return out.select(*BAR_COLUMNS)


def ingest_zip_csv(spark: SparkSession, root: str) -> DataFrame:
    """Zipped CSV bars under ``root`` to de-duplicated bars (S3 + W2)."""
    return dedup_bars(read_zip_csv(spark, root))


def verify_checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, expected, actual, verified) per zip: SHA-256 of the content
    against the first token of the ``.CHECKSUM`` sidecar (J8). A zip without
    a sidecar is unverified."""
    out = zip_digests(zip_files(spark, root), with_content=True).select("path", "expected", "actual")
    return out.withColumn("verified", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))
