"""Files: listing, exports, text and catalogues. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions.times import scan_time
from chatloom.operators.privacy import text_lines
from chatloom.runtime import scratch_path
from chatloom.schema import EXPORT

INDEX_NAME = ".dedup_index.json"
#: Places for messages of one file in ``seq``.
PER_FILE = 1 << 32
# Endings of text files, and folders and files that a scan leaves out.
TEXT_ENDINGS = (".py", ".md", ".txt", ".yml", ".yaml", ".ini", ".cfg", ".toml", ".json", ".html", ".css", ".js", ".sh")
SKIPPED_FOLDERS = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "node_modules", "reports", "profiles", "output", "outputs", "tmp")
SKIPPED_FILES = ("scripts/privacy_scan.py", "config.json", "ui_config.json")


def hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discover(spark: SparkSession, inputs: list[str]) -> list[str]:
    """JSON files among the inputs: files as named, and those directly in a folder without its key index; each once, by
    path. Endings count in any letter case; what isn't there is left out."""
    found = set()
    for one in filter(None, inputs):
        path, fs = hadoop(spark, one)
        if not fs.exists(path):
            continue
        folder = fs.getFileStatus(path).isDirectory()
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if status.isFile() and name.lower().endswith(".json") and not (folder and name == INDEX_NAME):
                found.add(_plain(status.getPath().toString()))
    return sorted(found)


def _plain(path: str) -> str:
    return path.replace("file:///", "file:/", 1) if path.startswith("file:///") else path


def _decoded(name: str) -> Column:
    """A part of the files' metadata, without the escapes of an address."""
    return F.url_decode(F.replace(F.col(f"_metadata.{name}"), F.lit("+"), F.lit("%2B")))


def read_exports(spark: SparkSession, inputs: list[str], schema: str = EXPORT) -> DataFrame:
    """Messages of exported JSON arrays, with ``src_file, file_ord`` (place of the path) and ``seq`` (file and place in it).

    Items that are no objects are dropped; a file that is no array, or broken, gives no row. A field that a file lacks is
    null. One export is read by one task; large histories belong in ``read_lines``.
    """
    files = discover(spark, inputs)
    if not files:
        return spark.createDataFrame([], f"{schema}, src_file string, file_ord int, seq bigint")
    places = spark.createDataFrame(list(zip(files, range(len(files)))), "_path string, file_ord int")
    raw = spark.read.text(files, wholetext=True).select("value", F.regexp_replace(_decoded("file_path"), "^file:///", "file:/").alias("_path"), _decoded("file_name").alias("src_file"))
    items = F.from_json(F.when(F.col("value").rlike(r"\A\x{feff}?\s*\["), F.col("value")), "array<string>")
    rows = raw.join(places, "_path").select("src_file", "file_ord", F.posexplode(items).alias("_p", "_item")).filter(F.col("_item").startswith("{"))
    rows = rows.withColumn("_m", F.from_json("_item", schema)).filter("_m is not null")
    return rows.select("_m.*", "src_file", "file_ord", (F.col("file_ord").cast("bigint") * PER_FILE + F.col("_p")).alias("seq"))


def read_lines(spark: SparkSession, paths: str | list[str], schema: str = EXPORT) -> DataFrame:
    """Messages of JSON Lines, as written by appending; broken lines are dropped."""
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return spark.read.text(paths).select(parsed.alias("m")).filter("m._broken is null").select("m.*").drop("_broken")


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of CSV files with a header; fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).csv(paths, header=True, multiLine=True, quote='"', escape='"', emptyValue="")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The key index as ``key``: a table of keys, or a JSON list of them. Empty where there is none or it is broken."""
    p, fs = hadoop(spark, path)
    empty = spark.createDataFrame([], "key string")
    if not fs.exists(p):
        return empty
    if fs.getFileStatus(p).isDirectory():
        return spark.read.schema("key string").parquet(path)
    if p.getName()[0] in "._":  # readers pass over hidden files
        copy, there = hadoop(spark, scratch_path(spark, "index"))
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, there, copy, False, spark.sparkContext._jsc.hadoopConfiguration())
        path = copy.toString()
    keys = F.from_json("value", "array<string>")
    return spark.read.text(path, wholetext=True).select(F.explode(F.when(F.col("value").rlike(r"\A\s*\["), keys)).alias("key")).filter("key is not null").distinct()


def read_text(spark: SparkSession, base: str, endings: tuple[str, ...] = TEXT_ENDINGS, skipped: tuple[str, ...] = SKIPPED_FOLDERS, files: tuple[str, ...] = SKIPPED_FILES) -> DataFrame:
    """``file_path, line_no, line`` of the text files below a folder: those with one of the endings, outside the skipped
    folders and files. ``file_path`` is relative to the folder; bytes that are no UTF-8 are replaced."""
    root = _plain(str(hadoop(spark, base)[1].getFileStatus(hadoop(spark, base)[0]).getPath()))
    path = F.regexp_replace(_decoded("file_path"), "^file:///", "file:/")
    inner = F.substring(path, len(root) + 2, F.length(path))
    raw = spark.read.option("recursiveFileLookup", True).text(base, wholetext=True).select("value", inner.alias("file_path"))
    folders = F.slice(F.split("file_path", "/"), 1, F.size(F.split("file_path", "/")) - 1)
    ending = F.regexp_extract(F.col("file_path"), r"[^/](\.[^./]*)$", 1)
    some = raw.filter(ending.isin(*endings) & ~F.exists(folders, lambda d: d.isin(*skipped)) & ~F.col("file_path").isin(*files))
    return text_lines(some, ["file_path"], F.col("value"))


def latest_files(spark: SparkSession, roots: list[str], limit: int = 20) -> DataFrame:
    """``root, path, name, modified`` of the newest files below each root, hidden ones left out; no content is read. Roots
    that aren't there are left out."""
    out = None
    for root in roots:
        path, fs = hadoop(spark, root)
        if not fs.exists(path):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        name = F.substring_index("path", "/", -1)
        some = files.select(F.lit(root).alias("root"), "path", name.alias("name"), F.col("modificationTime").alias("modified")).filter(~F.col("name").startswith("."))
        some = some.orderBy(F.desc("modified"), "path").limit(limit)
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], "root string, path string, name string, modified timestamp") if out is None else out


def latest_by(df: DataFrame, group: Column, time: Column, name: Column, limit: int = 20) -> DataFrame:
    """``group, name, time, place`` of the newest names of each group, by name where times are equal. Names are made one
    row each first."""
    each = df.groupBy(group.alias("group"), name.alias("name")).agg(F.max(time).alias("time"))
    order = Window.partitionBy("group").orderBy(F.desc("time"), "name")
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def file_times(files: DataFrame, name: str = "src_file") -> DataFrame:
    """The distinct file names with ``scan_time``, the time in the name (null without one)."""
    return files.select(name).distinct().withColumn("scan_time", scan_time(F.col(name)))


def read_json(spark: SparkSession, path: str) -> object:
    """A small JSON document; None where there is none. Raises ValueError if it is broken."""
    p, fs = hadoop(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None
