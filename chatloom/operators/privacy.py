"""Privacy scan of lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import privacy_hits, strip

#: Lines of a file, as universal line ends cut it.
FILE_LINES = r"\r\n|[\n\r]"


def text_lines(files: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """``*keys, line_no, line``: the stripped lines of texts that are not blank, numbered from 1 with the blank ones."""
    out = files.select(*keys, F.posexplode(F.split(content, FILE_LINES)).alias("_p", "_l"))
    return out.select(*keys, (F.col("_p") + 1).alias("line_no"), strip(F.col("_l")).alias("line")).filter("line <> ''")


def scan(lines: DataFrame, keys: list[str], exact: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, line_no, level, pattern, line`` of what lines hold: exact texts, numbers, addresses, home folders."""
    hits = lines.withColumn("_h", F.explode(privacy_hits(F.col("line"), exact)))
    return hits.select(*keys, "line_no", "_h.level", "_h.pattern", "line")


def report(hits: DataFrame, path: str = "file_path") -> DataFrame:
    """``part, line`` of a report: errors first, then warnings, each hit with its line cut at 200 characters, in the order
    of file and line. Empty without hits. ``part`` orders it."""
    level = F.when(F.col("level") == "error", 1).otherwise(2)
    shown = F.concat(F.lit(" - "), F.col(path).cast("string"), F.lit(":"), F.col("line_no").cast("string"), F.lit(" | pattern="), F.col("pattern"), F.lit(" | "), F.substring("line", 1, 200))
    body = hits.select(F.struct(level.alias("section"), F.lit(1).alias("row"), F.col(path).cast("string").alias("file"), "line_no", "pattern").alias("part"), shown.alias("line"))
    null = F.lit("")
    head = lambda section, row, line: hits.filter(level == section if section in (1, 2) else F.lit(True)).limit(1).select(F.struct(F.lit(section).alias("section"), F.lit(row).alias("row"), null.alias("file"), F.lit(0).alias("line_no"), null.alias("pattern")).alias("part"), F.lit(line).alias("line"))
    parts = [head(0, 0, "=== 隐私扫描报告 ==="), head(1, 0, "[ERROR] 发现高危敏感信息："), head(2, 0, "[WARNING] 发现可能的敏感信息："), head(3, 0, "====================")]
    for p in parts:
        body = body.unionByName(p)
    return body.orderBy("part")
