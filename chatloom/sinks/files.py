"""Files of messages. A dataset is a folder of part files in the rows' order; ``single`` makes it one part, for small results.

A folder holds what one call wrote, or, where rows are appended, one more set of parts for each call.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.keys import loose_key, stable_key
from chatloom.operators.dedup import first_wins, two_keys, unseen
from chatloom.operators.filters import output_filter
from chatloom.operators.merge import merge_columns, order_of
from chatloom.schema import CSV_APPEND_FIELDS, CSV_FIELDS, FORMATS
from chatloom.sources.files import hadoop, read_index
from chatloom.sources.settings import Settings

from . import lines


def file_name(prefix: str, ending: str, now: datetime) -> str:
    return f"{prefix}_{now:%Y%m%d_%H%M%S}.{ending}"


def _parts(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df


def write_json(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """JSON arrays, indented by 2: each part file is an array of its own, so that any number of rows can be written."""
    columns = df.columns

    def arrays(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append("[" if last is None else f"{last},")
                last = "  " + json.dumps(json.loads(text), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]"] if last is None else [last, "]"])], names=["value"])

    rows = _parts(df, single).select(F.to_json(F.struct(*columns)).alias("value"))
    rows.mapInArrow(arrays, "value string").write.mode(mode).text(path)


def write_lines(df: DataFrame, path: str, single: bool = False, mode: str = "append") -> None:
    """JSON Lines, one compact object a line; appends."""
    _parts(df, single).select(lines.json_line(df).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | tuple[str, ...] = CSV_FIELDS, single: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header of those of the columns that the rows have; other columns are left out, structs become JSON."""
    kinds = dict(df.dtypes)
    some = [F.to_json(F.col(c)).alias(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c) for c in columns if c in kinds]
    _parts(df, single).select(*some).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_csv(df: DataFrame, path: str, exclude: tuple[str, ...] = ()) -> None:
    """CSV with the message's own time; appends. Each part has a header, as each is a file of its own."""
    write_csv(df, path, [c for c in CSV_APPEND_FIELDS if c not in exclude], mode="append")


def write_text(df: DataFrame, path: str, line: Column, title: str | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    """Lines of text in the order of ``seq``, a title and an empty line before them."""
    rows = df.select(F.col("seq").alias("_o"), line.alias("value"))
    if title is not None:
        head = df.sparkSession.createDataFrame([(-1, f"{title}\n")], "_o bigint, value string")
        rows = head.unionByName(rows)
    _parts(rows.orderBy("_o"), single).select("value").write.mode(mode).text(path)


def accepted(df: DataFrame, settings: Settings, index: DataFrame | None) -> DataFrame:
    """What a save writes: filtered, then first wins (by two keys if aggressive), then without keys of the index."""
    rows = output_filter(df, settings.exclude_system, settings.exclude_times, tuple(settings.time_patterns))
    if not settings.deduplicate:
        return rows
    key = stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content"))
    rows = two_keys(rows, key, loose_key(F.col("sender"), F.col("content"))) if settings.aggressive else first_wins(rows, key)
    return rows if index is None else unseen(rows, index, key)


def formats_of(settings: Settings, formats: list[str] | None = None) -> list[str]:
    """Formats in lower case, each once, in the order given; the settings' where none is. ValueError for unknown ones."""
    named = list(dict.fromkeys(f.lower() for f in (formats or settings.formats) if f)) or [settings.format.lower()]
    if unknown := [f for f in named if f not in FORMATS]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    return named


def save(df: DataFrame, settings: Settings, prefix: str, now: datetime, formats: list[str] | None = None, single: bool = False, index: str | None = None) -> list[str]:
    """Filter, deduplicate once, and write every format; the paths written.

    The keys join the index after all formats are written, so that a save that fails loses no message. The rows are
    written once as a table, from which all formats are made.
    """
    from chatloom.runtime import materialise

    named = formats_of(settings, formats)
    spark = df.sparkSession
    index = index or f"{settings.directory.rstrip('/')}/.dedup_index"
    rows = materialise(accepted(df, settings, read_index(spark, index) if settings.deduplicate else None), "accepted")
    ordered = rows.orderBy("seq")
    exclude = tuple(settings.exclude_fields)
    paths = []
    for kind in named:
        path = f"{settings.directory.rstrip('/')}/{file_name(prefix, kind, now)}"
        if kind == "json":
            write_json(lines.exported(ordered, exclude), path, single)
        elif kind == "csv":
            write_csv(lines.exported(ordered, exclude), path, [c for c in CSV_FIELDS if c not in exclude], single)
        elif kind == "txt":
            write_text(rows, path, lines.text_line(), None, single)
        else:
            write_text(rows, path, lines.markdown_line(), lines.MARKDOWN_TITLE, single)
        paths.append(path)
    if settings.deduplicate:
        add_to_index(rows, index)
    return paths


def append(df: DataFrame, settings: Settings, path: str, kind: str) -> None:
    """Append filtered messages to a folder in one format; nothing is written for no rows."""
    (kind,) = formats_of(settings, [kind])
    rows = output_filter(df, settings.exclude_system, settings.exclude_times, tuple(settings.time_patterns))
    if rows.isEmpty():
        return
    exclude = tuple(settings.exclude_fields)
    if kind == "json":
        write_lines(lines.exported(rows, exclude), path)
    elif kind == "csv":
        append_csv(lines.exported(rows, exclude), path, exclude)
    else:
        write_text(rows, path, lines.text_line() if kind == "txt" else lines.markdown_line(), mode="append")


def save_merged(df: DataFrame, directory: str, prefix: str, formats: tuple[str, ...] = ("json", "csv"), exclude: tuple[str, ...] = (), single: bool = False) -> list[str]:
    """Write merged messages in their order, without the named fields; unknown formats are ignored."""
    base = f"{directory.rstrip('/')}/{prefix}"
    stamp = F.col("timestamp") if dict(df.dtypes)["timestamp"] == "string" else lines.iso(F.col("timestamp"))
    out = lines.exported(df, exclude)
    paths = []
    if "json" in formats:
        write_json(out, f"{base}.json", single)
        paths.append(f"{base}.json")
    if "csv" in formats:
        write_csv(out, f"{base}.csv", merge_columns(out), single)
        paths.append(f"{base}.csv")
    if "md" in formats:
        place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_of(df))])
        body = df.select(place.alias("_o"), lines.merge_line(stamp).alias("value"))
        head = df.sparkSession.range(1).select(F.lit(None).cast(body.schema["_o"].dataType).alias("_o"), F.lit(f"{lines.MERGE_TITLE}\n").alias("value"))
        _parts(head.unionByName(body).orderBy(F.col("_o").asc_nulls_first()), single).select("value").write.text(f"{base}.md")
        paths.append(f"{base}.md")
    return paths


def add_to_index(df: DataFrame, path: str) -> None:
    """Append the keys of written rows to the index, a table of keys."""
    key = stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content"))
    df.select(key.alias("key")).distinct().write.mode("append").option("compression", "zstd").parquet(path)


def clear_index(spark: SparkSession, path: str) -> bool:
    """Remove the index; whether there was one."""
    p, fs = hadoop(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def export_index(spark: SparkSession, path: str, to: str) -> None:
    """The index as sorted lines of JSON texts, for tools that read it so."""
    read_index(spark, path).distinct().orderBy("key").select(F.to_json(F.array("key")).alias("value")).select(F.regexp_replace("value", r"^\[|\]$", "").alias("value")).write.text(to)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a privacy report, in their order, as one file: a report is read by people."""
    report.orderBy("part").select("line").coalesce(1).write.text(path)
