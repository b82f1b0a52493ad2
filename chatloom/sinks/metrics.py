"""Metrics of runs: heartbeat rows, their files with rotation, and snapshots as JSON documents."""

from __future__ import annotations

import csv
import io
import json
import os
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.boxes import rate

# Fields of a heartbeat, parts of a metrics document, and its version.
FIELDS = ("timestamp", "status", "messages", "attempts", "cpu_percent", "memory_mb")
DEFAULTS = {"latency_ms_avg": {"process_image": 0.0, "detect_regions": 0.0, "ocr_engine": 0.0}, "cache_stats": {}, "counters": {}}
VERSION = 1


def beat(now: datetime, status: str, messages: int | None, attempts: int | None, cpu: float | None, memory: float | None) -> dict:
    """A heartbeat row; unknown numbers are 0."""
    return dict(zip(FIELDS, (now.isoformat(timespec="seconds"), status, int(messages or 0), int(attempts or 0), float(cpu or 0), float(memory or 0))))


def known_format(fmt: str | None) -> str:
    """``csv`` or ``json``; an unknown one counts as CSV."""
    f = (fmt or "csv").strip().lower()
    return f if f in ("csv", "json") else "csv"


def append_beat(path: str, row: dict, fmt: str = "csv", most_mb: float | None = None, keep: int = 0) -> None:
    """Append a heartbeat to a local file, with a header where a CSV file begins; then rotate it if it is too large."""
    file = Path(path)
    if known_format(fmt) == "json":
        line = json.dumps(row, ensure_ascii=False) + "\n"
    else:
        out = io.StringIO()
        writer = csv.DictWriter(out, FIELDS)
        if not file.exists() or not file.stat().st_size:
            writer.writeheader()
        writer.writerow(row)
        line = out.getvalue()
    with file.open("a", encoding="utf-8", newline="") as f:
        f.write(line)
    rotate(path, most_mb, keep)


def rotate(path: str, most_mb: float | None, keep: int) -> bool:
    """Move a file that has reached its size to ``.1``, older ones one further, at most ``keep`` of them. Nothing happens
    without a size or a number to keep."""
    if not most_mb or most_mb <= 0 or keep <= 0 or not os.path.exists(path) or os.path.getsize(path) < int(most_mb * (1 << 20)):
        return False
    for i in range(keep - 1, 0, -1):
        if os.path.exists(f"{path}.{i}"):
            os.replace(f"{path}.{i}", f"{path}.{i + 1}")
    os.replace(path, f"{path}.1")
    return True


def read_metrics(path: str) -> tuple[dict, str]:
    """A metrics document and where it is from: ``file``, with defaults if it is broken, or ``memory`` without one."""
    file = Path(path)
    if not file.exists():
        return json.loads(json.dumps(DEFAULTS)), "memory"
    try:
        return json.loads(file.read_text(encoding="utf-8")), "file"
    except ValueError:
        return json.loads(json.dumps(DEFAULTS)), "file"


def reset_metrics(path: str) -> None:
    Path(path).write_text(json.dumps(DEFAULTS, ensure_ascii=False, indent=2), encoding="utf-8")


def snapshot(path: str, now: datetime | None = None) -> dict:
    """A document that holds the metrics with version, time and source."""
    metrics, source = read_metrics(path)
    return {"schema_version": VERSION, "timestamp": (now or datetime.now(timezone.utc)).isoformat(timespec="seconds"), "source": source, "data": metrics}


def write_snapshot(path: str, to: str, now: datetime | None = None) -> dict:
    found = snapshot(path, now)
    Path(to).write_text(json.dumps(found, ensure_ascii=False, indent=2), encoding="utf-8")
    return found


def cache_stats(counters: DataFrame, key: str = "cache") -> DataFrame:
    """``key, hits, misses, evictions, hit_rate`` of rows of counters; nulls count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = counters.groupBy(key).agg(total("hits"), total("misses"), total("evictions"))
    return out.withColumn("hit_rate", rate(F.col("hits"), F.col("hits") + F.col("misses")))


def heartbeats(rows: DataFrame, *keys: str) -> DataFrame:
    """Heartbeats in one form: times as ISO to the second, status stripped and in lower case, unknown numbers 0. Repeated
    rows stay."""
    from chatloom.functions.text import strip, text
    from chatloom.functions.times import norm_stamp

    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(*keys, norm_stamp(F.col("timestamp")).alias("timestamp"), F.lower(strip(text("status"))).alias("status"), *[number(c) for c in FIELDS[2:]])


def alerts(rows: DataFrame, cpu: float | None = None, memory: float | None = None) -> DataFrame:
    """Heartbeats with ``alert``, one row for each limit reached: ``cpu`` or ``memory``. No limit, no alert; unknown
    numbers reach none."""
    none = F.lit(None).cast("string")
    reached = lambda column, limit, name: F.when(F.col(column) >= F.lit(limit), name) if limit is not None else none
    found = F.array_compact(F.array(reached("cpu_percent", cpu, "cpu"), reached("memory_mb", memory, "memory")))
    return rows.withColumn("alert", F.explode(found))
