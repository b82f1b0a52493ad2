"""Sources and sinks: what is written reads back, and broken input gives its defined result."""

import json
import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chatloom.plans import runs
from chatloom.schema import MESSAGE
from chatloom.sinks import files as out
from chatloom.sinks import lines, metrics
from chatloom.sources import files, recognised, settings
from chatloom.sources.settings import Settings

AT = datetime(2024, 1, 1, 12)


def messages(spark, *rows):
    full = [{"timestamp": AT, "confidence_score": 0.9, "raw_ocr_text": "", "message_type": "text", "seq": i, **r} for i, r in enumerate(rows, 1)]
    names = spark.createDataFrame([], MESSAGE).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], MESSAGE)


SIX = [{"id": "msg_001", "sender": "张三", "content": "你好"}] * 2 + [{"id": "", "sender": "李四", "content": "收到"}] * 2 + [{"id": "msg_003", "sender": "王五", "content": "会议"}, {"id": "sys_001", "sender": "系统", "content": "改名", "message_type": "system"}]


def test_accepted(spark):
    df = messages(spark, *SIX)
    kept = out.accepted(df, Settings(), None)
    assert sorted(r.id for r in kept.collect()) == ["", "msg_001", "msg_003"]
    assert out.accepted(df, Settings(deduplicate=False), None).count() == 5
    assert out.accepted(df, Settings(aggressive=True, exclude_system=False), None).count() == 4


def test_save_across_batches(spark, tmp_path):
    s = Settings(directory=str(tmp_path))
    first = messages(spark, *({"id": f"m{i}", "sender": "a", "content": str(i)} for i in (1, 2, 3)))
    second = messages(spark, *({"id": f"m{i}", "sender": "a", "content": str(i)} for i in (2, 3, 4)))
    paths = out.save(first, s, "one", AT, ["JSON", "json", "csv", "txt", "md"], single=True)
    assert [Path(p).name for p in paths] == [f"one_20240101_120000.{f}" for f in ("json", "csv", "txt", "md")]
    part = lambda p: next(Path(p).glob("part-*")).read_text()
    assert part(paths[0]) == json.dumps(json.loads(part(paths[0])), ensure_ascii=False, indent=2) + "\n"
    assert part(paths[1]).splitlines()[0] == "id,sender,content,message_type,timestamp,confidence_score,raw_ocr_text"
    assert part(paths[2]).splitlines()[0] == "[2024-01-01T12:00:00] a (text): 1"
    assert part(paths[3]).startswith("# WeChat Chat Export\n\n- [2024-01-01T12:00:00] **a** (text): 1")
    (path,) = out.save(second, s, "two", AT, single=True)
    assert [m["id"] for m in json.loads(part(path))] == ["m4"]
    assert sorted(r.key for r in files.read_index(spark, f"{tmp_path}/.dedup_index").collect()) == ["m1", "m2", "m3", "m4"]
    out.export_index(spark, f"{tmp_path}/.dedup_index", f"{tmp_path}/keys")
    assert out.clear_index(spark, f"{tmp_path}/.dedup_index") and not out.clear_index(spark, f"{tmp_path}/.dedup_index")
    (path,) = out.save(second, s, "three", AT, single=True)
    assert len(json.loads(part(path))) == 3
    with pytest.raises(ValueError):
        out.save(first, s, "x", AT, ["pdf"])


def test_rendering(spark):
    card = ("哔哩哔哩", "标题一", "第一行\n\n第二行", "哔哩哔哩", "UP", 12345, "https://b.example")
    df = messages(
        spark,
        {"id": "1", "sender": "对方", "content": "看", "message_type": "share", "share_card": card},
        {"id": "2", "sender": "我", "content": "好", "quote_meta": ("小明", "对方", "引用的文本"), "message_time": datetime(2024, 1, 1, 9)},
        {"id": "3", "sender": "我", "content": " ", "message_type": "sticker"},
    )
    md = [r[0] for r in df.orderBy("seq").select(lines.markdown_line()).collect()]
    assert md[0].split("\n")[1:] == ["  - 平台：哔哩哔哩", "  - 标题：标题一", "  - 正文：第一行", "  - 正文：第二行", "  - 来源：哔哩哔哩", "  - UP主：UP", "  - 播放量：12345", "  - 链接：https://b.example"]
    assert md[1] == "> 引用（对方）：小明\n> 引用的文本\n- [2024-01-01T09:00:00 (Capture: 2024-01-01T12:00:00)] **我** (text): 好"
    assert md[2].endswith("(sticker): 表情包未识别出文字")
    txt = [r[0] for r in df.orderBy("seq").select(lines.text_line()).collect()]
    assert txt[1] == "引用> 对方：小明\n引用> 引用的文本\n[2024-01-01T09:00:00] 我 (text): 好"


def test_exports(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.JSON").write_text(json.dumps([{"id": "1", "sender": "a", "content": "x", "timestamp": "2024-01-01T00:00:01"}, 7, "text", {"id": "2", "content": None}]))
    (tmp_path / "a 1.json").write_text(json.dumps([{"id": "3", "timestamp": "2024-01-01T00:00:00.5"}, {"id": "1", "content": "again"}]))
    (tmp_path / "bad.json").write_text("[{")
    (tmp_path / "one.json").write_text('{"id": "no list"}')
    (tmp_path / ".dedup_index.json").write_text('["k1", "k2"]')
    (tmp_path / "sub" / "deep.json").write_text('[{"id": "deep"}]')
    df = files.read_exports(spark, [str(tmp_path), str(tmp_path / "missing"), str(tmp_path / "b.JSON")])
    assert [(r.src_file, r.file_ord, r.id, r.seq % files.PER_FILE) for r in df.orderBy("seq").collect()] == [("a 1.json", 0, "3", 0), ("a 1.json", 0, "1", 1), ("b.JSON", 1, "1", 0), ("b.JSON", 1, "2", 3)]
    assert files.read_exports(spark, [str(tmp_path / "none")]).count() == 0
    assert sorted(r.key for r in files.read_index(spark, str(tmp_path / ".dedup_index.json")).collect()) == ["k1", "k2"]
    assert files.read_index(spark, str(tmp_path / "bad.json")).count() == 0
    paths = runs.merge_exports(spark, [str(tmp_path)], str(tmp_path / "out"), "all", "json,csv,md", "raw_ocr_text", single=True)
    assert [r.id for r in files.read_exports(spark, [str(next(Path(paths[0]).glob("part-*")).rename(tmp_path / "out" / "m.json"))]).orderBy("seq").collect()] == ["3", "1", "2"]
    assert next(Path(paths[2]).glob("part-*")).read_text().startswith("# 合并导出（部分片段）\n\n- [2024-01-01T00:00:00.5]")
    with pytest.raises(ValueError):
        runs.merge_exports(spark, [str(tmp_path / "none")], str(tmp_path), "x")


def test_privacy_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\nmail a@b.cc\n" + "/Users/me/" + "x" * 300)
    (tmp_path / "a.bin").write_text("a@b.cc")
    (tmp_path / "output").mkdir()
    (tmp_path / "output" / "b.txt").write_text("a@b.cc")
    (tmp_path / "config.json").write_text("a@b.cc")
    hits, failing = runs.privacy_scan(spark, str(tmp_path), report_path=str(tmp_path / "reports" / "scan"))
    assert sorted((r.file_path, r.line_no, r.pattern) for r in hits.collect()) == [("a.txt", 2, "email"), ("a.txt", 3, "mac_users_path")] and failing
    report = next((tmp_path / "reports" / "scan").glob("part-*")).read_text().splitlines()
    assert report[0].startswith("===") and report[1].startswith("[ERROR]") and report[2] == " - a.txt:2 | pattern=email | mail a@b.cc" and len(report[4]) < 250
    newest = files.latest_files(spark, [str(tmp_path), str(tmp_path / "nowhere")], 2).collect()
    assert len(newest) == 2 and all(not r.name.startswith(".") for r in newest)


def test_recognised(spark):
    box = [[0, 0], [10, 0], [10, 5], [0, 5]]
    results = [
        json.dumps({"rec_texts": ["a", "", "c"], "rec_scores": [0.9, 0.9, 0.5], "rec_polys": [box, box, box]}),
        json.dumps([{"texts": ["x", "y"], "scores": [0.8, 0.9], "boxes": [box]}, {"text": "alone"}]),
        json.dumps([[[box, ["line", 0.95]], [box, "flat", 0.9], ["bare", 0.8], 5]]),
        '"just text"', "", None, "5", "{broken",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(results)], "i int, r string")
    got = recognised.read_results(df, ["i"], "r", least=0.5, scale=1.5).orderBy("i", "region_seq").collect()
    assert [(r.i, r.text, r.width, r.height) for r in got] == [(0, "a", 15, 7), (0, "c", 15, 7), (1, "x", 15, 7), (1, "y", 0, 0), (1, "alone", 0, 0), (2, "line", 15, 7), (2, "flat", 15, 7), (2, "bare", 0, 0), (3, "just text", 0, 0)]
    assert recognised.read_results(df, ["i"], "r").filter("text = 'c'").count() == 0


def test_settings(tmp_path):
    assert settings.load(str(tmp_path)) == Settings()
    (tmp_path / "settings.json").write_text('{"confidence": 0.5, "output": {"formats": ["md"], "exclude_times": true}, "other": 1}')
    found = settings.load(str(tmp_path))
    assert (found.confidence, found.formats, found.exclude_times) == (0.5, ["md"], True)
    for wrong in ({"confidence": 2}, {"attempts": 0}, {"format": "pdf"}):
        with pytest.raises(ValueError):
            Settings(**wrong).check()


def test_metrics(spark, tmp_path):
    path = str(tmp_path / "beats.csv")
    for i in range(3):
        metrics.append_beat(path, metrics.beat(AT, "running", i, None, 91.5, None), "xml", most_mb=0.0001, keep=2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["beats.csv", "beats.csv.1"] or os.path.exists(path + ".1")
    text = Path(path + ".1").read_text()
    assert text.splitlines()[0] == ",".join(metrics.FIELDS)
    log = str(tmp_path / "beats.jsonl")
    metrics.append_beat(log, metrics.beat(AT, "running", 1, 2, 3, 4), "json")
    assert set(json.loads(Path(log).read_text())) == set(metrics.FIELDS)
    doc = str(tmp_path / "metrics.json")
    assert metrics.read_metrics(doc)[1] == "memory"
    Path(doc).write_text("{")
    assert metrics.read_metrics(doc) == (metrics.DEFAULTS, "file")
    metrics.reset_metrics(doc)
    assert metrics.write_snapshot(doc, str(tmp_path / "snap.json"))["schema_version"] == 1
    rows = spark.createDataFrame([("2024-01-01 00:00:00", " Running ", None, 1, 90.0, None)], "timestamp string, status string, messages int, attempts int, cpu_percent double, memory_mb double")
    assert tuple(metrics.heartbeats(rows).first()) == ("2024-01-01T00:00:00", "running", 0, 1, 90.0, 0.0)
    assert [r.alert for r in metrics.alerts(rows, 90.0, 1.0).collect()] == ["cpu"] and metrics.alerts(rows).count() == 0


def test_runs(spark, tmp_path):
    regions = spark.createDataFrame([("s", 0, "昨天 10:00", 300, 10, 80, 20, 0.9, "text"), ("s", 1, "说好了的事情", 50, 100, 200, 20, 0.9, "text"), ("s", 2, "听不清", 50, 300, 200, 20, 0.2, "text")], "shot_id string, region_seq int, text string, x int, y int, width int, height int, confidence double, type string")
    found, paths = runs.run_extraction(regions, Settings(directory=str(tmp_path)), AT, types="text")
    assert [r.content for r in found.collect()] == ["说好了的事情"] and len(paths) == 1
    assert runs.run_extraction(regions, Settings(directory=str(tmp_path)), AT, sender="nobody")[1] == []
    df = messages(spark, *({"id": k, "sender": "我", "content": k, "file_ord": b, "src_file": "f"} for b, k in [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b")]))
    seen = []
    assert [r.id for r in runs.run_scan(df, Settings(), live=str(tmp_path / "live"), on_batch=lambda d: seen.append(d.count())).collect()] == ["a"] and seen == [1]
    assert files.read_lines(spark, str(tmp_path / "live")).count() == 1
    summary, _ = runs.run_auto_scan(df, Settings(directory=str(tmp_path / "auto")), AT)
    assert tuple(summary.first()) == (5, 0, 5, 1, 1, 0)
    empty = df.limit(0)
    assert runs.first_filled([lambda: empty, lambda: df]).count() == 5 and runs.first_filled([]) is None
    assert runs.pipeline(df, lambda d: d.filter("id = 'a'"), lambda d: d.select("id"), written=True).count() == 4


def test_timeline(spark, tmp_path):
    inbox, folder, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = []
    for ids in (["a", "b", "a"], ["b", "c"]):
        rows = messages(spark, *({"id": k, "sender": "s", "content": k} for k in ids))
        out.write_lines(rows.select("id", "sender", "content", "timestamp", "message_type", "seq"), inbox)
        tail = runs.run_timeline(spark, inbox, folder, check, keep=lambda d: d.filter("id <> 'zz'"), on_batch=lambda d, n: batches.append(d.count()))
    assert sorted(r.id for r in tail.read(spark).collect()) == ["a", "b", "c"] and batches == [2, 1]
    # a batch done again replaces its own rows
    tail.take(messages(spark, {"id": "c", "sender": "s", "content": "c"}), 1)
    assert sorted(r.id for r in tail.read(spark).collect()) == ["a", "b", "c"]
    from chatloom.streaming.tail import new_only, read_stream

    for late in (None, "1 hour"):
        q = new_only(read_stream(spark, inbox), late).writeStream.format("memory").queryName(f"n{bool(late)}").trigger(availableNow=True).option("checkpointLocation", f"{check}-{bool(late)}").start()
        q.awaitTermination()
        assert spark.table(f"n{bool(late)}").select(F.col("id")).count() == 3
