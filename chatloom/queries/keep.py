"""Which messages are kept, in what order, with which times, and how they are written."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from chatloom.functions import keys, times
from chatloom.functions.boxes import hit_band
from chatloom.operators import dedup, fill, filters, merge, stats
from chatloom.runtime import load, scratch_path
from chatloom.schema import EXPORT, MESSAGE
from chatloom.sinks import files as out_files
from chatloom.sinks import lines
from chatloom.sources import files
from chatloom.sources.settings import Settings
from chatloom.streaming.tail import Tail, read_stream

from . import sql as q

query = q.Registry()
QUERIES, SQL = query.queries, query.sql
_C, _S = "coalesce(content, '')", "coalesce(sender, '')"


def _messages(spark, d):
    return load(spark, d, "messages")


def _keyed(df):
    """What keys are made of and results show: a whole row kept by an aggregation would read every column."""
    return df.select("seq", "id", "sender", "content", "timestamp")


def _stable():
    return keys.stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content"))


def _both(spark, d):
    messages, incoming = load(spark, d, "messages", "incoming")
    return messages, incoming.drop("batch_no")


@query(
    f"select seq from messages where contains(lower({_S}), 'o') and timestamp >= timestamp '2021-03-01 00:00:00' and timestamp <= timestamp '2024-06-30 23:59:59' "
    f"and message_type in ('text', 'share') and contains(lower({_C}), 'the') and confidence_score >= 0.5"
)
def filter_messages(spark, d):
    start, end = datetime(2021, 3, 1), datetime(2024, 6, 30, 23, 59, 59)
    return filters.message_filter(_messages(spark, d), "O", start, end, ["text", "share"], "The", 0.5).select("seq")


@query("select seq from messages where timestamp >= timestamp '2022-01-01 00:00:00'")
def filter_read_criteria(spark, d):
    return filters.message_filter(_messages(spark, d), **filters.read_criteria("2022-01-01", "no time", "text,poem")).select("seq")


_SYSTEM = f"coalesce(message_type = 'system' or {q.strip('sender')} = '系统', false)"
_TS = q.strip("content")
_ONLY_S = f"(regexp_matches({_TS}, '{times.whole(times.STORAGE_FORMS)}') or (regexp_matches({_TS}, '{times.STORAGE_LOOSE}') and regexp_matches({_TS}, '{times.STORAGE_NEEDS}')))"
_N = q.norm("content")
_ONLY_M = f"(regexp_matches({_N}, '{times.whole(times.MERGE_FORMS)}') or (regexp_matches({_N}, '{times.MERGE_LOOSE}') and regexp_matches({_N}, '{times.MERGE_NEEDS}')))"


@query(f"select seq from messages where not {_SYSTEM}")
def filter_system(spark, d):
    return filters.without_system(_messages(spark, d)).select("seq")


@query(f"select seq from messages where not {_ONLY_S} and not regexp_matches({_TS}, '\\A=+')")
def filter_times_storage(spark, d):
    return filters.without_times(_messages(spark, d), extra=("=+",)).select("seq")


@query(f"select seq from messages where not {_ONLY_M}")
def filter_times_merge(spark, d):
    return filters.without_times(_messages(spark, d), merge=True).select("seq")


@query(f"select seq, content from messages where {q.filled('content')}")
def filter_empty(spark, d):
    return filters.without_empty(_messages(spark, d)).select("seq", "content")


@query("select seq, sender, content, message_type from messages")
def filter_fields(spark, d):
    rows = _messages(spark, d).select("seq", "sender", "content", "message_type", "raw_ocr_text", "confidence_score")
    return filters.without_fields(rows, ("raw_ocr_text", "confidence_score", "missing"))


@query("select shot_id, region_seq, round(confidence, 6) as confidence from regions where confidence >= 0.7")
def filter_confidence(spark, d):
    return filters.confident(load(spark, d, "regions")).select("shot_id", "region_seq", F.round("confidence", 6).alias("confidence"))


@query(
    "with c as (select seq, greatest(0, least(original_region.x, 719)) as x, greatest(0, least(original_region.y, 1279)) as y, original_region.width as w, original_region.height as h from messages "
    f"where original_region is not null and (message_type in ('image', 'sticker') or (message_type = 'unknown' and not {q.filled('content')}))), e as (select seq, x, y, least(w, 720 - x) as width, least(h, 1280 - y) as height from c) "
    "select * from e where width > 50 and height > 50"
)
def filter_image_crops(spark, d):
    rows = filters.crops(filters.image_candidates(_messages(spark, d)), F.lit(720), F.lit(1280))
    return rows.select("seq", "crop.*")


@query(
    "with p as (select shot_id, row_number() over (partition by shot_id order by region_seq, y, x, confidence) as n, coalesce(text, '') as t from regions) "
    "select shot_id, contains(lower(string_agg(t, ' ' order by n)), 'the ') as found from p where n <= 5 group by shot_id"
)
def filter_summary_probe(spark, d):
    rows = load(spark, d, "regions")
    pages = rows.groupBy("shot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("region_seq", "y", "x", "confidence", "text"))), lambda r: F.struct(r["text"].alias("content"))).alias("messages"))
    return filters.summary_holds(pages, "messages", "The ").select("shot_id", "found")


@query(f"select seq, content from (select * from messages where not {_SYSTEM} and not {_ONLY_S}) qualify row_number() over (partition by {q.stable()} order by seq) = 1")
def filter_before_dedup(spark, d):
    return out_files.accepted(_messages(spark, d).select("seq", "id", "sender", "content", "message_type", "timestamp"), Settings(exclude_times=True), None).select("seq", "content")


@query(f"select seq, sender, content from messages qualify row_number() over (partition by {q.stable()} order by seq) = 1")
def dedup_first_wins(spark, d):
    return dedup.first_wins(_keyed(_messages(spark, d)), _stable()).select("seq", "sender", "content")


def _one_by_one(first: str, second: str) -> str:
    """CTEs up to ``kept (seq)``: messages in order, one at a time, without those that share a key with a kept one."""
    return (
        f"with recursive m as (select seq, hash({first}) as a, hash({second}) as b from messages), r as (select *, row_number() over (order by seq) as i from m), "
        "t(one, i, seqs, ks) using key (one) as (select 1, 1, [seq], [a, b] from r where i = 1 union "
        "select 1, t.i + 1, case when list_contains(t.ks, r.a) or list_contains(t.ks, r.b) then t.seqs else list_append(t.seqs, r.seq) end, "
        "case when list_contains(t.ks, r.a) or list_contains(t.ks, r.b) then t.ks else list_concat(t.ks, [r.a, r.b]) end from t join r on r.i = t.i + 1), kept as (select unnest(seqs) as seq from t)"
    )


_LOOSE = f"concat('2|', lower({q.strip('sender')}), '|', lower({q.strip('content')}))"
_CONTENT = f"concat('2|', lower({q.norm('sender')}), '|', {q.norm('content')})"


@query(f"{_one_by_one(q.stable(), _LOOSE)} select seq, sender, content from messages where seq in (select seq from kept)")
def dedup_two_keys(spark, d):
    return dedup.two_keys(_messages(spark, d), _stable(), keys.loose_key(F.col("sender"), F.col("content"))).select("seq", "sender", "content")


@query(f"with k as (select {q.stable()} as k from messages), i as (select *, {q.stable()} as k from incoming) select seq, content from i where not exists (select 1 from k where k.k = i.k) qualify row_number() over (partition by k order by seq) = 1")
def dedup_against_index(spark, d):
    messages, incoming = _both(spark, d)
    return dedup.batch_against(_keyed(incoming), dedup.index_of(messages, _stable()), _stable()).select("seq", "content")


@query(f"select distinct {q.stable()} as key from messages")
def dedup_index(spark, d):
    path = scratch_path(spark, "index")
    out_files.add_to_index(_messages(spark, d), path)
    return files.read_index(spark, path)


@query(f"with u as (select seq, id, sender, timestamp, content from messages union all select seq, id, sender, timestamp, content from incoming) {q.first_by('u', q.stable(), 'seq, content')}")
def tail_new_messages(spark, d):
    """Both tables arrive as files of a stream, one after the other, and only new messages are appended."""
    inbox, folder = scratch_path(spark, "inbox"), scratch_path(spark, "tail")
    tail = Tail(folder)
    for n, rows in enumerate(_both(spark, d)):
        rows.select("id", "sender", "content", "message_type", "timestamp", "seq").write.mode("append").json(inbox)
        tail.start(read_stream(spark, inbox, MESSAGE), f"{folder}/checkpoint").awaitTermination()
    return tail.read(spark).select("seq", "content")


_MERGED = f"select seq, id, sender, content, {q.iso('timestamp')} as timestamp from (select * from messages where not {_ONLY_M}) qualify row_number() over (partition by {q.merge_key()} order by seq) = 1"


@query(f"{_MERGED} order by date_trunc('second', timestamp) nulls last, seq")
def merge_exports(spark, d):
    rows = merge.merge(_keyed(_messages(spark, d)), exclude_time_only=True)
    return rows.select("seq", "id", "sender", "content", times.iso(F.col("timestamp")).alias("timestamp"))


@query(f"{_one_by_one(q.merge_key(), _CONTENT)} select seq, sender, content from messages where seq in (select seq from kept)")
def merge_aggressive(spark, d):
    return merge.merge(_messages(spark, d), aggressive=True).select("seq", "sender", "content")


@query(f"with u as (select seq, id, sender, content, timestamp, src_file from messages union all select seq, id, sender, content, timestamp, null from incoming) select seq, src_file from u")
def merge_union(spark, d):
    return merge.union([*_both(spark, d)]).select("seq", "src_file")


@query(f"with u as (select seq, id, sender, content, timestamp from messages union all select seq, id, sender, content, timestamp from incoming) {q.first_by('u', q.stable(), 'seq, sender')}")
def merge_scans(spark, d):
    return merge.scans_together([_keyed(f) for f in _both(spark, d)]).select("seq", "sender")


@query(
    "with h as (select src_file, file_ord, min(timestamp) as timestamp from messages group by all), u as (select file_ord as chat_ord, cast(0 as bigint) as place, concat('SYS-', coalesce(src_file, ''), '-', cast(epoch(timestamp) as bigint)) as id, '系统' as sender, timestamp, "
    "concat('=== 会话：', coalesce(src_file, ''), ' ===') as content from h union all select file_ord, seq, id, sender, timestamp, content from messages) "
    f"{q.first_by('u', q.stable(), 'chat_ord, place, sender, content', 'chat_ord, place')}"
)
def merge_chats(spark, d):
    rows = merge.chats_together(_messages(spark, d).select("seq", "id", "sender", "content", "timestamp", "src_file", "file_ord"), F.col("src_file"), F.col("file_ord"), F.col("timestamp"))
    return rows.select("chat_ord", "place", "sender", "content")


_RUN = q.scan_time("src_file")
_PROBE = f"(coalesce(message_type = 'system', false) and regexp_matches({_C}, '{times.TIME_LIKE}'))"


def _filled(order: str) -> str:
    return (
        f"with m as (select *, {_RUN} as run, {_PROBE} as mark from messages), p as (select *, case when mark then {q.relative('content', 'run')} end as t from m) "
        f"select seq, case when not coalesce(message_type = 'system', false) or mark then {q.iso(f'coalesce(last_value(t ignore nulls) over (partition by src_file order by {order} rows unbounded preceding), run)')} end as message_time from p"
    )


@query(_filled("seq"))
def fill_message_time(spark, d):
    rows = fill.message_times(_messages(spark, d).drop("message_time"), times.scan_time(F.col("src_file")), ["src_file"])
    return rows.select("seq", times.iso(F.col("message_time")).alias("message_time"))


@query(_filled("seq desc"))
def fill_message_time_upwards(spark, d):
    rows = fill.message_times(_messages(spark, d).drop("message_time"), times.scan_time(F.col("src_file")), ["src_file"], upwards=True)
    return rows.select("seq", times.iso(F.col("message_time")).alias("message_time"))


_REAL = (
    f"with m as (select *, {_RUN} as run, regexp_matches({_TS}, '{times.whole(times.STRICT_FORMS)}') as mark from messages), p as (select *, case when mark then {q.relative('content', 'run', False)} end as t from m), "
    "r as (select seq, sender, content, case when mark then 'system' else message_type end as message_type, strftime(coalesce(last_value(t ignore nulls) over (partition by src_file order by seq rows unbounded preceding), run), '%Y-%m-%d %H:%M:%S') as real_time from p)"
)


@query(f"{_REAL} select seq, message_type, real_time from r")
def fill_real_time(spark, d):
    return fill.real_times(_messages(spark, d), times.scan_time(F.col("src_file")), ["src_file"]).select("seq", "message_type", "real_time")


@query(f"{_REAL} select seq, real_time from r qualify row_number() over (partition by sender, content, real_time order by seq) = 1")
def merge_by_real_time(spark, d):
    return fill.merged_by_real_time(_messages(spark, d).select("seq", "sender", "content", "message_type", "src_file")).select("seq", "real_time")


@query("select count_if(sender = '我') as own, count_if(sender = '对方') as other, count(*) as total from messages")
def agg_sender_counts(spark, d):
    return stats.sender_counts(_messages(spark, d))


@query(
    "with d as (select distinct cast(timestamp as date) as d from messages where timestamp is not null), g as (select d, d - lag(d) over (order by d) as gap, d - cast(row_number() over (order by d) as int) as k from d), "
    "r as (select count(*) as n, max(case when gap <> 1 then gap - 1 end) as gap, min(d) as lo, max(d) as hi from g group by k) "
    "select cast(coalesce(max(hi) - min(lo) + 1, 0) as int) as span, cast(coalesce(max(n), 0) as int) as longest_streak, cast(coalesce(max(gap), 0) as int) as longest_gap from r"
)
def agg_session_summary(spark, d):
    return stats.session_summary(_messages(spark, d))


@query("select coalesce(sender, '') as sender, count(distinct cast(timestamp as date)) as days, coalesce(cast(max(cast(timestamp as date)) - min(cast(timestamp as date)) + 1 as int), 0) as span from messages group by all")
def agg_days_by_sender(spark, d):
    rows = _messages(spark, d).withColumn("sender", F.coalesce("sender", F.lit("")))
    return stats.days_by(rows, "sender").select("sender", "days", F.col("span").cast("int").alias("span"))


_BATCHES = (
    f"with f as (select file_ord, seq, {q.stable()} as k from messages), n as (select file_ord, count(*) as new from (select * from f qualify row_number() over (partition by k order by file_ord, seq) = 1) group by file_ord), "
    "b as (select file_ord, count(*) as parsed, coalesce(any_value(n.new), 0) as new from f left join n using (file_ord) group by file_ord), "
    "r as (select *, sum(new) over (order by file_ord) as total, sum(cast(new > 0 as int)) over (order by file_ord) as g from b)"
)


@query(
    f"{_BATCHES} select file_ord, parsed, new, round(new / parsed, 9) as hit_rate, case when new / parsed >= 0.7 then 'good' when new / parsed <= 0.3 then 'bad' else 'warn' end as band, "
    "case when new > 0 then 0 else row_number() over (partition by g order by file_ord) - cast(g > 0 as int) end as misses, cast(total as bigint) as total from r"
)
def agg_batches(spark, d):
    rows = stats.batches(_messages(spark, d), _stable())
    return rows.select("file_ord", "parsed", "new", F.round("hit_rate", 9).alias("hit_rate"), hit_band(F.col("hit_rate")).alias("band"), "misses", "total")


@query(f"{_BATCHES} select file_ord, cast(total as bigint) as total from r where total - new < 1000")
def limit_max_messages(spark, d):
    rows = stats.batches_until(stats.batches(_messages(spark, d), _stable()), None, 1000)
    return rows.select("file_ord", "total")


@query("with b as (select file_ord, avg(case when message_type = 'text' then 1 else 0 end) < 0.8 as same from messages group by 1), r as (select *, sum(cast(not same as int)) over (order by file_ord) as g from b), "
    "l as (select file_ord, same, case when same then row_number() over (partition by g order by file_ord) - cast(g > 0 as int) else 0 end as n from r) select file_ord from l where file_ord <= coalesce((select min(file_ord) from l where n = 3), 1 << 30)")  # fmt: skip
def limit_no_change(spark, d):
    from chatloom.operators.scan import until_run

    b = _messages(spark, d).groupBy("file_ord").agg((F.avg(F.when(F.col("message_type") == "text", 1).otherwise(0)) < 0.8).alias("same"))
    return until_run(b, [], "file_ord", F.col("same"), 3).select("file_ord")


@query("select seq, sender from messages order by timestamp nulls last, seq limit 10")
def limit_preview(spark, d):
    return stats.preview(_messages(spark, d), 10, "timestamp").select("seq", "sender")


@query("with c as (select coalesce(message_type, '') as message_type, count(*) as rows from messages group by 1) select *, row_number() over (order by cast(rows as varchar) desc, message_type) as place from c")
def sort_as_text(spark, d):
    rows = _messages(spark, d).groupBy(F.coalesce("message_type", F.lit("")).alias("message_type")).agg(F.count(F.lit(1)).alias("rows"))
    return stats.by_text_order(rows, "rows", descending=True)


@query(
    "with e as (select coalesce(message_type, '') as \"group\", src_file as name, max(timestamp) as t from messages group by all) "
    f"select \"group\", name, {q.iso('t')} as time, row_number() over (partition by \"group\" order by t desc, name) as place from e qualify place <= 20"
)
def latest_exports(spark, d):
    rows = files.latest_by(_messages(spark, d), F.coalesce("message_type", F.lit("")), F.col("timestamp"), F.col("src_file"))
    return rows.select("group", "name", times.iso(F.col("time")).alias("time"), "place")


_NOTE = f"case when not {q.filled('content')} and message_type = 'sticker' then '{lines.NO_STICKER_TEXT}' when not {q.filled('content')} and message_type = 'image' then '{lines.NO_IMAGE_TEXT}' else {_C} end"


def _detail(p: str) -> str:
    out = []
    for name, label in lines.LABELS:
        v = f"share_card.{name}"
        if name == "body":
            out.append(f"list_transform({q.lines(v)}, lambda u: '{p}{label}：' || u)")
        else:
            out.append(f"case when {v} is not null and cast({v} as varchar) <> '' then ['{p}{label}：' || cast({v} as varchar)] else [] end")
    return f"case when message_type = 'share' and share_card is not null then flatten([{', '.join(out)}]) else [] end"


def _quotes(a: str, b: str, end: str) -> str:
    x = f"'{a}' || coalesce(quote_meta.original_sender_label, '') || '{end}' || coalesce(quote_meta.original_nickname, '')"
    return f"case when quote_meta is null then [] when coalesce(quote_meta.quoted_text, '') = '' then [{x}] else [{x}, '{b}' || quote_meta.quoted_text] end"


_OWN, _CAP = q.iso("message_time"), f"coalesce({q.iso('timestamp')}, '')"


@query(f"select seq, array_to_string(flatten([{_quotes('引用> ', '引用> ', '：')}, [concat('[', coalesce({_OWN}, {_CAP}), '] ', sender, ' (', message_type, '): ', {_NOTE})], {_detail('')}]), chr(10)) as line from messages")
def render_text(spark, d):
    return _messages(spark, d).select("seq", lines.text_line().alias("line"))


@query(
    f"select seq, array_to_string(flatten([{_quotes('> 引用（', '> ', '）：')}, [concat('- [', case when message_time is not null then {_OWN} || ' (Capture: ' || {_CAP} || ')' else {_CAP} end, '] **', sender, '** (', message_type, '): ', {_NOTE})], {_detail('  - ')}]), chr(10)) as line from messages"
)
def render_markdown(spark, d):
    return _messages(spark, d).select("seq", lines.markdown_line().alias("line"))


@query(f"select seq, concat('- [', {_CAP}, '] ', sender, ': ', content) as line from messages")
def render_merged(spark, d):
    return _messages(spark, d).select("seq", lines.merge_line(times.iso(F.col("timestamp"))).alias("line"))


def _csv(c: str) -> str:
    return f"case when regexp_matches({c}, '[\",\\r\\n]') then '\"' || replace({c}, '\"', '\"\"') || '\"' else coalesce({c}, '') end"


@query(f"select seq, concat_ws(',', {', '.join(_csv(c) for c in ('id', 'sender', 'content', 'message_type', 'raw_ocr_text'))}) as line from messages")
def render_csv(spark, d):
    return _messages(spark, d).select("seq", lines.csv_line(("id", "sender", "content", "message_type", "raw_ocr_text")).alias("line"))


_EXPORTED = f"select id, sender, content, message_type, {q.iso('timestamp')} as timestamp, round(confidence_score, 6) as confidence_score, {q.iso('message_time')} as message_time, share_card.title as title, quote_meta.quoted_text as quoted_text from messages"


def _read_back(rows):
    return rows.select("id", "sender", "content", "message_type", "timestamp", F.round("confidence_score", 6).alias("confidence_score"), "message_time", F.col("share_card.title").alias("title"), F.col("quote_meta.quoted_text").alias("quoted_text"))


@query(_EXPORTED)
def export_json(spark, d):
    """Written as JSON arrays and read back as exports."""
    path = scratch_path(spark, "json")
    out_files.write_json(lines.exported(_messages(spark, d)), path)
    folder, fs = files.hadoop(spark, path)
    for s in fs.listStatus(folder):  # exports are named .json, parts are not
        name = s.getPath().getName()
        if name.startswith("part-"):
            fs.rename(s.getPath(), files.hadoop(spark, f"{path}/{name}.json")[0])
    return _read_back(files.read_exports(spark, [path]))


@query(_EXPORTED)
def export_json_lines(spark, d):
    """Appended as JSON Lines in two calls and read back."""
    path = scratch_path(spark, "lines")
    rows = _messages(spark, d)
    for some in (rows.filter("message_type = 'text'"), rows.filter("message_type <> 'text' or message_type is null")):
        out_files.write_lines(lines.exported(some), path)
    return _read_back(files.read_lines(spark, path, EXPORT))


@query(f"select coalesce(id, '') as id, coalesce(sender, '') as sender, {_C} as content, coalesce(message_type, '') as message_type, coalesce({q.iso('timestamp')}, '') as timestamp, coalesce(raw_ocr_text, '') as raw_ocr_text from messages")
def export_csv(spark, d):
    path = scratch_path(spark, "csv")
    out_files.write_csv(lines.exported(_messages(spark, d), ("confidence_score",)), path)
    back = files.read_csv(spark, path, "id string, sender string, content string, message_type string, timestamp string, raw_ocr_text string")
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query(f"select count(*) as lines from (select unnest(string_split(line, chr(10))) from ({SQL['render_markdown']}) union all select '# ' union all select '')")
def export_markdown(spark, d):
    path = scratch_path(spark, "md")
    out_files.write_text(_messages(spark, d), path, lines.markdown_line(), lines.MARKDOWN_TITLE)
    return spark.read.text(path, lineSep="\n").agg(F.count(F.lit(1)).alias("lines"))


@query(f"with s as (select * from messages where not {_SYSTEM}), m as (select seq, {q.stable()} as k from s qualify row_number() over (partition by {q.stable()} order by seq) = 1), "
    f"i as (select *, {q.stable()} as k from incoming where not {_SYSTEM} qualify row_number() over (partition by {q.stable()} order by seq) = 1) select (select count(*) from m) as first, (select count(*) from i where k not in (select k from m)) as second")  # fmt: skip
def export_twice(spark, d):
    """Both tables saved one after the other in two formats; rows of each file, the second without those of the index."""
    settings = Settings(directory=scratch_path(spark, "out"))
    counts = []
    for n, rows in enumerate(_both(spark, d)):
        paths = out_files.save(rows, settings, f"save{n}", datetime(2024, 1, 1), ["json", "txt"])
        counts.append(spark.read.text(paths[0]).filter("value like '  {%'").count())
    return spark.createDataFrame([tuple(counts)], "first bigint, second bigint")


