"""Regions, bubbles, parsed messages, hashes, pictures and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import boxes, images, kinds, times
from chatloom.operators import bubbles as B
from chatloom.operators import near, parse, stats
from chatloom.runtime import load, scratch_path
from chatloom.schema import HEARTBEAT
from chatloom.sinks import metrics
from chatloom.sources import recognised
from chatloom.streaming.tail import alert_stream

from . import sql as q

query = q.Registry()
QUERIES, SQL = query.queries, query.sql
_SHOTS = (
    "with r as (select shot_id, coalesce(region_seq, 0) as region_seq, coalesce(text, '') as text, coalesce(x, 0) as x, coalesce(y, 0) as y, coalesce(width, 0) as width, coalesce(height, 0) as height, confidence, coalesce(type, 'text') as type from regions where shot_id is not null), "
    "l as (select *, y - lag(y + height) over w as gap, abs(x - lag(x) over w) as dx from r window w as (partition by shot_id order by y, x, region_seq, width, height, confidence nulls first, text)), "
    "n as (select *, cast(sum(case when gap is null or gap > 12 or dx > 40 then 1 else 0 end) over (partition by shot_id order by y, x, region_seq, width, height, confidence nulls first, text rows unbounded preceding) as int) as bubble, max(x + width) over (partition by shot_id) as far from r natural join l)"
).replace("r natural join l", "l")


def _regions(spark, d):
    return load(spark, d, "regions")


@query(f"{_SHOTS} select shot_id, region_seq, bubble, round(confidence, 6) as confidence, case when far > 0 then cast(floor(far * 0.5) as int) end as split_x from n")
def seq_bubbles(spark, d):
    rows = B.split_line(B.numbered(_regions(spark, d)))
    return rows.select("shot_id", "region_seq", "bubble", F.round("confidence", 6).alias("confidence"), "split_x")


_BUBBLES = (
    f"{_SHOTS}, b as (select shot_id, bubble, list({q.strip('text')} order by y, x, region_seq, width, height, confidence nulls first, text) as ls, string_agg(text, ' ' order by y, x, region_seq, width, height, confidence nulls first, text) as raw_text, "
    "coalesce(avg(confidence), 0) as confidence, avg(x + greatest(width, 1) / 2) as center_x, min(x) as x, min(y) as y, greatest(1, max(x + width) - min(x)) as width, greatest(1, max(y + height) - min(y)) as height, max(cast(floor(far * 0.5) as int)) as split_x, count(*) as n, max(height) as tallest, bool_or(type in ('image', 'sticker')) as img, bool_or(type = 'sticker') as stk from n group by all), "
    "c as (select *, array_to_string(list_filter(ls, lambda u: u <> ''), chr(10)) as content from b)"
)


@query(f"{_BUBBLES} select shot_id, bubble, content, raw_text, round(confidence, 6) as confidence, round(center_x, 6) as center_x, x, y, width, height, case when center_x >= split_x then '我' else '对方' end as sender from c")
def agg_bubbles(spark, d):
    rows = B.bubbles(_regions(spark, d))
    return rows.select("shot_id", "bubble", "content", "raw_text", F.round("confidence", 6).alias("confidence"), F.round("center_x", 6).alias("center_x"), "x", "y", "width", "height", "sender")


_N = f"length({q.strip('content')})"


@query(
    f"{_BUBBLES} select shot_id, bubble, tallest >= 60 or (n <= 10 and ((height > 150 and height / n > 60) or ({q.has_any('content', kinds.POSTER_WORDS)} and height >= 120) or (width * height > 40000 and {_N} < 30) or height > 300 "
    f"or (width * height between 900 and 40000 and {_N} < 8 and confidence < 0.6))) as pictured, case when stk then 'sticker' when img or (least(width, height) >= 40 and width * height >= 2000 and width / height between 0.2 and 5) then case when width / height between 0.8 and 1.25 and width * height <= 25000 then 'sticker' else 'image' end else 'unknown' end as empty_kind from c"
)
def fn_bubble_kind(spark, d):
    rows = B.bubbles(_regions(spark, d))
    tallest = F.array_max(F.transform("regions", lambda r: r["height"]))
    pictured = kinds.image_with_text(tallest, F.col("height"), F.col("width"), F.size("regions"), F.col("confidence"), F.col("content"))
    has = lambda *t: F.exists("regions", lambda r: r["type"].isin(*t))
    empty = kinds.empty_kind(F.col("width"), F.col("height"), has("image", "sticker"), has("sticker"), F.lit(False))
    return rows.select("shot_id", "bubble", pictured.alias("pictured"), empty.alias("empty_kind"))


@query(
    f"{_SHOTS}, o as (select *, row_number() over (partition by shot_id, bubble order by y, x, region_seq, width, height, confidence nulls first, text) as i from n), g as (select *, greatest(0, y - lag(y + height) over (partition by shot_id, bubble order by i)) as vgap from o) "
    "select shot_id, bubble, count(*) between 3 and 12 and coalesce(max(vgap), 0) / greatest(1, avg(height)) <= 0.6 and stddev_pop(x) <= 15 as compact from g group by all"
)
def seq_compact(spark, d):
    return B.bubbles(_regions(spark, d)).select("shot_id", "bubble", parse.is_compact(F.col("regions")).alias("compact"))


def _parsed(spark, d):
    return parse.parse(_regions(spark, d), F.lit("2024-06-01 12:00:00").cast("timestamp_ntz"))


@query()
def parse_messages(spark, d):
    """Whole screenshots to messages; ``tests/test_parse.py`` holds known cases."""
    rows = _parsed(spark, d)
    return rows.select("id", "sender", "content", "message_type", times.iso(F.col("timestamp")).alias("timestamp"), F.round("confidence_score", 6).alias("confidence_score"), "raw_ocr_text", F.col("share_card.title").alias("title"), F.col("quote_meta.quoted_text").alias("quoted_text"))


@query()
def parse_counts(spark, d):
    """Messages by type, with their mean confidence over the bubbles they took."""
    return _parsed(spark, d).groupBy("message_type").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg("confidence_score"), 6).alias("confidence"))


_WRITTEN = f"from regions where shot_id is not null and {q.strip('text')} <> ''"


@query(f"select shot_id, string_agg(text, chr(10) order by region_seq, y, x, text) as text, round(coalesce(avg(confidence), 0), 6) as confidence, count(*) as regions {_WRITTEN} group by shot_id")
def agg_recognised(spark, d):
    rows = stats.recognised(_regions(spark, d))
    return rows.select("shot_id", "text", F.round("confidence", 6).alias("confidence"), "regions")


@query(f"select shot_id, coalesce(median(width), 0) as width, coalesce(median(height), 0) as height, coalesce(median(width * height), 0) as area {_WRITTEN} group by shot_id")
def agg_text_medians(spark, d):
    return stats.text_medians(_regions(spark, d).filter("shot_id is not null"), "shot_id")


@query("select shot_id, region_seq, text, x, y, width, height, round(coalesce(confidence, 0), 6) as confidence from regions where text <> '' and confidence >= 0.7")
def src_regions(spark, d):
    """Regions as a recogniser's JSON, one object for each screenshot, read back."""
    rows = _regions(spark, d).withColumn("shot_id", F.concat_ws("@", "shot_id", F.monotonically_increasing_id()))
    polygon = F.array(F.array("x", "y"), F.array(F.col("x") + F.col("width"), F.col("y")), F.array(F.col("x") + F.col("width"), F.col("y") + F.col("height")), F.array("x", F.col("y") + F.col("height")))
    result = F.to_json(F.struct(F.array(F.coalesce("text", F.lit(""))).alias("rec_texts"), F.array("confidence").alias("rec_scores"), F.array(polygon).alias("rec_polys")), {"ignoreNullFields": "false"})
    read = recognised.read_results(rows.select("shot_id", F.col("region_seq").alias("n"), result.alias("result")), ["shot_id", "n"], "result")
    return read.select(F.substring_index("shot_id", "@", 1).alias("shot_id"), F.col("n").alias("region_seq"), "text", "x", "y", "width", "height", F.round("confidence", 6).alias("confidence"))


def _iou(a: str, b: str) -> str:
    i = f"(greatest(0, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y)))"
    u = f"({a}.width * {a}.height + {b}.width * {b}.height - {i})"
    return f"(case when {u} > 0 then {i} / {u} else 0 end)"


@query(f"with r as (select distinct shot_id, region_seq as id, x, y, width, height from regions where shot_id is not null) select a.shot_id, a.id as a, b.id as b, round({_iou('a', 'b')}, 6) as iou from r a join r b using (shot_id) where a.id <= b.id and {_iou('a', 'b')} >= 0.65")
def join_iou(spark, d):
    one = _regions(spark, d).filter("shot_id is not null").select("shot_id", F.col("region_seq").alias("id"), "x", "y", "width", "height").distinct()
    return near.iou_pairs(one, one, "shot_id").filter("a <= b").select("shot_id", "a", "b", F.round("iou", 6).alias("iou")).distinct()


_AREA = "greatest(0, least(k.x + k.width, r.x + r.width) - greatest(k.x, r.x)) * greatest(0, least(k.y + k.height, r.y + r.height) - greatest(k.y, r.y))"


@query(
    "with recursive r as (select shot_id, x, y, width, height, row_number() over (partition by shot_id order by width * height desc, region_seq, x, y, width, height) as i from regions where shot_id is not null), "
    "s(shot_id, i, kept) using key (shot_id) as (select shot_id, 1, [{'x': x, 'y': y, 'width': width, 'height': height}] from r where i = 1 union "
    f"select s.shot_id, s.i + 1, case when len(list_filter(s.kept, lambda k: ({_AREA}) > 0.7 * r.width * r.height)) > 0 then s.kept else list_append(s.kept, {{'x': r.x, 'y': r.y, 'width': r.width, 'height': r.height}}) end from s join r on r.shot_id = s.shot_id and r.i = s.i + 1), "
    "u as (select shot_id, unnest(kept) as k from s) select shot_id, k.x as x, k.y as y, k.width as width, k.height as height from u"
)
def join_without_overlaps(spark, d):
    return near.without_overlaps(_regions(spark, d))


@query(
    "with r as (select *, width * height as area, count(*) over (partition by shot_id) as n, row_number() over (partition by shot_id order by width * height desc, region_seq, x, y, confidence nulls first) as k from regions where shot_id is not null), "
    "s as (select *, k > 2 and least(width, height) >= 20 and area >= 400 as media, case when area > 0 then least(width, height) / greatest(width, height) * area else 0 end as score, row_number() over (partition by shot_id, x, y, width, height order by k) as same from r), "
    "p as (select *, row_number() over (partition by shot_id, media order by score desc, k) as place from s) select shot_id, region_seq, x, y, round(confidence, 6) as confidence from p where n <= 6 or k <= 2 or (media and place <= 4 and same = 1)"
)
def topk_regions(spark, d):
    return near.top_regions(_regions(spark, d), 6).select("shot_id", "region_seq", "x", "y", F.round("confidence", 6).alias("confidence"))


@query()
def join_closest_title(spark, d):
    return near.closest_title(_regions(spark, d), "有人撤回了一条消息")


@query(
    f"with m as (select shot_id, median(width) as mw, median(height) as mh, median(width * height) as ma {_WRITTEN} group by shot_id), e as (select r.*, coalesce(mw, 0) as mw, coalesce(mh, 0) as mh, coalesce(ma, 0) as ma, width * height as area, least(width, height) as low, width / greatest(height, 1) as aspect "
    f"from regions r left join m using (shot_id) where shot_id is not null and {q.strip('text')} = ''), s as (select * from e where low >= 10 and (area / 921600 >= 0.0001 or area >= 100) and aspect between 0.2 and 5 and ((mw > 0 and width >= mw * 1.6) or (mh > 0 and height >= mh * 1.6) or (ma > 0 and area >= ma * 2.4) "
    "or (mw = 0 and mh = 0 and ma = 0 and (low >= 30 or area >= 900)) or (aspect between 0.4 and 2.5 and low >= 20 and area >= 400))) "
    "select shot_id, region_seq, width, height, round(confidence, 6) as confidence, case when aspect between 0.75 and 1.35 and low between 40 and 340 and greatest(width, height) <= 274 and area / 921600 <= 0.1 then 'sticker' else 'image' end as kind from s "
    f"where not exists (select 1 from regions t where t.shot_id = s.shot_id and {q.strip('t.text')} <> '' and {_iou('s', 't')} >= 0.65)"
)
def filter_media_regions(spark, d):
    rows = near.media_regions(_regions(spark, d), F.lit(720), F.lit(1280))
    return rows.select("shot_id", "region_seq", "width", "height", F.round("confidence", 6).alias("confidence"), "kind")


_SIGNS = "select vec_id, list_sum(list_transform(embedding, lambda v, i: case when v > 0 then cast(1 as hugeint) << cast(i - 1 as int) else 0 end)) as h from embeddings"


def _hashes(spark, d):
    bits = F.transform("embedding", lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return load(spark, d, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)).alias("h"))


_PAIRS = f"with s as ({_SIGNS}), f as (select min(vec_id) as i, h from s group by h), p as (select a.i as a, b.i as b, bit_count(xor(a.h, b.h)) as distance from f a join f b on a.i < b.i)"


@query(f"{_PAIRS} select a, b, cast(distance as int) as distance from p where distance <= 18")
def join_hamming(spark, d):
    return near.hamming_pairs(_hashes(spark, d), "vec_id", "h", 18)


@query(
    f"with recursive s as ({_SIGNS}), r as (select vec_id, h, row_number() over (order by vec_id) as i from s), "
    "t(one, i, ids, hs) using key (one) as (select 1, 1, [vec_id], [h] from r where i = 1 union "
    "select 1, t.i + 1, case when len(list_filter(t.hs, lambda k: bit_count(xor(k, r.h)) <= 18)) > 0 then t.ids else list_append(t.ids, r.vec_id) end, "
    "case when len(list_filter(t.hs, lambda k: bit_count(xor(k, r.h)) <= 18)) > 0 then t.hs else list_append(t.hs, r.h) end from t join r on r.i = t.i + 1) select unnest(ids) as vec_id from t"
)
def dedup_near_hashes(spark, d):
    return near.first_of_near(_hashes(spark, d), "vec_id", "h", 18)


def _pictures(spark, d):
    """Embeddings as grey pictures of 8 x 8."""
    cells = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 1) * 127.5).cast("int"))).cast("bigint")), 2, "0"))
    return load(spark, d, "embeddings").select("vec_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(cells, "")).alias("pixels")).alias("image"))


@query(
    "with p as (select vec_id, list_transform(embedding, lambda v: greatest(0, least(255, floor((cast(v as double) + 1) * 127.5)))) as c from embeddings) "
    "select vec_id, round(list_avg(c), 6) as mean, round(list_stddev_pop(c), 6) as std, cast(list_min(c) as int) as low, cast(list_max(c) as int) as high, cast(list_max(c) - list_min(c) as int) as contrast, len(list_distinct(c)) as colours from p"
)
def img_statistics(spark, d):
    found = images.measure(images.statistics, "struct<mean:double,std:double,min:int,max:int,contrast:int,colours:bigint>", F.col("image"))
    return _pictures(spark, d).select("vec_id", found.alias("s")).select("vec_id", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"), F.col("s.min").alias("low"), F.col("s.max").alias("high"), "s.contrast", "s.colours")


@query()
def img_measures(spark, d):
    image = F.col("image")
    rows = _pictures(spark, d)
    return rows.select(
        "vec_id", images.measure(images.difference_hash, "bigint", image).alias("hash"), images.measure(images.cache_key, "string", image).alias("cache_key"),
        F.round(images.measure(images.quality, "double", image), 6).alias("quality"), images.measure(images.plain_background, "boolean", image).alias("plain"), images.measure(images.valid_picture, "boolean", image).alias("valid"),
    )


@query("select src_file, regexp_replace(timestamp, ' ', 'T') as timestamp, lower(trim(status)) as status, coalesce(messages, 0) as messages, coalesce(attempts, 0) as attempts, coalesce(cpu_percent, 0) as cpu_percent, coalesce(memory_mb, 0) as memory_mb from heartbeats")
def beat_rows(spark, d):
    return metrics.heartbeats(load(spark, d, "heartbeats"), "src_file")


_ALERTS = "select timestamp, 'cpu' as alert, round(cpu_percent, 6) as cpu_percent from heartbeats where cpu_percent >= 60 union all select timestamp, 'memory', round(cpu_percent, 6) from heartbeats where memory_mb >= 500"


@query(_ALERTS)
def beat_alerts(spark, d):
    return metrics.alerts(load(spark, d, "heartbeats"), 60, 500).select("timestamp", "alert", F.round("cpu_percent", 6).alias("cpu_percent"))


@query(_ALERTS)
def beat_alert_stream(spark, d):
    """Heartbeats as files of a stream; its alerts."""
    inbox, out = scratch_path(spark, "beats"), scratch_path(spark, "alerts")
    load(spark, d, "heartbeats").drop("src_file").write.json(inbox)
    found = alert_stream(spark.readStream.schema(HEARTBEAT).json(inbox), 60, 500)
    found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("timestamp", "alert", F.round("cpu_percent", 6).alias("cpu_percent"))


@query(
    "with s as (select src_file, count(*) as scrolls, coalesce(sum(messages), 0) as messages, cast(epoch(max(cast(timestamp as timestamp)) - min(cast(timestamp as timestamp))) as bigint) as seconds from heartbeats group by 1) "
    "select src_file, scrolls, cast(messages as bigint) as messages, seconds, round(coalesce(scrolls * 60 / nullif(seconds, 0), 0), 6) as per_minute, round(messages / scrolls, 6) as per_scroll from s"
)
def beat_scroll_statistics(spark, d):
    rows = load(spark, d, "heartbeats").withColumn("t", times.read_stamp(times.norm_stamp(F.col("timestamp"))))
    found = stats.scroll_statistics(rows, "src_file", F.col("t"), F.col("messages"))
    return found.select("src_file", "scrolls", "messages", "seconds", F.round("per_minute", 6).alias("per_minute"), F.round("per_scroll", 6).alias("per_scroll"))


@query("select event_type, count(*) as calls, round(sum(value) / count(*), 6) as average, count_if(user_id % 3 = 0) as hits, count_if(user_id % 3 = 1) as misses, round(coalesce(count_if(user_id % 3 = 0) / nullif(count_if(user_id % 3 < 2), 0), 0), 6) as hit_rate from events group by 1")
def agg_latency(spark, d):
    k = F.pmod("user_id", F.lit(3))
    found = stats.latency(load(spark, d, "events"), "event_type", F.col("value"), F.when(k == 0, True).when(k == 1, False))
    return found.select("event_type", "calls", F.round("average", 6).alias("average"), "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


@query("select event_type as cache, cast(sum(user_id % 5) as bigint) as hits, cast(sum(user_id % 7) as bigint) as misses, cast(count_if(value > 10) as bigint) as evictions, round(coalesce(sum(user_id % 5) / nullif(sum(user_id % 5) + sum(user_id % 7), 0), 0), 6) as hit_rate from events group by 1")
def agg_cache_stats(spark, d):
    rows = load(spark, d, "events").select(F.col("event_type").alias("cache"), (F.col("user_id") % 5).alias("hits"), (F.col("user_id") % 7).alias("misses"), (F.col("value") > 10).cast("int").alias("evictions"))
    return metrics.cache_stats(rows).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "with c as (select coalesce(src_file, '') as src_file, cast(timestamp as date) as d, count(*) as n from messages where timestamp is not null group by all), m as (select src_file, median(n) as m from c group by 1), t as (select src_file, greatest(any_value(m) + 3 * median(abs(n - m)), 6) as t from c join m using (src_file) group by 1) "
    "select src_file, strftime(d, '%Y-%m-%d') as day, n, t as threshold from c join t using (src_file) where n >= t"
)
def agg_active_days(spark, d):
    rows = load(spark, d, "messages").filter("timestamp is not null")
    counts = rows.groupBy(F.coalesce("src_file", F.lit("")).alias("src_file"), F.to_date("timestamp").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return stats.active(counts, ["src_file"], "n", 6).select("src_file", F.date_format("d", "yyyy-MM-dd").alias("day"), "n", "threshold")


@query("select shot_id, region_seq, round(least(coalesce(confidence, 0) * 0.7 + least(width, height) / greatest(width, height, 1) * 0.3, 1), 6) as enhanced from regions")
def fn_enhanced_confidence(spark, d):
    shape = F.least("width", "height") / F.greatest("width", "height", F.lit(1))
    return _regions(spark, d).select("shot_id", "region_seq", F.round(boxes.enhanced_confidence(F.coalesce("confidence", F.lit(0.0)), shape), 6).alias("enhanced"))
