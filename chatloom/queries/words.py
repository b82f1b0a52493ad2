"""Functions of texts, times and keys, over all messages or regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import cards, kinds, keys, text, times
from chatloom.operators import privacy
from chatloom.runtime import load

from . import sql as q

query = q.Registry()
QUERIES, SQL = query.queries, query.sql


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "messages")


@query(f"select seq, {q.norm('content')} as content, {q.norm('sender')} as sender from messages")
def fn_norm_text(spark, d):
    return _messages(spark, d).select("seq", text.norm_text(F.col("content")).alias("content"), text.norm_text(F.col("sender")).alias("sender"))


@query(
    f"select seq, {q.stable()} as stable, {q.merge_key()} as merged, concat(lower({q.norm('sender')}), '|', {q.norm('content')}) as content_key, "
    f"concat(lower({q.strip('sender')}), '|', lower({q.strip('content')})) as loose from messages"
)
def fn_keys(spark, d):
    return _messages(spark, d).select("seq", keys.stable_key(F.col("id"), F.col("sender"), F.col("timestamp"), F.col("content")).alias("stable"), keys.merge_key(F.col("id"), F.col("sender"), keys.second(F.col("timestamp")), F.col("content")).alias("merged"), keys.content_key(F.col("sender"), F.col("content")).alias("content_key"), keys.loose_key(F.col("sender"), F.col("content")).alias("loose"))


@query(f"select seq, {q.iso('timestamp')} as captured, {q.iso('message_time')} as told from messages")
def fn_iso_time(spark, d):
    return _messages(spark, d).select("seq", times.iso(F.col("timestamp")).alias("captured"), times.iso(F.col("message_time")).alias("told"))


_T = q.strip("content")


@query(f"select seq, regexp_matches({_T}, '{times.whole(times.STORAGE_FORMS)}') or (regexp_matches({_T}, '{times.STORAGE_LOOSE}') and regexp_matches({_T}, '{times.STORAGE_NEEDS}')) as storage, "
    f"regexp_matches({q.norm('content')}, '{times.whole(times.MERGE_FORMS)}') or (regexp_matches({q.norm('content')}, '{times.MERGE_LOOSE}') and regexp_matches({q.norm('content')}, '{times.MERGE_NEEDS}')) as merged from messages")  # fmt: skip
def fn_only_time(spark, d):
    return _messages(spark, d).select("seq", times.only_time_storage(F.col("content")).alias("storage"), times.only_time_merge(F.col("content")).alias("merged"))


@query(f"select seq, regexp_matches({_T}, '{times.TIME_LINE}') as line, regexp_matches(coalesce(content, ''), '{times.TIME_LIKE}') as probe, regexp_matches({_T}, '{times.whole(times.STRICT_FORMS)}') as strict from messages")
def fn_time_lines(spark, d):
    return _messages(spark, d).select("seq", times.is_time_line(F.col("content")).alias("line"), times.is_time_like(F.col("content")).alias("probe"), times.is_strict_time(F.col("content")).alias("strict"))


_LS = q.lines("content")


@query(
    f"with m as (select seq, content, {_T} as t, {_LS} as ls from messages) select seq, coalesce(content, '') <> '' and len(ls) <= 2 and "
    f"((len(list_filter(ls, lambda u: regexp_matches(u, '{times.TIME_LINE}') or regexp_matches(u, '{times.WEEKDAY_LINE}'))) = len(ls) and not {q.filled(f'''regexp_replace(t, '{times.SEPARATOR_CHARS}', '', 'g')''')}) "
    f"or regexp_matches(t, '{times.WEEKDAY_LINE}')) as separator from m"
)
def fn_separator(spark, d):
    return _messages(spark, d).select("seq", times.is_separator(F.col("content")).alias("separator"))


@query(f"select seq, {q.iso(q.relative('content', 'timestamp'))} as told, {q.iso(q.relative('content', 'timestamp', False))} as scripted from messages where message_type = 'system'")
def fn_relative_time(spark, d):
    rows = _messages(spark, d).filter("message_type = 'system'")
    return rows.select("seq", times.iso(times.parse_relative(F.col("content"), F.col("timestamp"))).alias("told"), times.iso(times.parse_relative(F.col("content"), F.col("timestamp"), False)).alias("scripted"))


_NS = "case when contains(s, 'T') then s else replace(s, ' ', 'T') end"


@query(
    f"with h as (select src_file, split_part({q.strip('timestamp')}, '.', 1) as s from heartbeats), n as (select src_file, {_NS} as s from h) "
    "select src_file, coalesce(strftime(try_strptime(s, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S'), s) as stamp from n"
)
def fn_norm_stamp(spark, d):
    return load(spark, d, "heartbeats").select("src_file", times.norm_stamp(F.col("timestamp")).alias("stamp"))


@query(f"select src_file, {q.iso(q.scan_time('src_file'))} as scanned, count(*) as messages from messages group by src_file")
def fn_file_time(spark, d):
    rows = _messages(spark, d).groupBy("src_file").agg(F.count(F.lit(1)).alias("messages"))
    return rows.select("src_file", times.iso(times.scan_time(F.col("src_file"))).alias("scanned"), "messages")


@query(
    f"with m as (select seq, {_T} as t from messages) select seq, length(t) <= 8 and ({q.has_any('t', kinds.STICKER_WORDS)} or (length(t) > 0 and replace(t, substring(t, 1, 1), '') = '' "
    f"and not regexp_matches(t, '{kinds.PLAIN_CHARS.replace(chr(39), chr(39) * 2)}')) or regexp_matches(t, '{kinds.EMOJI}')) as sticker from m"
)
def fn_sticker(spark, d):
    return _messages(spark, d).select("seq", kinds.sticker_text(F.col("content")).alias("sticker"))


_C = "coalesce(content, '')"
_KIND = f"case when {q.has_any(_C, kinds.IMAGE_HINTS)} then 'image' when {q.has_any(_C, kinds.VOICE_HINTS)} then 'voice' when {q.has_any(_C, kinds.SYSTEM_HINTS)} then 'system' when {q.filled('content')} then 'text' else 'unknown' end"


@query(f"select seq, {_KIND} as kind, {q.has_any(_C, kinds.LOG_WORDS)} as own_log from messages")
def fn_text_kind(spark, d):
    return _messages(spark, d).select("seq", kinds.text_kind(F.col("content")).alias("kind"), kinds.own_log(F.col("content")).alias("own_log"))


@query(
    f"with m as (select seq, content, {_T} as t, lower({_T}) as l from messages) select seq, coalesce(content, '') <> '' and (t in {kinds.GARBAGE_TEXTS} or {q.has_any('t', kinds.GARBAGE_WORDS)} "
    f"or (length(t) < 8 and regexp_matches(t, '{kinds.SYMBOLS.replace(chr(39), chr(39) * 2)}') and not regexp_matches(replace(t, ' ', ''), '^[0-9]+$')) "
    f"or ({q.has_any('l', ('text', 'conf', 'txt'))} and (regexp_matches(l, '{kinds.TEXT_CALL}') or l in {kinds.TEXT_WORDS})) "
    f"or (regexp_matches(t, '{kinds.SHORT_CODE}') and {q.has_any('l', ('0.b', 'o.b'))})) as garbage from m"
)
def fn_garbage(spark, d):
    return _messages(spark, d).select("seq", kinds.garbage(F.col("content")).alias("garbage"))


@query(
    f"with r as (select shot_id, region_seq, confidence, {q.strip('text')} as t, coalesce(confidence, 0) as c from regions), h as (select *, regexp_matches(t, '{kinds.HAN}') as han, length(t) as n from r) "
    "select shot_id, region_seq, confidence, case when c < 0.6 then case when n >= 5 then case when han then c < 0.2 else c < 0.4 end when han then c < 0.3 else true end "
    "else (n <= 2 and not regexp_matches(t, '\\A\\p{Nd}+\\z') and not han) or (n < 5 and not han and not regexp_matches(t, '\\A[\\p{L}\\p{N}]+\\z')) end as image from h"
)
def fn_read_as_image(spark, d):
    return load(spark, d, "regions").select("shot_id", "region_seq", "confidence", kinds.read_as_image(F.col("text"), F.col("confidence")).alias("image"))


@query(
    f"with m as (select seq, {_LS} as ls from messages) select seq, len(ls) >= 2 and not {q.has_any('''lower(array_to_string(ls, chr(10)))''', ('http://', 'https://'))} "
    f"and not {q.has_any('''array_to_string(ls, chr(10))''', kinds.NO_MERGE_WORDS)} and length(array_to_string(ls, '')) <= 400 as merges from m"
)
def fn_merges_as_text(spark, d):
    return _messages(spark, d).select("seq", kinds.merges_as_text(text.lines(F.col("content"))).alias("merges"))


def _label(u: str, name: str) -> str:
    return f"(starts_with({u}, '{name}：') or starts_with({u}, '{name}:'))"


def _value(name: str) -> str:
    last = f"list_filter(ls, lambda u: {_label('u', name)})[-1]"
    mark = f"case when contains({last}, '：') then '：' else ':' end"
    raw = f"substring({last}, strpos({last}, {mark}) + 1)"
    return f"case when {raw} <> '' then {q.strip(raw)} end"


_NUM = f"([0-9]+(?:\\.[0-9]+)?)[{text.WS}]*([万亿]?)"
_PLAYS = f"replace({_value('播放量')}, ',', '')"
_CARD_SQL = (
    f"with a as (select seq, {_LS} as ls from messages), b as (select *, array_to_string(ls, chr(10)) as j, lower(array_to_string(ls, chr(10))) as low from a), "
    "c as (select *, case when list_contains(ls, '小红书') or contains(low, 'xiaohongshu.com') then '小红书' when list_contains(ls, '哔哩哔哩') then '哔哩哔哩' when list_contains(ls, 'bilibili') or contains(low, 'bilibili.com') then 'bilibili' "
    f"when list_contains(ls, '微信小程序') or list_contains(ls, '小程序') or contains(low, 'miniapp') then '微信小程序' end as p, nullif(regexp_extract(j, 'https?://[^{text.WS}]+', 0), '') as url from b), "
    f"e as (select *, {_value('来源')} as src, {_value('UP主')} as up, round_even(try_cast(regexp_extract({_PLAYS}, '{_NUM}', 1) as double) * case regexp_extract({_PLAYS}, '{_NUM}', 2) when '万' then 10000 when '亿' then 100000000 else 1 end, 0) as plays, "
    f"list_filter(ls, lambda u: not ({_label('u', '来源')} or {_label('u', 'UP主')} or {_label('u', '播放量')} or starts_with(u, 'http://') or starts_with(u, 'https://'))) as rest from c "
    "where len(ls) > 0 and (url is not null or contains(j, '来源') or (coalesce(list_contains(ls, p), false) and len(ls) >= 3))), "
    "f as (select *, coalesce(rest[1] = p and len(rest) >= 2, false) as led from e) "
    "select seq, coalesce(p, '分享') as platform, case when led then rest[2] else coalesce(rest[1], ls[1]) end as title, nullif(array_to_string(case when led then rest[3:] else rest[2:] end, chr(10)), '') as body, "
    "coalesce(nullif(src, ''), case when p = '微信小程序' and contains(j, '星巴克') then '星巴克' end, p) as source, up as up_name, cast(cast(plays as bigint) as varchar) as play_count, url as canonical_url from f"
)


@query(_CARD_SQL)
def fn_share_card(spark, d):
    rows = _messages(spark, d).select("seq", cards.share_card(F.col("content")).alias("c"))
    return rows.filter("c is not null").select("seq", "c.*").withColumn("play_count", F.col("play_count").cast("string"))


def _tl(u: str) -> str:
    return f"regexp_matches({u}, '{times.TIME_LINE}')"


@query(
    f"with a as (select seq, {_LS} as ls from messages), b as (select *, len(ls) >= 3 and not {_tl('ls[1]')} and not {_tl('ls[2]')} as quoted from a) "
    f"select seq, {q.strip('''replace(replace(ls[1], '<', ''), '>', '')''')} as nickname, case when starts_with({q.strip('''replace(replace(ls[1], '<', ''), '>', '')''')}, '我') then '我' else '对方' end as label, ls[2] as quoted_text, "
    f"array_to_string(list_concat([ls[2]], list_filter(ls[3:], lambda u: not {_tl('u')})), chr(10)) as rest from b where quoted"
)
def fn_quote(spark, d):
    ls = text.lines(F.col("content"))
    rows = _messages(spark, d).select("seq", ls.alias("ls")).filter(cards.quoted(F.col("ls")))
    rows = rows.select("seq", cards.quote_meta(F.col("ls")).alias("m"), F.array_join(cards.without_quote(F.col("ls")), "\n").alias("rest"))
    return rows.select("seq", F.col("m.original_nickname").alias("nickname"), F.col("m.original_sender_label").alias("label"), F.col("m.quoted_text").alias("quoted_text"), "rest")


_FILE_LINES = "select {k}, unnest(string_split_regex({c}, '\\r\\n|[\\n\\r]')) as l, generate_subscripts(string_split_regex({c}, '\\r\\n|[\\n\\r]'), 1) as line_no from {t}"


@query(f"with x as ({_FILE_LINES.format(k='doc_id', c='text', t='documents')}) select doc_id, cast(line_no as int) as line_no, {q.strip('l')} as line from x where {q.strip('l')} <> ''")
def src_text_lines(spark, d):
    return privacy.text_lines(load(spark, d, "documents"), ["doc_id"], F.col("text"))


_HITS = " union all ".join(f"select seq, line_no, '{level}' as level, '{name}' as pattern, line from y where regexp_matches(line, '{p}')" for name, level, p in text.PRIVACY)
_Y = f"with x as ({_FILE_LINES.format(k='seq', c='content', t='messages')}), y as (select seq, cast(line_no as int) as line_no, {q.strip('l')} as line from x where {q.strip('l')} <> '')"


@query(f"{_Y} {_HITS}")
def privacy_hits(spark, d):
    return privacy.scan(privacy.text_lines(_messages(spark, d), ["seq"], F.col("content")), ["seq"])


@query(
    f"{_Y}, h as ({_HITS}), s as (select distinct level from h) select concat(' - ', seq, ':', line_no, ' | pattern=', pattern, ' | ', substring(line, 1, 200)) as line from h "
    "union all select '[ERROR] 发现高危敏感信息：' from s where level = 'error' union all select '[WARNING] 发现可能的敏感信息：' from s where level = 'warning' "
    "union all select '=== 隐私扫描报告 ===' where exists (from s) union all select '====================' where exists (from s)"
)
def privacy_report(spark, d):
    return privacy.report(privacy_hits(spark, d), "seq").select("line")


@query(
    "with m as (select seq, string_split(coalesce(content, ''), '') as a, string_split(coalesce(raw_ocr_text, ''), '') as b, coalesce(content, '') <> '' and coalesce(raw_ocr_text, '') <> '' as filled from messages) "
    "select seq, round(case when filled then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) else 0 end, 9) as jaccard from m"
)
def agg_char_jaccard(spark, d):
    return _messages(spark, d).select("seq", F.round(text.char_jaccard(F.col("content"), F.col("raw_ocr_text")), 9).alias("jaccard"))


@query(f"select size, case when regexp_matches(size, '^[0-9]+MB$') then cast(regexp_extract(size, '[0-9]+') as bigint) * 1048576 else 10485760 end as bytes from (select concat(seq, case when seq % 2 = 0 then 'MB' else 'x' end) as size from messages)")
def fn_size(spark, d):
    size = F.concat(F.col("seq").cast("string"), F.when(F.col("seq") % 2 == 0, "MB").otherwise("x"))
    return _messages(spark, d).select(size.alias("size"), text.parse_size(size).alias("bytes"))
