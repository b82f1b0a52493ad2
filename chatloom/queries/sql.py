"""Pieces of SQL for DuckDB, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from chatloom.functions.text import LINE_END, STRIP, WS


class Registry:
    """Queries by name, and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def take(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return take


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{STRIP}', '', 'g')"


def filled(c: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), '[^{WS}]')"


def lines(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '{LINE_END}'), lambda u: {strip('u')}), lambda u: u <> '')"


def norm(c: str) -> str:
    plain = f"replace(regexp_replace(coalesce({c}, ''), '[\\x{{200B}}-\\x{{200F}}]', '', 'g'), '：', ':')"
    return f"regexp_replace({strip(plain)}, '[{WS}]+', ' ', 'g')"


def iso(c: str) -> str:
    return f"regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


def second(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S'), '')"


def has_any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def stable(p: str = "") -> str:
    return f"case when coalesce({p}id, '') <> '' then {p}id else concat(coalesce({p}sender, ''), '|', coalesce({iso(p + 'timestamp')}, ''), '|', {strip(p + 'content')}) end"


def merge_key() -> str:
    return f"case when {strip('id')} <> '' then concat('id:', {strip('id')}) else concat(lower({norm('sender')}), '|', {second('timestamp')}, '|', {norm('content')}) end"


def digits(c: str) -> str:
    return f"translate({strip(c)}, '０１２３４５６７８９', '0123456789')"


def relative(c: str, ref: str, periods: bool = True) -> str:
    """The time a text names, by the rules of ``parse_relative``."""
    s, t = f"[{WS}]*", digits(c)
    part = f"(?:(凌晨|早上|上午|中午|下午|晚上){s})?" if periods else "()"
    dated = rf"\A(?:(?:([0-9]{{4}})年)?([0-9]{{1,2}})月([0-9]{{1,2}})日|(昨天)|星期([一二三四五六日天])){s}{part}([0-9]{{1,2}})([:：])([0-9]{{1,2}})"
    plain = rf"\A{part}([0-9]{{1,2}})[:：]([0-9]{{1,2}})\z"
    g = lambda i, p=dated: f"regexp_extract({t}, '{p}', {i})"
    n = lambda i, p=dated: f"try_cast({g(i, p)} as int)"
    hour = lambda h, p: f"(case when {p} in ('下午', '晚上') and {h} < 12 then {h} + 12 when {p} = '凌晨' and {h} = 12 then 0 else {h} end)"
    made = lambda date, h, m: f"try_strptime({date} || ' ' || {h} || ':' || {m}, '%Y-%m-%d %H:%M')"
    back = f"(dayofweek({ref}) + 6 - (strpos('一二三四五六日', replace({g(5)}, '天', '日')) - 1)) % 7"
    days = f"case when {g(4)} <> '' then 1 when {back} = 0 then 7 else {back} end"
    date = f"case when {g(3)} <> '' then coalesce(nullif({g(1)}, ''), strftime({ref}, '%Y')) || '-' || {g(2)} || '-' || {g(3)} else strftime({ref} - to_days(cast({days} as int)), '%Y-%m-%d') end"
    named = made(f"({date})", hour(n(7), g(6)), n(9))
    if not periods:
        named = f"case when {g(1)} = '' or {g(8)} = ':' then {named} end"
    today = made(f"strftime({ref}, '%Y-%m-%d')", hour(n(2, plain), g(1, plain)), n(3, plain))
    return f"coalesce(case when regexp_matches({t}, '{dated}') then {named} when regexp_matches({t}, '{plain}') then {today} end, {ref})"


def scan_time(c: str) -> str:
    return f"try_strptime(regexp_extract({c}, '([0-9]{{8}}_[0-9]{{6}})', 1), '%Y%m%d_%H%M%S')"


def first_by(table: str, key: str, columns: str = "*", order: str = "seq") -> str:
    return f"select {columns} from {table} qualify row_number() over (partition by {key} order by {order}) = 1"
