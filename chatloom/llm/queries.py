"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.runtime import load

from . import encode, exact, history, mixing, near, personal, scanned, subjects, surrogates, unify


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.found(load(spark, sf_dir, "messages"))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.mask(load(spark, sf_dir, "messages")).select("seq", "content")


def p1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(load(spark, sf_dir, "messages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.alike_pairs(load(spark, sf_dir, "messages"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(load(spark, sf_dir, "messages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.changed(load(spark, sf_dir, "messages")).select("seq", "field")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unify(load(spark, sf_dir, "messages")).select("seq", "content", "sender")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, incoming = load(spark, sf_dir, "messages", "incoming")
    return history.repeats(messages, incoming)


def p6_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, incoming = load(spark, sf_dir, "messages", "incoming")
    return history.accepted(messages, incoming).select("seq", "sender", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.noises(load(spark, sf_dir, "messages"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.paragraphs(load(spark, sf_dir, "messages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.copies(load(spark, sf_dir, "messages"))
    return found.filter("seq <> lowest").select(F.col("lowest").alias("seq_a"), F.col("seq").alias("seq_b"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.collapse(load(spark, sf_dir, "messages")).select("seq", "sender", "content", "copies")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(load(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = load(spark, sf_dir, "documents", "mix_targets")
    sizes = mixing.sized(docs)
    return mixing.mixture(sizes, mixing.plan(sizes, targets))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = load(spark, sf_dir, "documents", "mix_targets")
    sizes = mixing.sized(docs)
    planned = mixing.plan(sizes, targets)
    return mixing.shares(mixing.mixture(sizes, planned), planned)


def p8_corpus_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the corpus: sources that are too small stop at their cap."""
    docs, targets = load(spark, sf_dir, "documents", "mix_targets")
    sizes = mixing.sized(docs)
    planned = mixing.plan(sizes, targets, sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    return mixing.shares(mixing.mixture(sizes, planned), planned)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.about(*load(spark, sf_dir, "documents", "doc_labels", "subjects"))


def p9_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p1_surrogates, p2_found, p2_groups, p3_found, p3_unified, p4_found, p4_paragraphs, p5_found, p5_collapsed, p6_found, p6_accepted, p7_ids, p8_mixture, p8_shares, p8_corpus_shares, p9_found, p9_measured)}

_CANON = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_SORTED = "(select string_agg(x, chr(10) order by x) from (select regexp_replace(lower(u), '[^\\p{L}\\p{N}]', '', 'g') as x from unnest(string_split_regex(coalesce(content, ''), '\\r\\n|[\\n\\r]')) as t(u)) where x <> '')"
# copies share the plain form, or, both being shares, the sorted lines; lowest rows go from one form to the other
_COPIES = (
    f"with k as (select *, {_CANON.format('sender')} || '|' || coalesce(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), '-') as w, {_CANON.format('content')} as b, case when lower(message_type) = 'share' then {_SORTED} end as l from messages), "
    "k1 as (select *, min(seq) over (partition by w, b) as m1 from k), k2 as (select *, case when l is null then m1 else min(m1) over (partition by w, l) end as m2 from k1), "
    "k3 as (select *, min(m2) over (partition by w, b) as m3 from k2), k4 as (select *, case when l is null then m3 else min(m3) over (partition by w, l) end as m4 from k3), g as (select *, min(m4) over (partition by w, b) as lowest from k4) "
)

_ALIKE_TEXT = _CANON.format("case when regexp_matches(coalesce(content, ''), '[^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') then content else raw_ocr_text end".replace("{{", "{").replace("}}", "}"))


def _alike(rows: str, same: str) -> str:
    """CTEs up to ``pairs (a, b)``, a < b, of rows ``seq, who, t`` whose texts are alike; ``same`` limits them."""
    return (
        f"c as (select who, t, min(seq) as rep, list(seq) as seqs from {rows} where length(t) >= 100 group by all), g as (select rep, who, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) as x from c), "
        f"n as (select rep, count(*) as n from g group by 1), m as (select a.rep as a, b.rep as b, count(*) as k from g a join g b on a.x = b.x and a.rep < b.rep {same} group by 1, 2), "
        "l as (select a, b from m join n na on na.rep = a join n nb on nb.rep = b where k >= 0.6 * (na.n + nb.n - k)), joined as (select a, b from l union all select rep, rep from c), "
        "e as (select unnest(ca.seqs) as x, cb.seqs as ys from joined join c ca on ca.rep = a join c cb on cb.rep = b), f as (select x, unnest(ys) as y from e), pairs as (select distinct least(x, y) as a, greatest(x, y) as b from f where x <> y)"
    )


_P2 = f"with r as (select seq, '' as who, {_ALIKE_TEXT} as t from messages), {_alike('r', '')}"
_P6 = (
    f"with r as (select seq, nullif(id, '') as id, case when sender is not null then {_CANON.format('sender')} end as who, {_ALIKE_TEXT} as t, batch from (select seq, id, sender, content, raw_ocr_text, false as batch from messages union all select seq, id, sender, content, raw_ocr_text, true from incoming)), "
    f"s as (select * from r where who is not null), {_alike('s', 'and a.who = b.who')}, i as (select id, min(seq) as a from r where trim(id) <> '' group by id), "
    "u as (select a, b from pairs union all select i.a, r.seq from r join i using (id) where i.a < r.seq), found as (select min(a) as seq_a, b as seq_b from u join r on r.seq = b where r.batch group by b)"
)

SQL = {
    "p2_found": f"{_P2} select a as seq_a, b as seq_b from pairs",
    "p2_groups": f"{_P2.replace('with r', 'with recursive r', 1)}, q as (select a, b from pairs union all select b, a from pairs), z(v, g) as (select seq, seq from r where length(t) >= 100 union select q.b, z.g from z join q on q.a = z.v) "
    "select v as seq, min(g) as \"group\", (select count(*) from q where q.a = v) as links from z group by v",
    "p6_found": f"{_P6} select seq_a, seq_b from found",
    "p6_accepted": f"{_P6} select seq, sender, content from incoming where seq not in (select seq_b from found)",
    "p5_found": f"{_COPIES} select lowest as seq_a, seq as seq_b from g where seq <> lowest",
    "p5_collapsed": f"{_COPIES}, n as (select lowest, count(*) as copies from g group by lowest) select seq, sender, content, copies from g join n using (lowest) where seq = lowest",
}
