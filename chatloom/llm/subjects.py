"""Problem 9: subjects of documents by a seeded non-negative factorisation of sentences.

Each subject is a column of term weights, seeded with the labelled documents' terms and the subject's titles; further
columns take the small talk. A term counts by how specific to few subjects it is, so that words of every subject decide
nothing. In training, a sentence may only use the columns of its document's labels and of small talk
(Kullback-Leibler multiplicative updates). Then every sentence of every document is folded in and counts for the column
that holds most of it; a document is about a subject that enough of its sentences count for.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from chatloom.runtime import bounded_sample

#: At least about a third of the sentences are asked for, a tenth or less is a remark; this lies between.
LEAST_SHARE = 0.22
SMALL_TALK, TRAIN_ROUNDS, FOLD_ROUNDS = 2, 30, 5
#: Labelled documents used for training, about, the same ones in every run; terms in fewer sentences are left out.
MODEL_DOCS, LEAST_SENTENCES = 3000, 3
LEAST_WEIGHT = 0.02
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPLIT = re.compile(r"[-‐‑][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_CLOCK = re.compile(r"\d:\d\d")
_SPEAKER = re.compile(r"(?m)^[>\s]*\[\d{1,2}:\d\d\][^\n:：]{0,40}[:：]\s*|^[>\s]*[^\n。！？]{1,25}\s\d{1,2}:\d\d\s*$")
_HAN_LINE = re.compile(r"(?<=[一-鿿，、])[ \t]*\r?\n[ \t]*(?=[一-鿿，。！？、])")
_WRAP = re.compile(r"(?<=[^\W\d_],|[^\W\d_]{2}|\w:)[ \t]*\r?\n[ \t]*(?=[^\W\d_A-Z])")
_END = re.compile(r"[。！？!?]+|\.(?=\s|$)|[\r\n]+")
_HAN = re.compile("[一-鿿]{2,}")
_WORD = re.compile(r"[^\W\d_一-鿿]{2,}")


def sentences(text: str) -> list[str]:
    """The sentences of a text; line breaks within sentences, speakers and times are left out."""
    plain = text.isascii()
    t = text if plain else _INVISIBLE.sub("", text)
    # each pattern is tried only where what it needs is there
    if "\n" in t:
        t = _SPLIT.sub("", t)
    if _CLOCK.search(t):
        t = _SPEAKER.sub("\n", t)
    if "\n" in t:
        t = _WRAP.sub(" ", t if plain else _HAN_LINE.sub("", t))
    return [s for x in _END.split(t) if len(s := x.strip()) > 3]


def terms(sentence: str) -> list[str]:
    """Words in lower case, and pairs of Han characters."""
    if sentence.isascii():
        return _WORD.findall(sentence.lower())
    return [x[i : i + 2] for x in _HAN.findall(sentence) for i in range(len(x) - 1)] + [w.lower() for w in _WORD.findall(sentence)]


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (a column for each topic) by row number."""
    return np.stack([np.bincount(rows, v, n) for v in values.T], axis=1)


def fold(weights: np.ndarray, specific: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, rounds: int = FOLD_ROUNDS) -> np.ndarray:
    """``n x topics`` activations of rows given as (row, term) pairs in order of the rows, for columns of ``weights`` that sum to one."""
    h = np.ones((n, weights.shape[1]))
    if not len(rows):
        return h * 0
    w, v = weights.astype(np.float32)[cols], specific.astype(np.float32)[cols][:, None]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    present, length = rows[starts], np.diff(np.append(starts, len(rows)))
    some = h[present].astype(np.float32)
    for _ in range(rounds):
        part = w * np.repeat(some, length, axis=0)
        part *= v / np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        some = np.add.reduceat(part, starts, axis=0)
    h[:] = 0
    h[present] = some
    return h


def _specific(docs: np.ndarray, cols: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """From nearly 0 to 1 for each term: how far its documents' labels are from those of all documents."""
    pairs = np.unique(docs.astype(np.int64) * size + cols)
    counts = _sums(pairs % size, label[pairs // size], size)
    prior = (label.sum(axis=0) + 1) / (label.sum() + label.shape[1])
    p = (counts + 2 * prior) / (counts.sum(axis=1, keepdims=True) + 2)
    return np.clip((p * np.log(p / prior)).sum(axis=1) / np.log(1 / prior).mean(), LEAST_WEIGHT, 1.0)


def train(labelled: list[tuple[str, set[str]]], titles: dict[str, list[str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray, list[str]]:
    """Vocabulary, ``terms x columns`` weights, the terms' specificity, and names of the subjects' columns (the others
    are small talk)."""
    names = sorted(titles)
    place = {s: k for k, s in enumerate(names)}
    rows, words, allowed, doc = [], [], [], []
    for at, (text, subjects) in enumerate(labelled):
        for s in sentences(text):
            found = sorted(set(terms(s)))
            rows += [len(allowed)] * len(found)
            words += found
            doc.append(at)
            allowed.append([x in subjects for x in names] + [True] * SMALL_TALK)
    all_words, number = np.unique(np.array(words or [""]), return_inverse=True)
    often = np.bincount(number) >= LEAST_SENTENCES
    titled = {t for ts in titles.values() for x in ts for t in terms(x)}
    often |= np.isin(all_words, sorted(titled))
    new = np.cumsum(often) - 1
    keep = often[number]
    vocabulary = {str(w): int(new[i]) for i, w in enumerate(all_words) if often[i]}
    r, c, may = np.array(rows, np.int64)[keep], new[number[keep]], np.array(allowed, bool).reshape(-1, len(names) + SMALL_TALK)
    size = len(vocabulary)
    label = np.array([[x in ss for x in names] + [not ss & place.keys()] for _, ss in labelled], float).reshape(-1, len(names) + 1)
    v = _specific(np.array(doc, np.int64)[r], c, label / label.sum(axis=1, keepdims=True), size)
    # seeds: counts in the sentences that may use a column, less what is as common elsewhere
    w = _sums(c, may[r].astype(float), size)
    plain = np.bincount(c[~may[r][:, : len(names)].any(axis=1)], minlength=size) + 0.01
    total = np.bincount(c, minlength=size) + 1.0
    w[:, : len(names)] *= (w[:, : len(names)] / total[:, None]) ** 2
    rng = np.random.default_rng(7)
    w[:, len(names) :] = plain[:, None] * rng.uniform(0.8, 1.2, (size, SMALL_TALK)) + 0.05 * total[:, None]
    for s, texts in titles.items():
        for t in {t for x in texts for t in terms(x)} & vocabulary.keys():
            w[vocabulary[t], place[s]] += 1.0
    w = (w + 1e-6) / (w + 1e-6).sum(axis=0)
    h = may.astype(float)
    for _ in range(TRAIN_ROUNDS):
        part = w[c] * h[r]
        part *= v[c][:, None] / np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        h = _sums(r, part, len(may)) * may
        w = _sums(c, part, size) + 1e-3
        w /= w.sum(axis=0)
    return vocabulary, w, v, names


def shares(texts: list[str | None], vocabulary: dict[str, int], weights: np.ndarray, specific: np.ndarray, subjects: int) -> np.ndarray:
    """``texts x subjects``: the part of each text's sentences that are about each subject."""
    owner, rows, cols, number = [], [], [], vocabulary.get
    for i, text in enumerate(texts):
        for s in sentences(text) if text else ():
            found = set(map(number, terms(s)))
            found.discard(None)
            rows += [len(owner)] * len(found)
            cols += found
            owner.append(i)
    owner = np.array(owner, np.int64)
    count = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), subjects))
    if not rows:
        return out
    h = fold(weights, specific, np.array(rows, np.int64), np.array(cols, np.int64), len(owner))
    talk = h[:, subjects:].sum(axis=1, keepdims=True)
    best = np.where(h.sum(axis=1) > 0, np.concatenate([h[:, :subjects], talk], axis=1).argmax(axis=1), subjects)
    about = best < subjects
    np.add.at(out, (owner[about], best[about]), 1.0)
    return out / np.maximum(count, 1)[:, None]


def model(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray, list[str]]:
    """The factorisation, trained on the driver on about ``MODEL_DOCS`` labelled documents."""
    clean = F.lower(F.trim("subject"))
    titles = {r.s: [x for x in (r.title_en, r.title_zh) if x] for r in subjects.select(clean.alias("s"), "title_en", "title_zh").collect()}
    some = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set(clean).alias("ss"))
    rows = docs.join(F.broadcast(bounded_sample(some, "doc_id", MODEL_DOCS)), "doc_id").select("doc_id", F.col("text").alias("t"), "ss").filter("t <> ''").collect()
    return train([(r.t, set(r.ss)) for r in sorted(rows, key=lambda r: r.doc_id)], titles)


def subjects_column(text, fitted, least: float = LEAST_SHARE):
    """``array<string>`` of the subjects of a text; empty for null and empty texts."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        vocabulary, weights, specific, names = fitted.value
        values, out = texts.to_pylist(), []
        for at in range(0, len(values), 200):
            for row in shares(values[at : at + 200], vocabulary, weights, specific, len(names)):
                out.append([names[k] for k in np.flatnonzero(row >= least)])
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(StringType()))(text)


def about(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, subject`` of every document, none, one or several rows each; a scan and a projection, no shuffle."""
    fitted = docs.sparkSession.sparkContext.broadcast(model(docs, labels, subjects))
    return docs.select("doc_id", F.explode(subjects_column(F.col("text"), fitted)).alias("subject"))
