"""Output of a text recogniser, given as JSON in any of its forms, as lines and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which a recogniser gives texts, scores and boxes, in the order in which they are looked for.
TEXTS = ("rec_texts", "texts", "text", "detected_text")
SCORES = ("rec_scores", "scores", "confidence", "confidences")
BOXES = ("rec_boxes", "rec_polys", "dt_polys", "boxes", "bounding_boxes")
#: Confidence of a text without one, and the least that a region needs.
UNKNOWN, LEAST = 0.5, 0.7
LINE = "struct<text:string,confidence:double,points:array<array<double>>>"


def _array(raw: Column) -> Column:
    """The items of a JSON list, each as JSON (texts without quotes)."""
    return F.from_json(raw, "array<string>")


def _many(raw: Column) -> Column:
    """A JSON list's items, or a single text or number as a list of one."""
    return F.when(raw.startswith("["), _array(raw)).when(raw.isNotNull() & ~raw.startswith("{"), F.array(raw))


def _line(text: Column, score: Column, points: Column) -> Column:
    return F.struct(text.alias("text"), score.alias("confidence"), F.from_json(points, "array<array<double>>").alias("points"))


def _of_object(obj: Column) -> Column:
    """The lines of a JSON object: of its recognised texts that have a score, or of the first names it has."""
    fields = F.from_json(obj, "map<string,string>")
    first = lambda names: F.coalesce(*[_many(fields[n]) for n in names])
    listed = lambda names: F.coalesce(*[F.when(fields[n].startswith("["), _array(fields[n])) for n in names])
    none = F.array().cast("array<string>")
    texts, scores = _array(fields["rec_texts"]), _array(fields["rec_scores"])
    polygons, squares = F.coalesce(_array(fields["rec_polys"]), none), F.coalesce(_array(fields["rec_boxes"]), none)
    shapes = F.when(F.size(polygons) > 0, polygons).otherwise(squares)
    places = F.sequence(F.lit(0), F.least(F.size(texts), F.size(scores)) - 1)
    both = F.when(F.least(F.size(texts), F.size(scores)) > 0, F.transform(places, lambda i: _line(F.get(texts, i), F.get(scores, i).try_cast("double"), F.get(shapes, i))))
    known = F.filter(both, lambda x: (x["text"] != "") & x["confidence"].isNotNull())
    any_texts, any_scores, any_shapes = first(TEXTS), first(SCORES), F.coalesce(listed(BOXES), none)
    equal = F.coalesce(F.size(any_texts) == F.size(any_scores), F.lit(False))
    rest = F.transform(any_texts, lambda t, i: _line(t, F.when(equal, F.get(any_scores, i).try_cast("double")).otherwise(F.lit(UNKNOWN)), F.get(any_shapes, i)))
    return F.when(fields["rec_texts"].isNotNull() & fields["rec_scores"].isNotNull(), known).otherwise(rest)


def _of_row(row: Column) -> Column:
    """A line given as a list: box and (text, score), box and text and score, or text and score."""
    parts = _array(row)
    a, b, c = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    inner = _array(b)
    paired = _line(F.get(inner, F.lit(0)), F.get(inner, F.lit(1)).try_cast("double"), a)
    plain = _line(a, b.try_cast("double"), F.lit(None).cast("string"))
    flat = _line(b, c.try_cast("double"), a)
    return F.when(a.startswith("[") & b.startswith("["), paired).when(a.startswith("["), F.when(c.try_cast("double").isNotNull(), flat)).when(b.try_cast("double").isNotNull(), plain)


def lines_of(result: Column) -> Column:
    """``array<struct<text, confidence, points>>`` of a recogniser's JSON: an object, a list of objects, a list that holds
    the list of lines, or a text alone. Empty for null, empty, numbers and what can't be read."""
    r = F.regexp_replace(result, r"\A\s+|\s+\z", "")
    items = _array(r)
    first = F.get(items, F.lit(0))
    objects = F.flatten(F.transform(F.filter(items, lambda x: x.startswith("{")), _of_object))
    rows = F.filter(F.transform(_array(first), _of_row), lambda x: x.isNotNull())
    alone = F.array(_line(F.from_json(F.concat(F.lit("["), r, F.lit("]")), "array<string>")[0], F.lit(UNKNOWN), F.lit(None).cast("string")))
    lines = F.when(r.startswith("{"), _of_object(r)).when(r.startswith("["), F.when(first.startswith("{"), objects).when(first.startswith("["), rows)).when(r.startswith('"'), F.when(r != '""', alone))
    return F.coalesce(lines, F.array().cast(f"array<{LINE}>"))


def regions_of(lines: Column, least: float = LEAST, scale: float = 1.0) -> Column:
    """Regions ``text, x, y, width, height, confidence`` of lines: those with a text and at least the confidence (null is
    0), each with the box around its points, zero without any. Scaled points are cut to whole numbers first."""
    sure = F.filter(lines, lambda x: x["text"].isNotNull() & (F.coalesce(x["confidence"], F.lit(0.0)) >= least))

    def region(x: Column) -> Column:
        points = F.filter(x["points"], lambda p: F.size(p) >= 2)
        side = lambda k: F.transform(points, lambda p: (p[k] * scale).cast("int").cast("double") if scale != 1.0 else p[k])
        low = lambda k: F.coalesce(F.array_min(side(k)), F.lit(0.0))
        size = lambda k: F.coalesce(F.array_max(side(k)) - F.array_min(side(k)), F.lit(0.0)).cast("int")
        return F.struct(x["text"].alias("text"), low(0).cast("int").alias("x"), low(1).cast("int").alias("y"), size(0).alias("width"), size(1).alias("height"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"))

    return F.transform(sure, region)


def read_results(results: DataFrame, keys: list[str], result: str, least: float = LEAST, scale: float = 1.0) -> DataFrame:
    """``*keys, region_seq`` and the region of every line of a recogniser's JSON that is sure enough."""
    rows = results.select(*keys, F.posexplode(regions_of(lines_of(F.col(result)), least, scale)).alias("region_seq", "_r"))
    return rows.select(*keys, "region_seq", "_r.*")
