"""Keys by which rows are the same. The two families differ and must not be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_text, strip, text
from .times import iso, norm_stamp


def stable_key(id_: Column, sender: Column, timestamp: Column, content: Column) -> Column:
    """The storage's key: the id as it is, else sender, ISO time and stripped content. Nulls count as empty."""
    rest = F.concat_ws("|", text(sender), text(iso(timestamp)), strip(text(content)))
    return F.when(text(id_) != "", id_).otherwise(rest)


def second(timestamp: Column, as_text: bool = False) -> Column:
    """ISO time to the second of a time, or of a time given as text; null as empty."""
    return norm_stamp(timestamp) if as_text else text(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"))


def merge_key(id_: Column, sender: Column, stamp: Column, content: Column, null_id: str = "") -> Column:
    """The merge's key: ``id:`` and the stripped id, else normalised sender, ``second`` of the time, and content.

    The reference reads a null id as the text ``None``, by which all rows without an id would be one; ``null_id="None"``
    does so too.
    """
    known = strip(F.coalesce(id_, F.lit(null_id)))
    rest = F.concat_ws("|", F.lower(norm_text(sender)), stamp, norm_text(content))
    return F.when(known != "", F.concat(F.lit("id:"), known)).otherwise(rest)


def content_key(sender: Column, content: Column) -> Column:
    """The merge's second key: normalised sender in lower case, and content."""
    return F.concat_ws("|", F.lower(norm_text(sender)), norm_text(content))


def loose_key(sender: Column, content: Column) -> Column:
    """The storage's second key: sender and content, stripped and in lower case, white space inside kept."""
    return F.concat_ws("|", F.lower(strip(text(sender))), F.lower(strip(text(content))))
