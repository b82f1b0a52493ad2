"""Queries over whole tables, each with SQL that gives the same rows where SQL can."""

from . import keep, shape, words

QUERIES = {**words.QUERIES, **keep.QUERIES, **shape.QUERIES}
SQL = {**words.SQL, **keep.SQL, **shape.SQL}
