"""Matches of a pattern with their places, in DataFrame functions only.

A pattern splits a text into the pieces between its matches, so the lengths of
pieces and matches, added up, are the places of the matches. Places are code
points, the end exclusive.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.llm.common import let

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
HIT = "array<struct<start:int,end:int,hit:string,before:string>>"
BLOCK = 128  # matches whose places are added up at a time


def last_word(text: Column) -> Column:
    """What stands after the last white space but the trailing one."""
    return F.substring_index(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " ", -1)


def hits(text: Column, pattern: str, before: bool = False) -> Column:
    """Array of (start, end, hit, before) of all matches; empty where there is none.

    ``before`` is the last word between the match and the one before it, where asked for. Places are added up in blocks, so the
    time for a text with very many matches stays in proportion to them.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    word = last_word if before else lambda g: F.lit(None).cast("string")
    both = F.zip_with(gaps, found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"), word(g).alias("before")))

    def width(x: Column) -> Column:
        return x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))

    def placed(block: Column, begin: Column) -> Column:
        """The hits of a block that begins at a place."""
        def step(acc: Column, x: Column) -> Column:
            one = F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + width(x)).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"))
            return F.struct((acc["at"] + width(x)).alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(HIT).alias("out")), step, lambda acc: acc["out"])

    def starts(blocks: Column) -> Column:
        """Where each block begins."""
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda at, x: at + width(x)))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(widths, nothing, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def cut(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))

    counted = let(let(both, cut), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), placed)))
    return F.when(text.rlike(pattern), counted).otherwise(F.array().cast(HIT))


def spans(found: Column, kind: str, rank: int) -> Column:
    """Hits as spans of one kind; ``rank`` is the kind's place among those that start together."""
    return F.transform(found, lambda h: F.struct(
        h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(found: Column, kinds: list[str]) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(kinds))


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
