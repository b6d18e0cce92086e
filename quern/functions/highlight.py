"""Highlighting: match positions, excerpts and marked text. Offsets count code points.

Everything stays in the JVM, in time linear in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "array<struct<start:int,end:int,token:string>>"


def terms_of(query: str) -> list[str]:
    return [t for t in re.split(r"\s+", query) if t]


_EDGE = "[\\p{L}0-9_]"


def _matches(text: Column, hay: Column, needle: str, whole_words: bool) -> Column:
    """Splitting before every place where the needle begins, overlapping ones included, leaves pieces whose lengths add up to the places."""
    n, quoted = len(needle), "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    place = f"(?<!{_EDGE})(?={quoted}(?!{_EDGE}))" if whole_words else f"(?={quoted})"
    pieces = F.split(hay, place)
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    later = F.aggregate(before, none, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")), lambda a: a["out"])
    starts = F.concat(F.when(F.rlike(hay, F.lit("\\A" + place)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), later)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.substring(text, i + 1, F.lit(n)).alias("token")))


def positions(text: Column, query: str, case_sensitive: bool = False, whole_words: bool = False) -> Column:
    """Matches of the query's terms, sorted by start; overlapping ones included. Null for a null text."""
    hay = text if case_sensitive else F.lower(text)
    found = [_matches(text, hay, term if case_sensitive else term.lower(), whole_words) for term in terms_of(query)]
    if not found:
        return F.when(text.isNotNull(), F.array().cast(SCHEMA))
    return F.when(text.isNotNull(), F.array_sort(F.concat(*found)))


def excerpt(text: Column, marks: Column, length: int) -> Column:
    """About ``length`` characters around the first match, with dots where text is cut."""
    n = F.length(text)
    first = F.get(marks, F.lit(0))
    centre = F.floor((first["start"] + first["end"]) / 2)
    start = F.greatest(centre - length // 2, F.lit(0))
    end = F.least(start + length, n)
    start = F.greatest(F.least(start, end - length), F.lit(0))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, (start + 1).cast("int"), F.lit(length)), F.when(end < n, "...").otherwise(""))
    return F.when((F.size(marks) == 0) | (n <= length), text).otherwise(cut)


def marked(text: Column, marks: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """The text with its matches marked; matches that overlap or touch become one."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def close(a: Column) -> Column:
        plain = F.substring(text, a["at"] + 1, a["start"] - a["at"])
        return F.concat(a["out"], plain, F.lit(opening), F.substring(text, a["start"] + 1, a["end"] - a["start"]), F.lit(closing))

    def step(a: Column, m: Column) -> Column:
        joined = (a["start"] >= 0) & (m["start"] <= a["end"])
        out = F.when(joined | (a["start"] < 0), a["out"]).otherwise(close(a))
        at = F.when(joined | (a["start"] < 0), a["at"]).otherwise(a["end"])
        return F.struct(out.alias("out"), at.alias("at"), F.when(joined, a["start"]).otherwise(m["start"]).alias("start"), F.when(joined, F.greatest(a["end"], m["end"])).otherwise(m["end"]).alias("end"))

    done = F.aggregate(marks, zero, step, lambda a: F.when(a["start"] < 0, text).otherwise(F.concat(close(a), F.substring(text, a["end"] + 1, F.length(text)))))
    return F.when(text.isNotNull(), done)
