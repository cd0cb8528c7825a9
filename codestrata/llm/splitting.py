"""Oversized texts cut into overlapping pieces at natural boundaries.

One regular expression with bounded quantifiers does the cutting. Its
alternatives stand in the order of boundary strength (the rest fits, before an
unindented line after a blank one, after a blank line, after a line, after a
statement or bracket, after white space, before no combining mark, anywhere);
each takes as much as the limit allows, and a strong boundary is only taken if
the piece is at least half full. ``regexp_extract_all`` yields the cores, which
partition the text. A piece is its core behind the last whole lines of the one
before, up to ``overlap`` characters. All of it is built-in expressions: no
Python, no shuffle; the text is exploded only at the end.

Lengths count Unicode code points (a regular expression never cuts one).
Defined results: null gives no pieces, an empty text or one within the limit
gives itself as one piece; a piece whose predecessor ends inside a line has no
overlap; repeated rows each give their pieces. Joining the pieces without their
first ``overlap`` characters (a column) gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutter(most: int) -> str:
    half = max(1, most // 2)
    full, start = f"[\\s\\S]{{{half},{most}}}", f"[\\s\\S]{{1,{most}}}"
    return "|".join([
        rf"{start}\z",
        rf"{full}(?<=\n[ \t]{{0,40}}\r?\n)(?=[^\s}}\])])",
        rf"{full}(?<=\n[ \t]{{0,40}}\r?\n)",
        rf"{start}(?<=\n)",
        rf"{full}(?<=[;{{}}>\])])(?![\s;,)\]])",
        rf"{full}(?<=[,\s])(?=\S)",
        rf"{full}(?![\p{{M}}‍︎️])",
        start,
    ])


def cores(text: Column, limit: int, overlap: int) -> Column:
    """Array of the pieces' cores; null for null."""
    parts = F.regexp_extract_all(text, F.lit(cutter(limit - overlap)), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(parts)


def pieces(df: DataFrame, key: str = "id", text: str = "new_code", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, piece_no from 1, n_pieces, start_at from 1, overlap, piece)."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    parts = df.select(key, cores(F.col(text), limit, overlap).alias("__c"))
    tail = lambda c: F.substring(c, -(overlap + 1), overlap + 1)
    # what a piece may repeat: the end of the core before, with the one before that if it ended a line
    before = F.transform(
        "__c",
        lambda c, i: F.when(i == 0, F.lit("")).otherwise(
            tail(F.concat(F.when(i >= 2, F.when(F.get("__c", i - 2).endswith("\n"), F.concat(F.lit("\n"), tail(F.get("__c", i - 2)))).otherwise("")).otherwise("\n"), F.get("__c", i - 1)))
        ),
    )
    lead = F.transform(before, lambda b: F.regexp_extract(b, r"(?s)\n(.*\n)\z", 1)) if overlap else F.transform("__c", lambda c: F.lit(""))
    # where each core starts: one running sum over their lengths
    starts = F.aggregate("__c", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    starts = F.slice(starts, F.lit(1), F.size("__c"))
    rows = parts.select(key, F.size("__c").alias("n_pieces"), F.posexplode(F.arrays_zip(F.col("__c").alias("c"), lead.alias("o"), starts.alias("s"))).alias("__i", "__p"))
    size = F.length("__p.o")
    return rows.select(
        key,
        (F.col("__i") + 1).alias("piece_no"),
        "n_pieces",
        (F.col("__p.s") - size + 1).alias("start_at"),
        size.alias("overlap"),
        F.concat("__p.o", "__p.c").alias("piece"),
    )


def oversized(df: DataFrame, key: str = "id", text: str = "new_code", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """The keys of the texts that :func:`cores` cuts."""
    return df.where(F.size(cores(F.col(text), limit, overlap)) > 1).select(key)
