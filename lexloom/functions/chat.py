"""Chat records: formatting, parsing and checks, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import lexicon as L
from .text import casefold, col, one_line, strip


def format_lines(instruction: str | Column, response: str | Column) -> Column:
    """Markers and parts on lines of their own."""
    return F.concat_ws("\n", F.lit(L.USER), col(instruction), F.lit(L.ASSISTANT), col(response), F.lit(L.END))


def format_line(instruction: str | Column, response: str | Column) -> Column:
    """All on one line."""
    return F.concat_ws(" ", F.lit(L.USER), one_line(instruction), F.lit(L.ASSISTANT), one_line(response), F.lit(L.END))


_SHAPE = rf"(?s){L.USER}(?U:\s*)(.*?)(?U:\s*){L.ASSISTANT}(?U:\s*)(.*?)(?U:\s*)(?:{L.END})?(?U:\s*)$"


def parse(text: str | Column) -> Column:
    """struct(instruction, response), each on one line; the end marker is optional; null when a part is missing."""
    c = col(text)
    a, b = (one_line(F.regexp_extract(c, _SHAPE, k)) for k in (1, 2))
    return F.when((a != "") & (b != ""), F.struct(a.alias("instruction"), b.alias("response")))


def parse_by_place(text: str | Column) -> Column:
    """struct(instruction, response) by the markers' first places; a missing marker leaves its part empty."""
    c = col(text)
    u, a, e = (F.locate(x, c) for x in (L.USER, L.ASSISTANT, L.END))
    stop = F.when(e > a, e).otherwise(F.length(c) + 1)
    instruction = F.when((u > 0) & (a > u), strip(F.substring(c, u + len(L.USER), a - u - len(L.USER)))).otherwise("")
    response = F.when(a > 0, strip(F.substring(c, a + len(L.ASSISTANT), stop - a - len(L.ASSISTANT)))).otherwise("")
    return F.struct(instruction.alias("instruction"), response.alias("response"))


def parse_strict(text: str | Column) -> Column:
    """struct(instruction, response); raises unless all markers stand in order with something between them."""
    c = col(text)
    u, a = F.locate(L.USER, c), F.locate(L.ASSISTANT, c)
    e = F.length(c) - F.locate(L.END[::-1], F.reverse(c)) - len(L.END) + 2
    known = (u > 0) & (a > u) & F.contains(c, F.lit(L.END)) & (e > a)
    i = strip(F.substring(c, u + len(L.USER), a - u - len(L.USER)))
    r = strip(F.substring(c, a + len(L.ASSISTANT), e - a - len(L.ASSISTANT)))
    return F.when(known & (i != "") & (r != ""), F.struct(i.alias("instruction"), r.alias("response"))).otherwise(F.raise_error(F.lit("chat text lacks a marker, their order, or a part")).cast("struct<instruction:string,response:string>"))


def scaffolded(text: str | Column) -> Column:
    """Whether any mark of a scaffolded prompt stands in the text, in either case."""
    low = casefold(text)
    return reduce(lambda a, b: a | b, (low.contains(m.casefold()) for m in L.SCAFFOLDING))


def preview(text: str | Column, size: int = 260) -> Column:
    """On one line, cut to a size with dots."""
    c = one_line(text)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size - 3), F.lit("...")))


def load(rows, text: str = "text", instruction: str = "instruction", response: str = "response"):
    """DataFrame with instruction, response and text: rows with both parts get the missing text, rows with tagged text alone the parts.

    Rows that have neither are left out; columns that are missing count as null.
    """
    have = set(rows.columns)
    get = lambda c: F.nullif(strip(c), F.lit("")) if c in have else F.lit(None).cast("string")
    told = rows.withColumn("_p", parse(text) if text in have else F.lit(None).cast("struct<instruction:string,response:string>"))
    both = get(instruction).isNotNull() & get(response).isNotNull()
    i = F.when(both, get(instruction)).otherwise(F.col("_p.instruction"))
    r = F.when(both, get(response)).otherwise(F.col("_p.response"))
    out = told.withColumn("_i", i).withColumn("_r", r).withColumn("_t", F.coalesce(get(text), format_lines("_i", "_r"))).drop(*(have & {text, instruction, response}), "_p")
    return out.where("_i IS NOT NULL AND _r IS NOT NULL").withColumnsRenamed({"_i": "instruction", "_r": "response", "_t": "text"})
