"""Texts in parts: fenced code apart from prose, and personal data apart from the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```[^\n`]*\n.*?(?:```|\z)"


def blocks(text: Column) -> Column:
    """array<struct<kind,text>> of prose (`text`) and fenced code (`code`, without its fences), in order; empty parts are left out."""
    code = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    prose = F.split(text, FENCE, -1)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\A```[^\n`]*\n", ""), r"\n?```\z", "")
    both = F.transform(prose, lambda p, i: F.array(F.struct(F.lit("text").alias("kind"), p.alias("text")), F.struct(F.lit("code").alias("kind"), bare(F.get(code, i)).alias("text"))))
    return F.filter(F.flatten(both), lambda b: F.coalesce(b["text"], F.lit("")) != "")


def own_spans(spans: Column, field: str) -> Column:
    """The spans of a field that don't overlap an earlier one, in order."""
    mine = F.array_sort(F.filter(spans, lambda s: s["field"] == field), lambda a, b: a["start"] - b["start"])
    empty = F.struct(F.lit(0).alias("at"), F.slice(mine, 1, 0).alias("kept"))
    step = lambda held, s: F.when(s["start"] >= held["at"], F.struct(s["end"].alias("at"), F.concat(held["kept"], F.array(s)).alias("kept"))).otherwise(held)
    return F.aggregate(mine, empty, step, lambda held: held["kept"])


def segments(text: Column, spans: Column, field: str) -> Column:
    """array<struct<kind,text>> of a field's text: parts that hold personal data with their kind, others with none."""
    mine = own_spans(spans, field)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,text:string>>").alias("parts"))
    part = lambda kind, a, b: F.struct(kind.cast("string").alias("kind"), F.substring(text, a + 1, b - a).alias("text"))
    step = lambda held, s: F.struct(s["end"].alias("at"), F.concat(held["parts"], F.array(part(F.lit(None), held["at"], s["start"]), part(s["kind"], s["start"], s["end"]))).alias("parts"))
    done = F.aggregate(mine, start, step, lambda held: F.concat(held["parts"], F.array(part(F.lit(None), held["at"], F.length(text)))))
    return F.filter(done, lambda p: p["text"] != "")


def redacted(text: Column, spans: Column, field: str) -> Column:
    """A field's text with the kind of personal data in its place."""
    return F.array_join(F.transform(segments(text, spans, field), lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")))), "")
