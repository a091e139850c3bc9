"""Text columns with the meaning that str and re have in Python, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python takes for white space, as a class of a regular expression and as characters.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]+"
DIGITS = "0123456789"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(x, f"{SPACE}+", " "), F.lit(" "))


def plain(x: Column, kind: T.DataType = T.StringType()) -> Column:
    """A value of any type as text: bytes as UTF-8, lists and structs as JSON with all their fields, NULL as empty."""
    if isinstance(kind, T.BinaryType):
        text = F.make_valid_utf8(x.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(x, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.BooleanType):
        text = F.initcap(x.cast("string"))
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit(""))


def clean(x: Column, kind: T.DataType = T.StringType()) -> Column:
    """A value as text, without NUL characters and outer white space."""
    return strip(F.translate(plain(x, kind), "\0", ""))


def count_of(x: Column, kind: str) -> Column:
    """How many characters are of a class of a regular expression; they are found a run at a time."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[{kind}]+", ""))


def split_words(x: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(x, rf"{SPACE}+"), lambda w: w != "")


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once, where f uses it inside of lambdas."""
    return F.transform(F.array(x), f)[0]


def preview(x: Column, most: int = 160) -> Column:
    y = collapsed(x)
    return F.when(F.length(y) > most, F.concat(F.substring(y, 1, most - 1), F.lit("…"))).otherwise(y)


def like_pattern(value: str) -> str:
    """An unescaped LIKE pattern: a backslash only stays before %, _ and itself."""
    out, i = "", 0
    while i < len(value):
        if value[i] == "\\" and not (i + 1 < len(value) and value[i + 1] in "%_\\"):
            i += 1
            continue
        step = 2 if value[i] == "\\" else 1
        out, i = out + value[i : i + step], i + step
    return out
