"""Personal data and secrets in the texts of samples, as spans (field, start, end, kind)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesieve.functions.text import DIGITS, count_of

FIELDS = ("prompt", "context", "response")
FAIL_HITS, HIGH_RISK = 3, ("credit_card", "aadhaar", "secret")
SPANS = "array<struct<field:string,start:int,`end`:int,kind:string>>"
# What each kind looks like, in the order in which kinds win over one another.
PATTERNS = {
    "secret": [
        r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}",
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
        r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
        r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
        r"\bAIza[0-9A-Za-z_-]{35}\b",
        r"\bhf_[A-Za-z0-9]{30,}\b",
        r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    ],
    "credit_card": [r"(?<![\d\w])\d(?:[ -]?\d){12,18}(?![\d\w])"],
    "aadhaar": [r"(?<![\d\w])(?<!\d[ -])[2-9]\d{3}([ -])\d{4}\1\d{4}(?![\d\w])(?![ -]\d)"],
    "email": [r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"],
    "phone": [
        r"(?<![\w+])(?:\+91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?![\w])",
        r"(?<![\w+])\+(?!91)[1-9]\d{0,2}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4}(?![\w])",
        r"(?<![\w(])(?:\(\d{3}\)\s?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w])",
    ],
    "ip_address": [r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w.]\d|\w)"],
}
VERSION = re.compile(r"(?:version|release|ver\.?|v|build|firmware|rev\.?)\s*$")
VERSION_REACH = 12
LEAST_DIGITS, WITHOUT_DIGITS = 4, ("secret", "email")
#: What a secret begins with or holds.
HINTS = r"sk-|AKIA|ASIA|gh[pousr]_|xox|AIza|hf_|PRIVATE KEY"
DOUBLED = "0246813579"  # digit sums of the doubles of 0 to 9

_COMPILED = {kind: [re.compile(p) for p in some] for kind, some in PATTERNS.items()}


def luhn(digits: str) -> bool:
    plain, doubled = digits[::-2], digits[-2::-2]
    return (sum(map(int, plain)) + sum(int(DOUBLED[int(d)]) for d in doubled)) % 10 == 0


def plausible(kind: str, m: re.Match) -> bool:
    """What a pattern alone can't tell of a match."""
    digits = "".join(c for c in m[0] if c.isdecimal())
    if kind == "credit_card":
        return len(set(digits)) > 1 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and len(set(digits)) > 2
    if kind == "ip_address":
        ahead = m.string[max(m.start() - VERSION_REACH, 0) : m.start()].lower()
        return not m[0].startswith("0.") and not VERSION.search(ahead)
    return True


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start. One pass over all matches, by kind and then the longer first: each claims its characters
    unless some are taken. Texts with next to no digits have only secrets and addresses, which may overlap there."""
    text = text or ""
    numeric = sum(map(text.count, DIGITS)) >= LEAST_DIGITS
    ranked = [(rank, m.start() - m.end(), m.start(), m.end(), kind) for rank, (kind, some) in enumerate(_COMPILED.items()) if numeric or kind in WITHOUT_DIGITS for p in some for m in p.finditer(text) if plausible(kind, m)]
    taken: list[tuple[int, int, str]] = []
    for _, _, start, end, kind in sorted(ranked):
        if not numeric or all(end <= a or b <= start for a, b, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken, key=lambda t: t[0])


def _spans(prompt: pd.Series, context: pd.Series, response: pd.Series) -> pd.Series:
    rows = zip(prompt, context, response, strict=True)
    return pd.Series([[{"field": f, "start": s, "end": e, "kind": k} for f, x in zip(FIELDS, row, strict=True) for s, e, k in spans_of(x)] for row in rows], dtype=object)


def pii_spans() -> Column:
    """Texts without an @, four digits or the beginning of a secret can hold none and are not handed to Python."""
    def worth(c):
        x = F.col(c)
        digits = count_of(x, "0-9")
        return F.when((digits >= LEAST_DIGITS) | F.contains(x, F.lit("@")) | x.rlike(HINTS), x)

    return F.pandas_udf(_spans, SPANS)(*(worth(c) for c in FIELDS))


def pii_severity(spans: Column) -> Column:
    """fail: a risky kind or several hits; warn: any hit."""
    risky = F.exists(spans, lambda s: s["kind"].isin(*HIGH_RISK))
    return F.when((F.size(spans) >= FAIL_HITS) | risky, "fail").when(F.size(spans) > 0, "warn").otherwise("pass")
