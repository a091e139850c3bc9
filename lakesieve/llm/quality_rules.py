"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit a rule; a policy is
a named, versioned set of rules, that is a mask, so applying another policy or finding what a rule alone removes are
bit operations over the ledger, without a second look at the texts.

Null, empty and blank texts have no words: all measurements are 0 and the rules that ask for words fail. A null id, a
repeated row or an extra column stays as it is; each row is judged by its own text, whole, however long; a name that the
kept columns have already gets a leading underscore. An empty table gives an empty ledger.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.llm._bytes import U64, WHITE, Texts, mix, span_digests, windows, word_hashes
from lakesieve.llm._rows import with_measures
from lakesieve.llm._spark import free_name

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
REPEAT_WORDS = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Bit i of the ledger is set where rule i fails. Ratios are in whole numbers, so that every engine agrees.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
)
#: Policies by version; a version never changes once it is used.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "short_words", "long_words", "many_symbols", "repeated_lines"),
}


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The MEASURES of each document."""
    n = len(texts)
    starts, ends, first = texts.words()
    docs = np.repeat(np.arange(n), np.diff(first))
    ink = ~WHITE[texts.data]
    point = ((texts.data & 0xC0) != 0x80) & ink
    out = {"n_words": np.diff(first).astype(np.int64), "word_chars": texts.sums(point), "n_symbols": texts.sums(SYMBOLS[texts.data])}

    hashes, at = windows(word_hashes(texts, starts, ends), first, REPEAT_WORDS)
    keys = hashes ^ mix(docs[at].astype(U64) + U64(1)) if len(at) else hashes
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    step = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = at[twice[place] == keys]
        step[hit] += 1
        np.subtract.at(step, hit + REPEAT_WORDS, 1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]

    # lines end at \n or with the document; those without a word don't count
    stops = np.union1d(np.flatnonzero(texts.data == 10) + 1, texts.offs)
    begin, end = stops[:-1], stops[1:]
    owner = np.searchsorted(texts.offs, begin, "right") - 1
    inked = np.concatenate(([0], np.cumsum(ink)))
    full = inked[end] > inked[begin]
    begin, end, owner = begin[full], end[full], owner[full]
    end = end - (texts.data[end - 1] == 10)
    lines = span_digests(texts.data, begin, end) ^ mix(owner.astype(U64) + U64(1))
    _, index = np.unique(lines, return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n).astype(np.int64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[index], minlength=n)
    return {k: out[k] for k in MEASURES}


def failures(names: dict[str, str], rules=RULES) -> Column:
    """The failure bits, from columns named as in `names`."""
    bits = F.lit(0).cast("bigint")
    for i, (_, rule) in enumerate(rules):
        rule = re.sub(rf"\b({'|'.join(MEASURES)})\b", lambda m: f"`{names[m[1]]}`", rule)
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def mask(policy: str, rules=RULES) -> int:
    order = [r for r, _ in rules]
    return sum(1 << order.index(r) for r in POLICIES[policy])


def ledger(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep`, the measurements and `failed_bits`. A name that `keep` has already gets a leading underscore."""
    keep = df.columns if keep is None else keep
    names = {m: free_name(keep, m) for m in MEASURES}
    found = with_measures(df, text, {v: "bigint" for v in names.values()}, lambda t: {names[k]: v for k, v in measure(t).items()}, keep)
    return found.withColumn(free_name(keep, "failed_bits"), failures(names))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str, bits: str = "failed_bits") -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and those that only this rule rejects."""
    whole = mask(policy)
    order = [r for r, _ in RULES]
    sums = [F.count("*").alias("n_docs")]
    for r in POLICIES[policy]:
        bit = 1 << order.index(r)
        hit = F.col(bits).bitwiseAND(F.lit(bit)) != 0
        sums += [F.count_if(hit).alias(f"f_{r}"), F.count_if(F.col(bits).bitwiseAND(F.lit(whole)) == bit).alias(f"o_{r}")]
    one = entries.agg(*sums)
    rows = ", ".join(f"'{r}', f_{r}, o_{r}" for r in POLICIES[policy])
    return one.selectExpr("n_docs", f"stack({len(POLICIES[policy])}, {rows}) as (rule, n_failed, n_only)")


def filter_documents(df: DataFrame, policy: str = "web-1", text: str = "text") -> DataFrame:
    """The rows of `df` that the policy keeps, with its columns."""
    bits = free_name(df.columns, "failed_bits")
    return ledger(df, text).where(passes(policy, bits)).select(*[F.col(f"`{c}`") for c in df.columns])
