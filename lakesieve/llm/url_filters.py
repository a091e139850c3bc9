"""URL filters from built-in functions only: host/path rules by the longest match, then pattern rules by their rarest token.

A pattern rule names literal tokens (runs of a-z and 0-9) that every URL it fits must contain. Token frequencies are
counted over all URLs of the table; each rule is indexed by its rarest token, a URL's tokens fetch the candidate rules, and
only those run their regular expression. Rule lists up to MAX_INLINE entries are looked up in a literal map, without any
shuffle of the table; longer lists are joined, patterns on the token and host rules on the hosts' endings, for distinct URLs and hosts.

Texts of any length are URLs. Null URLs and URLs without `://` have an empty host and path, no tokens and the verdict allow. Repeated rows are judged
alike, each by its own URL; ids are carried along as they are, null or not; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm._spark import free_name, lower_ascii

MAX_INLINE = 20_000


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks the URLs in which `pattern` is found; `tokens` stand in each of them as whole tokens, in lower case."""

    pattern: str
    tokens: tuple[str, ...]


#: The list that the contract names.
HOST_RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))
#: Patterns are written so that Java's and RE2's expressions mean the same.
PATTERN_RULES = (
    PatternRule(r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    PatternRule(r"[?&]page=[0-9]+&ref=", ("page", "ref")),
    PatternRule(r"//ads\.", ("ads",)),
    PatternRule(r"//banner\.", ("banner",)),
    PatternRule(r"/(wp-)?login(\.[a-z]+)?([?#]|$)", ("login",)),
    PatternRule(r"/cart/(add|remove)[/?]", ("cart",)),
    PatternRule(r"[?&]sessionid=[0-9a-f]{8}", ("sessionid",)),
    PatternRule(r"\.exe([?#]|$)", ("exe",)),
    PatternRule(r"\.zip([?#]|$)", ("zip",)),
)


def read_rules(spark: SparkSession, path: str) -> tuple[list[HostRule], list[PatternRule]]:
    """Rules from a text file: `allow|block <host>/<path>`, or `pattern <expression> <tokens by commas>`, parted by tabs; # begins a remark."""
    hosts, patterns = [], []
    for r in spark.read.text(path).toLocalIterator():
        kind, *rest = r.value.strip().split("\t")
        if kind in ("allow", "block") and len(rest) == 1 and "/" in rest[0]:
            host, _, tail = rest[0].partition("/")
            hosts.append(HostRule(host, f"/{tail}", kind))
        elif kind == "pattern" and rest:
            patterns.append(PatternRule(rest[0], tuple(t for t in ",".join(rest[1:]).split(",") if t)))
        elif kind and not kind.startswith("#"):
            raise ValueError(f"not a rule: {r.value!r}")
    return hosts, patterns


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def _literal_map(entries: dict[str, list[Column]]) -> Column:
    flat = [x for k, v in entries.items() for x in (F.lit(k), F.array(*v))]
    return F.create_map(*flat)


def token_counts(df: DataFrame, url: str, rules) -> dict[str, int]:
    """How many URLs hold each token of the rules (no more entries than the rules have tokens)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = df.sparkSession
    found = df.select(F.explode(_tokens(F.col(f"`{url}`"))).alias("t"))
    found = found.where(F.col("t").isin(wanted)) if len(wanted) <= 1000 else found.join(spark.createDataFrame([(t,) for t in wanted], "t string"), "t", "left_semi")
    return {r.t: r["count"] for r in found.groupBy("t").count().toLocalIterator()}


def rarest_tokens(rules, counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Rules by their rarest token; None has those without a token, which every URL tries."""
    index: dict[str | None, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None), []).append(i)
    return index


def _pattern_hit(df: DataFrame, url: str, rules) -> tuple[DataFrame, Column]:
    """`df` and a column that is true where a pattern rule fits."""
    index, at = rarest_tokens(rules, token_counts(df, url, rules)), F.col(f"`{url}`")
    always = [at.rlike(rules[i].pattern) for i in index.pop(None, [])]
    hit = F.lit(False)
    for a in always:
        hit = hit | F.coalesce(a, F.lit(False))
    if not index:
        return df, hit
    if len(rules) <= MAX_INLINE:
        patterns = _literal_map({t: [F.lit(rules[i].pattern) for i in of] for t, of in index.items()})
        keys = F.filter(_tokens(at), lambda t: F.map_contains_key(patterns, t)) if len(index) > 64 else F.array_intersect(_tokens(at), F.array(*map(F.lit, index)))
        return df, hit | F.coalesce(F.exists(F.flatten(F.transform(keys, lambda t: F.try_element_at(patterns, t))), lambda p: F.regexp(at, p)), F.lit(False))
    flag = free_name(df.columns, "pattern_hit")
    table = df.sparkSession.createDataFrame([(t, rules[i].pattern) for t, of in index.items() for i in of], "t string, p string")
    urls = df.select(at.alias("u")).where("u is not null").distinct().select("u", F.explode(_tokens(F.col("u"))).alias("t"))
    fits = urls.join(table, "t").where(F.regexp(F.col("u"), F.col("p"))).select(F.col("u").alias(f"{flag}_u"), F.lit(True).alias(flag)).distinct()
    return df.join(fits, at == fits[f"{flag}_u"], "left").drop(f"{flag}_u"), hit | F.coalesce(F.col(flag), F.lit(False))


def judge(df: DataFrame, url: str = "url", keep: list[str] | None = None, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """The columns `keep` with host, path, rule and verdict (a name that `keep` has already gets a leading underscore)."""
    keep = df.columns if keep is None else keep
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, url])])
    df, hit = _pattern_hit(df, url, list(pattern_rules))
    host, path = free_name(keep, "host"), free_name(keep, "path")
    h, p = host_and_path(F.col(f"`{url}`"))
    found = df.withColumn(free_name(keep, "_hit"), hit).withColumn(host, h).withColumn(path, p)
    by_host: dict[str, list[Column]] = {}
    for r in host_rules:
        by_host.setdefault(r.host, []).append(F.struct(F.lit(r.path).alias("path"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
    labels = F.split(F.col(host), "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(by_host) > MAX_INLINE:
        rules = df.sparkSession.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in host_rules], "end string, rule_path string, name string, verdict string")
        places = found.select(F.col(host).alias("at_host"), F.col(path).alias("at_path"), ends.alias("ends")).distinct().select("at_host", "at_path", F.explode("ends").alias("end"))
        fits = places.join(rules, "end").where(F.startswith("at_path", "rule_path")).groupBy("at_host", "at_path").agg(F.max(F.struct(F.length("name").alias("n"), "name", "verdict")).alias("fit"))
        own = {c: free_name([*found.columns, *keep], f"_{c}") for c in fits.columns}
        fits = fits.withColumnsRenamed(own)
        found = found.join(fits, (F.col(host) == F.col(own["at_host"])) & (F.col(path) == F.col(own["at_path"])), "left")
        best = F.col(own["fit"])
    elif by_host:
        table = _literal_map(by_host)
        known = F.filter(ends, lambda e: F.map_contains_key(table, e))
        fits = F.filter(F.flatten(F.transform(known, lambda e: F.try_element_at(table, e))), lambda r: F.startswith(F.col(path), r["path"]))
        best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    else:
        best = F.lit(None).cast("struct<n:int,name:string,verdict:string>")
    found = found.withColumn(free_name(keep, "_best"), best)
    b = F.col(free_name(keep, "_best"))
    own = F.when(F.col(free_name(keep, "_hit")), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(*[F.col(f"`{c}`") for c in keep], host, path, b["name"].alias(free_name(keep, "rule")), F.coalesce(b["verdict"], own).alias(free_name(keep, "verdict")))
