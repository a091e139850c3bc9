"""Filters over samples, listing, dashboard measures and export splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions.text import like_pattern
from lakesieve.store import positions, spread, written


BIN_DIGITS = 3


@dataclass(frozen=True)
class SampleFilter:
    dataset_id: int | None = None
    qc_status: tuple[str, ...] = ()
    category: str | None = None
    lang: str | None = None
    min_tokens: int | None = None
    max_tokens: int | None = None
    text_contains: str | None = None
    failed_check: str | None = None

    def apply(self, samples: DataFrame, results: DataFrame | None = None) -> DataFrame:
        """Conditions that are set, as one predicate; a failed check is a semi join."""
        c = F.col
        tests: list[Column] = []
        if self.dataset_id is not None:
            tests.append(c("dataset_id") == self.dataset_id)
        if self.qc_status:
            tests.append(c("qc_status").isin(*self.qc_status))
        if self.category:
            tests.append(c("category").ilike(like_pattern(self.category)))
        if self.lang:
            tests.append(c("lang") == self.lang)
        if self.min_tokens is not None:
            tests.append(c("tokens_est") >= self.min_tokens)
        if self.max_tokens is not None:
            tests.append(c("tokens_est") <= self.max_tokens)
        if self.text_contains:
            like = f"%{like_pattern(self.text_contains)}%"
            tests.append(c("prompt").ilike(like) | F.coalesce(c("context").ilike(like), F.lit(False)) | c("response").ilike(like))
        for t in tests:
            samples = samples.where(t)
        if self.failed_check:
            bad = results.where((c("check_name") == self.failed_check) & c("severity").isin("warn", "fail")).select("id")
            samples = samples.join(bad, "id", "left_semi")
        return samples


def page(samples: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return samples.orderBy("dataset_id", "id").offset(offset).limit(limit)


def neighbours(samples: DataFrame) -> DataFrame:
    """(id, prev_id, next_id): the samples before and after each in its dataset, found by their places in the order."""
    placed = positions(samples.select("id", "dataset_id", "sample_index"), ["dataset_id", "sample_index", "id"], "place")
    near = placed.select("dataset_id", F.col("id").alias("other"), F.col("place").alias("at"))
    out = placed
    for name, step in (("prev_id", -1), ("next_id", 1)):
        out = out.join(near.select("dataset_id", (F.col("at") - step).alias("place"), F.col("other").alias(name)), ["dataset_id", "place"], "left")
    return out.select("id", "prev_id", "next_id")


STATUSES = ("pending", "pass", "warn", "fail")
CHECKS = ("empty_or_short", "length_outlier", "exact_duplicate", "near_duplicate", "pii", "non_english", "refusal_boilerplate", "formatting")


def _known(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(v).alias(name)) for i, v in enumerate(values))))
    return df.sparkSession.range(1).select(rows.alias("r")).select("r.*")


def status_counts(samples: DataFrame) -> DataFrame:
    """(qc_status, n, percent) of the four statuses, with 0 for those that no sample has."""
    n = samples.groupBy("qc_status").agg(F.count("*").alias("n"))
    every = _known(samples, "qc_status", STATUSES).join(n, "qc_status", "left").select("place", "qc_status", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return every.select("place", "qc_status", "n", F.coalesce(F.round(100 * F.col("n") / total), F.lit(0)).cast("bigint").alias("percent")).orderBy("place").drop("place")


def check_counts(results: DataFrame) -> DataFrame:
    """(check_name, warn, fail) of all eight checks, with 0 where there are none, and of other names behind them."""
    n = results.groupBy("check_name").agg(F.count_if(F.col("severity") == "warn").alias("warn"), F.count_if(F.col("severity") == "fail").alias("fail"))
    every = _known(results, "check_name", CHECKS).join(n, "check_name", "full")
    return every.select("check_name", F.coalesce("warn", F.lit(0)).alias("warn"), F.coalesce("fail", F.lit(0)).alias("fail"), F.coalesce("place", F.lit(len(CHECKS))).alias("place")).orderBy("place", "check_name").drop("place")


def categories(samples: DataFrame, limit: int = 500) -> DataFrame:
    """The categories there are."""
    return samples.select("category").where("category is not null").distinct().orderBy("category").limit(limit)


def category_bars(samples: DataFrame, most: int = 14) -> DataFrame:
    """The most frequent categories, and one row for all others."""
    n = samples.groupBy(F.coalesce("category", F.lit("uncategorised")).alias("name")).agg(F.count("*").alias("n"))
    first = n.orderBy(F.desc("n"), "name").limit(most)
    rest = n.join(F.broadcast(first.select("name")), "name", "left_anti").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("rest").alias("name"), "n")
    return first.unionByName(rest)


def sample_results(results: DataFrame, sample_id: int) -> DataFrame:
    """A sample's results, the worst first."""
    rank = F.when(F.col("severity") == "fail", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return results.where(F.col("id") == sample_id).orderBy(rank, "check_name")


def flagged(results: DataFrame) -> DataFrame:
    """(id, flagged): names of the checks that a sample does not pass."""
    return results.where("severity <> 'pass'").groupBy("id").agg(F.array_sort(F.collect_set("check_name")).alias("flagged"))


def category_counts(samples: DataFrame, limit: int = 30) -> DataFrame:
    name = F.coalesce("category", F.lit("uncategorised"))
    return samples.groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def token_histogram(samples: DataFrame, buckets: int = 12) -> DataFrame:
    """Equal widths from the least value to the 99th percentile; the last bucket is open."""
    samples = written(spread(samples).select("tokens_est"), "lengths")
    edge = samples.agg(F.min("tokens_est").alias("lo"), F.expr("percentile_disc(0.99) within group (order by tokens_est)").cast("bigint").alias("hi"), F.max("tokens_est").alias("top"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / buckets)).cast("bigint")
    edge = edge.where("lo is not null").withColumn("width", width)
    edge = edge.withColumn("n", F.greatest(F.lit(1), F.least(F.lit(buckets), F.ceil((F.col("hi") - F.col("lo")) / F.col("width")))).cast("bigint"))
    counts = samples.join(F.broadcast(edge)).groupBy(F.least(F.floor((F.col("tokens_est") - F.col("lo")) / F.col("width")), F.col("n") - 1).alias("b")).agg(F.count("*").alias("count"))
    slots = edge.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("b"))
    start = F.col("lo") + F.col("b") * F.col("width")
    end = F.when((F.col("b") == F.col("n") - 1) & ((F.col("n") == 1) & (F.col("hi") <= F.col("lo"))), F.col("top")).when(F.col("b") == F.col("n") - 1, F.greatest(start + F.col("width"), F.col("top"))).otherwise(start + F.col("width"))
    return slots.join(counts, "b", "left").select(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def val_count(n: int, ratio: float) -> int:
    """How many of n samples are held out: rounded, one at least and not all."""
    if n <= 0 or ratio <= 0:
        return 0
    k = int(n * ratio + 0.5)
    return min(max(k, 1 if n >= 2 else 0), n - 1)


def split(samples: DataFrame, ratio: float, seed: int) -> DataFrame:
    """(id, split): the val_count ids of least md5(seed:id) are for validation.

    Ids are counted by the first digits of that rank, twice; only those of one bin in 16^6 are sorted, and what comes of it is a bound.
    """
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    ids = samples.select("id", rank.alias("rank"))
    k, prefix, edge = None, "", None
    for _ in range(2):
        some = ids.where(F.startswith("rank", F.lit(prefix)))
        bins = sorted((r.b, r["count"]) for r in some.groupBy(F.substring("rank", len(prefix) + 1, BIN_DIGITS).alias("b")).count().collect())  # 16^3 rows at most
        left = k = val_count(sum(c for _, c in bins), ratio) if k is None else left
        for b, c in bins:
            if left <= c:
                break
            left -= c
        if not left:
            break
        prefix += b
    if left:
        edge = ids.where(F.startswith("rank", F.lit(prefix))).orderBy("rank", "id").limit(left).agg(F.max(F.struct("rank", "id")).alias("e")).first().e
    val = F.lit(False) if edge is None else F.struct("rank", "id") <= F.struct(F.lit(edge["rank"]), F.lit(edge["id"]).cast(dict(samples.dtypes)["id"]))
    return ids.select("id", F.when(val, "val").otherwise("train").alias("split"))


def export_lines(samples: DataFrame, form: str = "jsonl") -> DataFrame:
    """(id, line): a JSON record, or a chat of two turns."""
    if form == "jsonl":
        record = F.struct("prompt", "context", "response", "category")
    elif form == "chat":
        asked = F.concat(F.col("prompt"), F.coalesce(F.concat(F.lit("\n\n"), F.col("context")), F.lit("")))
        turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        record = F.struct(F.array(turn("user", asked), turn("assistant", F.col("response"))).alias("messages"))
    else:
        raise ValueError(f"unknown format {form!r}")
    return samples.select("id", F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))
