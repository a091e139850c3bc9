"""What a user does with a dataset, as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.functions.text import preview
from lakesieve.operators import ask, search, semantic
from lakesieve.operators.quality import non_english
from lakesieve.operators.search import SampleFilter

MOST_ROWS, MOST_QUERY = 500, 500


def find_samples(samples: DataFrame, where: SampleFilter = SampleFilter(), results: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the samples that a filter keeps, with previews of their texts."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"a page of {limit} rows from {offset}, not of 1 to {MOST_ROWS} from 0 or more")
    some = search.page(where.apply(samples, results), limit, offset)
    return some.withColumns({"prompt": preview(F.col("prompt")), "response": preview(F.col("response"))})


def count_samples(samples: DataFrame, where: SampleFilter = SampleFilter(), results: DataFrame | None = None) -> int:
    return where.apply(samples, results).count()


@dataclass(frozen=True)
class Detail:
    statuses: DataFrame
    categories: DataFrame
    histogram: DataFrame


def dataset_detail(samples: DataFrame) -> Detail:
    return Detail(search.status_counts(samples), search.category_counts(samples), search.token_histogram(samples))


def qc_summary(samples: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses of the samples, and warnings and failures by check."""
    return search.status_counts(samples), search.check_counts(results)


def sample_detail(samples: DataFrame, results: DataFrame, sample_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sample, its results, and the samples before and after it in its dataset (prev_id, next_id)."""
    own = samples.where(F.col("id") == sample_id)
    at = F.broadcast(own.select(F.col("dataset_id").alias("d"), F.struct("sample_index", "id").alias("own")))  # one row
    place = F.struct("sample_index", "id")
    near = samples.join(at, F.col("dataset_id") == F.col("d"))
    ends = near.agg(F.max(F.when(place < F.col("own"), place))["id"].alias("prev_id"), F.min(F.when(place > F.col("own"), place))["id"].alias("next_id"))
    return own, search.sample_results(results, sample_id), ends


def nl_search(samples: DataFrame, query: str, results: DataFrame | None = None, dataset_id: int | None = None, models: Iterable[Callable[[str], str]] = ()) -> tuple[DataFrame, SampleFilter, str]:
    """Samples that a query in words asks for, the filter it was understood as, and by whom."""
    if not 1 <= len(query) <= MOST_QUERY:
        raise ValueError(f"a query of {len(query)} characters, not of 1 to {MOST_QUERY}")
    where, by = ask.parse(query, dataset_id, models)
    if where.category:
        there = [r.category for r in search.categories(samples).collect()]  # 500 at most
        where = replace(where, category=ask.resolve_category(where.category, there))
    return where.apply(samples, results), where, by


def with_language(samples: DataFrame) -> DataFrame:
    """Samples with the language that the check finds, where there are no results yet."""
    return samples.withColumn("lang", F.coalesce("lang", non_english()))


def embedding_status(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    return semantic.coverage(samples, vectors)
