"""A folder of datasets: what was imported, its samples, results, vectors, raw copies and exports.

Below the root are tables by dataset (`samples`, `results`, `vectors`), `datasets` and `exports` with a row for each event
(the last of an id holds), and `raw` and `files` with a folder for each dataset.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.operators import export, quality, semantic
from lakesieve.operators.search import SampleFilter
from lakesieve.sources import imports
from lakesieve.sources.files import listed
from lakesieve.store import written

DATASETS = "id bigint, repo string, config string, split string, status string, error string, fields string, imported bigint, total bigint, gone boolean, at timestamp"
EXPORTS = "id bigint, dataset_id bigint, status string, error string, filter string, format string, val_ratio double, train bigint, val bigint, gone boolean, at timestamp"
TABLES, FOLDERS = ("samples", "results", "vectors"), ("raw", "files")


class CatalogError(ValueError):
    """A dataset that is there already, or isn't."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _events(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        events = self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))
        return events.withColumn("k", last).where("k = 1 and not gone").drop("k", "gone")

    def _event(self, name: str, schema: str, **row) -> None:
        names = [x.split()[0] for x in schema.split(", ")]
        row = {"gone": False, "at": datetime.now(UTC).replace(tzinfo=None)} | row
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], schema).write.mode("append").parquet(f"{self.root}/{name}")

    def datasets(self) -> DataFrame:
        """The newest first."""
        return self._events("datasets", DATASETS).orderBy(F.desc("at"), F.desc("id"))

    def exports(self, dataset_id: int | None = None) -> DataFrame:
        """The newest first, of one dataset or of all."""
        found = self._events("exports", EXPORTS)
        return (found if dataset_id is None else found.where(F.col("dataset_id") == dataset_id)).orderBy(F.desc("at"), F.desc("id"))

    def table(self, name: str, dataset_id: int | None = None) -> DataFrame | None:
        """Samples, results or vectors; None if there are none yet. A dataset's folder is the only one read for it."""
        path = f"{self.root}/{name}"
        if not self._there(path) or not any(f.endswith(".parquet") for f in listed(self.spark, path)):
            return None
        held = self.spark.read.parquet(path).withColumn("dataset_id", F.col("dataset_id").cast("bigint"))
        return held if dataset_id is None else held.where(F.col("dataset_id") == dataset_id)

    def _next(self, rows: DataFrame) -> int:
        return (rows.agg(F.max("id")).first()[0] or 0) + 1

    def add(self, folder: str, repo: str | None = None, config: str = "default", split: str = "train", raw: bool = False, **how) -> int:
        """Imports a folder's configuration and split as a dataset and gives its id; `raw` keeps a copy of the rows as they came.

        CatalogError if it is there already. A failed import stays in the list with what went wrong.
        """
        repo, there = repo or folder, self._events("datasets", DATASETS)
        same = (F.col("repo") == repo) & (F.col("config") == config) & (F.col("split") == split) & (F.col("status") != "failed")
        if there.where(same).limit(1).count():
            raise CatalogError(f"{repo} {config} {split} is imported already")
        number = self._next(self.spark.read.schema(DATASETS).parquet(f"{self.root}/datasets") if self._there(f"{self.root}/datasets") else there)
        own = {"id": number, "repo": repo, "config": config, "split": split}
        self._event("datasets", DATASETS, status="importing", **own)
        try:
            got = imports.import_dataset(self.spark, folder, number, config, split, **how)
            imports.append_dataset(got.samples, f"{self.root}/samples")
            if raw:
                root = (how.get("converted") if got.source.converted else folder).rstrip("/")
                imports.ordered(self.spark, [f"{root}/{f}" for f in got.source.files]).write.mode("overwrite").parquet(f"{self.root}/raw/{number}")
        except Exception as e:
            self._event("datasets", DATASETS, status="failed", error=f"{type(e).__name__}: {e}"[:500], **own)
            raise
        self._event("datasets", DATASETS, status="ready", fields=json.dumps(got.fields), imported=got.samples.count(), total=got.total, **own)
        return number

    def check(self, dataset_id: int) -> DataFrame:
        """Runs all checks, replaces the results and brings status, score and language of the samples up to date."""
        samples = self._samples(dataset_id)
        results = quality.run_qc(samples, f"{self.root}/results")
        imports.append_dataset(written(quality.with_status(samples, results), "checked"), f"{self.root}/samples")
        return results

    def embed(self, dataset_id: int, embedder: semantic.Embedder = semantic.embed_words, model: str = semantic.MODEL) -> DataFrame:
        """Makes the vectors that are missing; those of other models and of samples that are gone are dropped."""
        made = semantic.embed_dataset(self._samples(dataset_id), self.table("vectors", dataset_id), embedder, model)
        imports.append_dataset(made.withColumn("dataset_id", F.lit(dataset_id).cast("bigint")), f"{self.root}/vectors")
        return made

    def export(self, dataset_id: int, where: SampleFilter = SampleFilter(), form: str = "jsonl", ratio: float = 0.1) -> dict:
        """Builds an export; it is listed as ready, or as failed with what went wrong."""
        samples, one = self._samples(dataset_id), self.datasets().where(F.col("id") == dataset_id).first()
        number = self._next(self._events("exports", EXPORTS))
        own = {"id": number, "dataset_id": dataset_id, "format": form, "val_ratio": float(ratio)}
        try:
            made = export.build_export(samples, f"{self.root}/files/{dataset_id}/{number}", where, form, ratio, number, self.table("results", dataset_id), {"repo": one.repo, "config": one.config, "split": one.split}, json.loads(one.fields or "{}"))
        except Exception as e:
            self._event("exports", EXPORTS, status="failed", error=f"{type(e).__name__}: {e}"[:500], **own)
            raise
        self._event("exports", EXPORTS, status="ready", filter=json.dumps(made["filter"]), train=made["counts"]["train"], val=made["counts"]["val"], **own)
        return made

    def delete(self, dataset_id: int) -> bool:
        """Removes a dataset with all that belongs to it; whether there was one."""
        one = self.datasets().where(F.col("id") == dataset_id).first()
        if one is None:
            return False
        for r in self.exports(dataset_id).collect():
            self._event("exports", EXPORTS, id=r.id, dataset_id=dataset_id, status="deleted", gone=True)
        for name in TABLES:
            imports.delete_dataset(self.spark, f"{self.root}/{name}", dataset_id)
        for name in FOLDERS:
            imports.delete_folder(self.spark, f"{self.root}/{name}/{int(dataset_id)}")
        self._event("datasets", DATASETS, id=dataset_id, status="deleted", gone=True)
        return True

    def _samples(self, dataset_id: int) -> DataFrame:
        held = self.table("samples", dataset_id)
        if held is None or held.isEmpty():
            raise CatalogError(f"there is no dataset {dataset_id}")
        return held


def bars(counts: Iterable) -> list:
    """Rows of check counts in the order of a chart: most failures, then warnings, then by name."""
    return sorted(counts, key=lambda r: (-r.fail, -r.warn, r.check_name))


def progress(imported: int, total: int | None) -> int | None:
    """Percent of a split that is imported, 100 at most."""
    return None if not total else min(100, (200 * imported + total) // (2 * total))


def pass_rate(passed: int, total: int) -> int | None:
    """Percent of samples that pass, rounded."""
    return None if not total else (200 * passed + total) // (2 * total)


def bucket_filter(start: int, end: int, last: bool) -> SampleFilter:
    """The samples of a bucket of a token histogram: its end belongs to the last one only."""
    return SampleFilter(min_tokens=start, max_tokens=end if last else end - 1)
