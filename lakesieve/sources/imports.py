"""From a folder of source files to the table of samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.sources.fields import detect_fields
from lakesieve.sources.files import Source, SourceError, labels_of, listed, ordered, resolve
from lakesieve.sources.samples import extract, with_derived
from lakesieve.store import written

MOST_SAMPLES = 20_000


@dataclass(frozen=True)
class Imported:
    samples: DataFrame
    source: Source
    fields: dict[str, str]
    total: int


def import_dataset(spark: SparkSession, folder: str, dataset_id: int = 1, config: str = "default", split: str = "train", max_samples: int | None = None, fields: dict[str, str] | None = None, converted: str | None = None) -> Imported:
    """Samples of a configuration and split below `folder` (or of `converted`, a folder of converted Parquet files), in file order.

    sample_index counts from 0; ids are dataset_id * 2^40 + sample_index. `max_samples` keeps the first rows only; `total`
    counts all of the split. Only mapped columns are read.
    """
    found = resolve(listed(spark, folder), config, split, listed(spark, converted) if converted else None)
    root = (converted if found.converted else folder).rstrip("/")
    paths = [f"{root}/{f}" for f in found.files]
    rows = ordered(spark, paths)
    mapped = detect_fields(rows.drop("sample_index").schema, fields)
    labels = labels_of(spark, paths[0]) if paths[0].lower().endswith(".parquet") else {}
    total = rows.count()
    if not total:
        raise SourceError("the source files hold no rows")
    if max_samples is not None:
        rows = rows.where(F.col("sample_index") < max_samples)
    index = F.col("sample_index")
    numbered = rows.select(*dict.fromkeys([*mapped.values(), "sample_index"]))
    texts = extract(numbered, mapped, labels, keep=["sample_index"])
    samples = with_derived(texts.select((F.lit(dataset_id).cast("bigint") * (1 << 40) + index).alias("id"), F.lit(dataset_id).cast("bigint").alias("dataset_id"), "sample_index", "prompt", "context", "response", "category"))
    return Imported(written(samples, "samples"), found, mapped, total)


def append_dataset(samples: DataFrame, path: str) -> None:
    """Adds a dataset to a table of samples by dataset; one of the same id is replaced, others stay."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Removes a folder, wherever Spark can write; whether there was one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_dataset(spark: SparkSession, path: str, dataset_id: int) -> bool:
    """Removes a dataset's folder of a table by dataset; whether there was one."""
    return delete_folder(spark, f"{path}/dataset_id={int(dataset_id)}")
