"""Exports: train and validation files of the samples that a filter keeps, a manifest, and an archive of them."""

from __future__ import annotations

import json
import re
import zipfile
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.operators.search import SampleFilter, export_lines, split
from lakesieve.store import written

GENERATOR = "lakesieve"


class ExportError(ValueError):
    """An export that cannot be made."""


def manifest_of(export_id: int, source: dict, fields: dict, where: SampleFilter, form: str, ratio: float, train: int, val: int, made: datetime | None = None) -> dict:
    conditions = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(where).items() if v not in (None, ())}
    return {
        "generator": GENERATOR, "export_id": export_id, "source": source, "fields": fields, "filter": conditions, "format": form, "val_ratio": ratio,
        "counts": {"total": train + val, "train": train, "val": val}, "files": {"train": "train.jsonl", "val": "val.jsonl"}, "created_at": (made or datetime.now(UTC)).isoformat(),
    }


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Spark can write."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def build_export(samples: DataFrame, folder: str, where: SampleFilter = SampleFilter(), form: str = "jsonl", ratio: float = 0.1, export_id: int = 1, results: DataFrame | None = None, source: dict | None = None, fields: dict | None = None) -> dict:
    """Writes train.jsonl and val.jsonl (folders of part files in the order of sample_index) and manifest.json; gives the manifest.

    The split depends on ids and `export_id` only, so a rerun gives the same files.
    """
    if not 0 <= ratio <= 0.5:
        raise ExportError(f"a validation share of {ratio}, not of 0 to 0.5")
    if form not in ("jsonl", "chat"):
        raise ExportError(f"unknown format {form!r}")
    chosen = written(where.apply(samples, results).select("id", "sample_index", "prompt", "context", "response", "category"), "chosen")
    lines = export_lines(chosen, form).join(chosen.select("id", "sample_index"), "id").join(split(chosen, ratio, export_id), "id")
    lines = written(lines, "lines")
    counts = {r.split: r["count"] for r in lines.groupBy("split").count().collect()}
    if not counts:
        raise ExportError("no samples match the filter")
    spark = samples.sparkSession
    for name in ("train", "val"):
        own = lines.where(F.col("split") == name)
        own.repartitionByRange("sample_index", "id").sortWithinPartitions("sample_index", "id").select("line").write.mode("overwrite").text(f"{folder}/{name}.jsonl")
    manifest = manifest_of(export_id, source or {}, fields or {}, where, form, ratio, counts.get("train", 0), counts.get("val", 0))
    put_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2, ensure_ascii=False))
    return manifest


def archive(spark: SparkSession, folder: str, path: str) -> str:
    """One deflated archive of an export, on the driver's disk: for downloads, a line at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("manifest.json", "\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))
        for name in ("train", "val"):
            parts = spark.read.text(f"{folder}/{name}.jsonl").select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
            with out.open(f"{name}.jsonl", "w", force_zip64=True) as lines:
                for r in parts.orderBy("f", "b", "i").toLocalIterator():
                    lines.write((r.value + "\n").encode())
    return path


def export_filename(repo: str, export_id: int) -> str:
    """A name for downloads: the last part of a repository's name, other characters than letters, digits, . _ - as _."""
    name = re.sub(r"[^\w.-]", "_", repo.rpartition("/")[2]) or "dataset"
    return f"{name}-export-{export_id}.zip"
