"""Samples from a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakesieve.operators.quality import row_checks
from lakesieve.sources.fields import detect_fields
from lakesieve.sources.samples import extract, with_derived


def ingest(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, id_column: str, form: str = "json", dataset_id: int = 1, fields: dict[str, str] | None = None, distinct: bool = False, checks: bool = False) -> StreamingQuery:
    """Writes the samples of all files that arrive to <out>/batch=<n>, and stops when it has read what is there.

    A batch that is repeated after a failure overwrites its own folder, so each row is written once. `distinct` drops samples
    whose content came before, over all batches; `checks` adds the verdicts of the checks that need one sample only.
    """
    rows = spark.readStream.schema(schema).format(form).load(folder)
    mapped = detect_fields(T.StructType([f for f in schema if f.name != id_column]), fields)
    texts = extract(rows, mapped, keep=[id_column])
    samples = with_derived(texts.select(F.col(id_column).cast("bigint").alias("id"), F.lit(dataset_id).cast("bigint").alias("dataset_id"), "prompt", "context", "response", "category"))
    if distinct:
        samples = samples.dropDuplicates(["content_hash"])

    def put(batch: DataFrame, number: int) -> None:
        if checks:
            told = row_checks(batch).select("id", F.col("lang").alias("found"), *(F.col(c)["severity"].alias(c) for c in ("empty_or_short", "pii", "non_english", "refusal_boilerplate", "formatting")))
            batch = batch.join(told.dropDuplicates(["id"]), "id").withColumn("lang", F.col("found")).drop("found")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return samples.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
