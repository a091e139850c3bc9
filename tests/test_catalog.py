import json

import pytest
from pyspark.sql import functions as F

from lakesieve.functions.segments import blocks, redacted, segments
from lakesieve.operators.pii import pii_spans
from lakesieve.operators.search import SampleFilter
from lakesieve.plans import catalog


def test_a_dataset_from_import_to_deletion(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "train.jsonl").write_text("".join(json.dumps({"prompt": f"question {i}", "response": f"a reply of several words, number {i}", "category": "ab"[i % 2]}) + "\n" for i in range(30)))
    held = catalog.Catalog(spark, str(tmp_path / "root"))
    number = held.add(str(source), "me/data", raw=True)
    with pytest.raises(catalog.CatalogError):
        held.add(str(source), "me/data")
    with pytest.raises(ValueError):
        held.add(str(source), "me/data", split="test")
    assert [(r.id, r.status) for r in held.datasets().collect()] == [(2, "failed"), (number, "ready")]
    assert held.check(number).count() == 240 and held.table("samples", number).where("qc_status = 'pending'").count() == 0
    assert held.embed(number).count() == 30 and held.embed(number).count() == 30 and held.table("vectors", number).count() == 30
    assert held.export(number, SampleFilter(category="a"), ratio=0.2)["counts"] == {"total": 15, "train": 12, "val": 3}
    with pytest.raises(ValueError):
        held.export(number, SampleFilter(category="none"))
    assert [(r.id, r.status) for r in held.exports(number).collect()] == [(2, "failed"), (1, "ready")]
    assert held.delete(number) and not held.delete(number) and held.exports().count() == 0 and held.table("samples", number) is None
    with pytest.raises(catalog.CatalogError):
        held.check(number)


def test_small_measures():
    class Row:
        def __init__(self, check_name, warn, fail):
            self.check_name, self.warn, self.fail = check_name, warn, fail

    assert [r.check_name for r in catalog.bars([Row("a", 1, 0), Row("b", 0, 2), Row("c", 5, 2), Row("d", 1, 0)])] == ["c", "b", "a", "d"]
    assert (catalog.progress(5, 0), catalog.progress(1, 3), catalog.progress(9, 3), catalog.pass_rate(1, 8), catalog.pass_rate(0, 0)) == (None, 33, 100, 13, None)
    assert catalog.bucket_filter(5, 9, False).max_tokens == 8 and catalog.bucket_filter(5, 9, True).max_tokens == 9


def test_parts_of_texts(spark):
    text = "see\n```py\nx = 1\n```\nand ```\nopen"
    df = spark.createDataFrame([(text,), ("plain",), ("",)], "t string")
    got = [[(b.kind, b.text) for b in r.b] for r in df.select(blocks(F.col("t")).alias("b")).collect()]
    assert got == [[("text", "see\n"), ("code", "x = 1"), ("text", "\nand "), ("code", "open")], [("text", "plain")], []]
    one = spark.createDataFrame([("é me@site.org or 10.20.30.40!", None, "none")], "prompt string, context string, response string").withColumn("s", pii_spans())
    assert [(p.kind, p.text) for p in one.select(segments(F.col("prompt"), F.col("s"), "prompt").alias("p")).first().p] == [(None, "é "), ("email", "me@site.org"), (None, " or "), ("ip_address", "10.20.30.40"), (None, "!")]
    assert one.select(redacted(F.col("prompt"), F.col("s"), "prompt")).first()[0] == "é [EMAIL] or [IP_ADDRESS]!"
