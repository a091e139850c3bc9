"""Named queries over the driver's tables; `oracles.py` has the same in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lakesieve.functions.text import preview
from lakesieve.operators import near, pii, semantic
from lakesieve.operators import quality as q
from lakesieve.operators import search as s
from lakesieve.operators.search import SampleFilter
from lakesieve.plans import api
from lakesieve.sources.samples import from_conversations, from_documents


def _docs(spark, d):
    return from_documents(spark.read.parquet(f"{d}/documents.parquet"))


def _with_labels(spark, d):
    """Labels as results of a check `toxic`."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return labels.select(F.col("doc_id").alias("id"), F.lit("toxic").alias("check_name"), F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("severity"))


def _filtered(**kw):
    return lambda spark, d: SampleFilter(**kw).apply(_docs(spark, d), _with_labels(spark, d)).select("id", "tokens_est")


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _missing(spark, d):
    return _docs(spark, d).select("id").join(_vectors(spark, d).select(F.col("vec_id").alias("id")), "id", "left_anti")


def _coverage(spark, d):
    held = _docs(spark, d).select("id").join(_vectors(spark, d).select(F.col("vec_id").alias("id"), F.lit(1).alias("v")), "id", "left")
    return held.agg(F.count("*").alias("total"), F.count("v").alias("embedded"))


def _samples(df):
    return df.select("id", "prompt_chars", "response_chars", "tokens_est", "content_hash", "category", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"), F.md5("context").alias("context_md5"))


def _stats(spark, d):
    st = q.length_stats(_docs(spark, d))
    return st.select("n", "median_tokens", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "method")


def _status_counts(spark, d):
    return q.statuses(q.qc(_docs(spark, d))).groupBy("category", "qc_status").agg(F.count("*").alias("n"))


def _by_check(spark, d):
    return s.check_counts(q.qc(_docs(spark, d)))


def _flagged(spark, d):
    return s.flagged(q.qc(_docs(spark, d))).select("id", F.array_join("flagged", ",").alias("flagged"))


def _outliers(spark, d):
    return q.length_outlier(_docs(spark, d)).select("id", F.round("z", 2).alias("z"), "severity")


def _copies(spark, d):
    return q.exact_duplicates(_docs(spark, d)).select("id", F.array_join("duplicate_of", ",").alias("duplicate_of"))


def _pii(spark, d):
    held = _docs(spark, d).select("id", pii.pii_spans().alias("spans"))
    return held.select("id", F.size("spans").alias("n_spans"), F.array_join(F.array_sort(F.transform("spans", lambda s: s["kind"])), ",").alias("kinds"), pii.pii_severity(F.col("spans")).alias("severity"))


def _near(spark, d):
    docs = _docs(spark, d)
    return docs.select("id").join(near.near_severity(docs), "id", "left").select("id", F.coalesce("near", F.lit("pass")).alias("severity"))


def _near_lists(spark, d):
    docs = _docs(spark, d)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return near.near_lists(near.near_pairs(docs), docs).select("id", ids("earlier").alias("earlier"), ids("later").alias("later"))


def _conflict_lists(spark, d):
    return q.prompt_conflicts(_docs(spark, d)).select("id", F.array_join("same_prompt_as", ",").alias("same_prompt_as"))


def _labelled(spark, d):
    """Samples with statuses from their labels."""
    none = F.lit(None).cast("string")
    return q.with_status(_docs(spark, d), _with_labels(spark, d).select("*", none.alias("category"), none.alias("lang")))


def _exported(spark, d):
    return s.split(_docs(spark, d), 0.1, 42).groupBy("split").agg(F.count("*").alias("n"))


def _similar(spark, d):
    """Every vector whose id is divisible by 100, against all others."""
    vectors = _vectors(spark, d)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return semantic.nearest(vectors, queries, 10, "vec_id").withColumnRenamed("id", "vec_id")


def _semantic(spark, d):
    vectors = _vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    return semantic.search(_docs(spark, d).where("tokens_est >= 50"), vectors, [math.cos(i) for i in range(64)], 25).select("id", "similarity", "tokens_est")


def _embedded(spark, d):
    made = semantic.embed_dataset(_docs(spark, d))
    return made.select("id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_dims"), F.round(F.array_max("embedding").cast("double"), 4).alias("largest"))


def _asked(query):
    def run(spark, d):
        docs = _docs(spark, d)
        return api.nl_search(api.with_language(docs) if "english" in query else docs, query)[0].select("id", "tokens_est")

    return run


ASKED = {
    "nl_search_longer": ("samples longer than 500 tokens", "tokens_est >= 501"),
    "nl_search_between": ("between 100 and 300 tokens", "tokens_est between 100 and 300"),
    "nl_search_about": ("about 200 tokens", "tokens_est between 160 and 240"),
    "nl_search_short": ("short answers", "tokens_est <= 40"),
    "nl_search_words": ("under 200 words but at least 400 characters", "tokens_est between 100 and 259"),
    "nl_search_quoted": ('samples with "License" over 1k tokens', "tokens_est >= 1001 and (prompt ilike '%License%' or response ilike '%License%')"),
    "nl_search_topic": ("long samples mentioning license", "tokens_est >= 400 and (prompt ilike '%license%' or response ilike '%license%')"),
    "nl_search_english": ("english only, at most 800 tokens", "tokens_est <= 800 and lang = 'en'"),
}


QUERIES = {
    "build_samples_documents": lambda spark, d: _samples(_docs(spark, d)),
    "build_samples_chat": lambda spark, d: _samples(from_conversations(spark.read.parquet(f"{d}/conversations.parquet"))),
    "prompt_preview": lambda spark, d: _docs(spark, d).select("id", preview(F.col("prompt")).alias("preview")),
    "filter_tokens_range": _filtered(min_tokens=100, max_tokens=400),
    "filter_category_ilike": _filtered(category="SRC_"),
    "filter_text_contains": _filtered(text_contains="License"),
    "filter_failed_check_exists": _filtered(failed_check="toxic"),
    "missing_vectors_anti": _missing,
    "embedding_coverage": _coverage,
    "samples_page": lambda spark, d: s.page(_docs(spark, d), 50, 100).select("id", "category", "tokens_est"),
    "category_counts": lambda spark, d: s.category_counts(_docs(spark, d)),
    "token_histogram": lambda spark, d: s.token_histogram(_docs(spark, d)),
    "length_stats": _stats,
    "check_empty_or_short": lambda spark, d: _docs(spark, d).select("id", q.empty_or_short().alias("severity")),
    "check_length_outlier": _outliers,
    "exact_duplicates": _copies,
    "prompt_conflicts": lambda spark, d: q.prompt_conflicts(_docs(spark, d)).drop("same_prompt_as"),
    "check_non_english": lambda spark, d: _docs(spark, d).select("id", q.non_english().alias("lang")),
    "check_refusal_boilerplate": lambda spark, d: from_conversations(spark.read.parquet(f"{d}/conversations.parquet")).select("id", q.refusal().alias("severity")),
    "check_pii": _pii,
    "near_duplicate_pairs": lambda spark, d: near.near_pairs(_docs(spark, d)),
    "check_near_duplicate": _near,
    "check_formatting": lambda spark, d: _docs(spark, d).select("id", F.array_join(q.formatting_issues(), ",").alias("issues")),
    "qc_status_counts": _status_counts,
    "qc_by_check_summary": _by_check,
    "flagged_checks": _flagged,
    "similar_samples": _similar,
    "semantic_topk": _semantic,
    "fake_embed_documents": _embedded,
    "filter_lang": lambda spark, d: SampleFilter(lang="other").apply(api.with_language(_docs(spark, d))).select("id", "tokens_est"),
    "neighbours_prev_next": lambda spark, d: s.neighbours(_docs(spark, d)),
    "prompt_conflict_lists": _conflict_lists,
    "near_duplicate_lists": _near_lists,
    "status_counts": lambda spark, d: s.status_counts(_labelled(spark, d)),
    "check_counts": lambda spark, d: s.check_counts(_with_labels(spark, d)),
    "distinct_categories": lambda spark, d: s.categories(_docs(spark, d)),
    "category_bars": lambda spark, d: s.category_bars(_docs(spark, d)),
    "export_counts": _exported,
    "qc_run_all": lambda spark, d: q.qc(_docs(spark, d)).select("id", "check_name", "passed", "severity"),
    "export_split": lambda spark, d: s.split(_docs(spark, d), 0.1, 42),
    "export_jsonl": lambda spark, d: s.export_lines(_docs(spark, d)).select("id", F.get_json_object("line", "$.category").alias("category"), F.length(F.get_json_object("line", "$.response")).alias("response_chars")),
    "export_chat": lambda spark, d: s.export_lines(from_conversations(spark.read.parquet(f"{d}/conversations.parquet")), "chat").select("id", F.md5(F.get_json_object("line", "$.messages[0].content")).alias("asked"), F.md5(F.get_json_object("line", "$.messages[1].content")).alias("replied")),
}
QUERIES |= {name: _asked(query) for name, (query, _) in ASKED.items()}
