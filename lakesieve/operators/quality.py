"""Dataset-wide statistics and the checks of single samples."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesieve.functions.text import BLANKS, SPACE, bound, collapsed, count_of, split_words, strip, words
from lakesieve.operators.near import FAIL, near_lists, near_pairs
from lakesieve.operators.pii import pii_severity, pii_spans
from lakesieve.store import small, spread, written

MIN_WORDS, MIN_CHARS = 3, 15
MIN_SAMPLES, WARN_Z, FAIL_Z = 20, 3.0, 4.5
COPIES, NEAREST = 10, 5
REFUSAL_WORDS = 60
# Function words of English and of other languages, and phrases of refusals.
ENGLISH = """a about after all also an and any are as at be because been but by can could did do does for from had has
have he her his how i if in into is it its just like many may me more most my no not of on one only or other
our out over she so some such than that the their them then there these they this those to up was we were what
when where which while who will with would you your""".split()
FOREIGN = """el la los las del que en por para con una unos es son est le les des du une et dans pour pas qui sur avec au
aux der die das und ist nicht ein eine mit den dem zu auf von sich auch wie o os um uma não com da do dos das
em il di che per non sono della het een niet op voor zijn yang dan dengan untuk tidak ini itu ada di""".split()
REFUSALS = [
    r"as an ai(?: language)? model",
    r"as a large language model",
    r"as an ai assistant",
    r"i(?:'m| am) (?:just )?an ai\b",
    r"i(?:'m| am) sorry,? but i (?:can(?:'|no)t|am unable|am not able|won't)",
    r"i cannot (?:assist|help|provide|fulfill|comply)",
    r"i can(?:'|no)t (?:assist|help) with (?:that|this)",
    r"i(?:'m| am) (?:unable|not able) to (?:assist|help|provide|comply|fulfill)",
    r"i don(?:'|’)?t have personal (?:opinions|beliefs|feelings|experiences)",
    r"i do not have personal (?:opinions|beliefs|feelings|experiences)",
    r"my knowledge cutoff",
    r"(?:trained|developed|created) by openai",
]
#: Every refusal holds one of these.
REFUSAL_PARTS = ("an ai", "a large language model", "sorry", "i can", "able to", "have personal", "knowledge cutoff", "by openai")
DANGLING = """the a an and or but nor of to in on at for with by from as that which who whose is are was were be been their
his her its our your my this these those into than because although while if when where whether such""".split()
REPEATED, ECHO_WORDS, ECHO_CONTAINED, ECHO_COVERED, TRUNCATED_WORDS = 20, 8, 0.9, 0.95, 50
CODE_SYMBOLS = "{}()[];=<>#$_\\|&*/+`"


def length_stats(samples: DataFrame) -> DataFrame:
    """One row (n, median_tokens, center, scale, method): the scale is the MAD, else the IQR, else the mean deviation."""
    x = written(spread(samples).select(F.log1p("tokens_est").alias("x"), "tokens_est"), "lengths")
    base = x.agg(F.count("*").alias("n"), F.median("tokens_est").alias("median_tokens"), F.median("x").alias("center"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    about = x.join(F.broadcast(base.select("center"))).agg(F.median(F.abs(F.col("x") - F.col("center"))).alias("mad"), F.avg(F.abs(F.col("x") - F.col("center"))).alias("dev"))
    both = base.join(F.broadcast(about))
    iqr = F.col("q")[1] - F.col("q")[0]
    ways = ((F.col("mad") > 0, "mad", F.col("mad") * 1.4826), (iqr > 0, "iqr", iqr / 1.349), (F.col("dev") > 0, "meanabs", F.col("dev") * 1.2533))
    method, scale = F.lit("constant"), F.lit(0.0)
    for test, name, value in reversed(ways):
        method, scale = F.when(test, name).otherwise(method), F.when(test, value).otherwise(scale)
    return both.select("n", "median_tokens", "center", scale.alias("scale"), method.alias("method"))


def severity(fail: Column, warn: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").otherwise("pass")


def told(severity: Column, message: Column, **details: Column) -> Column:
    """A check's verdict: severity, message, and details as JSON."""
    return F.struct(severity.alias("severity"), message.alias("message"), F.to_json(F.struct(*(v.alias(k) for k, v in details.items()))).alias("details"))


def reply_words() -> Column:
    return F.size(split_words(F.col("response")))


def empty_or_short(words: Column | None = None) -> Column:
    n = reply_words() if words is None else words
    return severity((F.col("prompt") == "") | (F.col("response") == ""), (n < MIN_WORDS) | (F.length("response") < MIN_CHARS))


def empty_or_short_told(words: Column) -> Column:
    no_prompt, no_reply = F.col("prompt") == "", F.col("response") == ""
    message = F.when(no_prompt & no_reply, "prompt and response are empty").when(no_reply, "response is empty").when(no_prompt, "prompt is empty").otherwise(F.format_string("response of %d words and %d characters", words, F.length("response")))
    empty = no_prompt | no_reply
    return told(empty_or_short(words), message, prompt_chars=F.when(empty, F.length("prompt")), response_words=F.when(~empty, words), response_chars=F.length("response"))


def length_outlier(samples: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Samples with z and severity; the statistics are one broadcast row."""
    z = (F.log1p(F.greatest("tokens_est", F.lit(0))) - F.col("center")) / F.col("scale")
    known = (F.col("n") >= MIN_SAMPLES) & (F.col("scale") > 0)
    held = samples.join(F.broadcast((length_stats(samples) if stats is None else stats).select("n", "center", "scale")))
    held = held.withColumn("z", F.when(known, z))
    return held.withColumn("severity", F.coalesce(severity(F.abs("z") > FAIL_Z, F.abs("z") > WARN_Z), F.lit("pass"))).drop("n", "center", "scale")


def first_of(rows: DataFrame, key: list[str], most: int, name: str, *more: str) -> DataFrame:
    """By key, the first `most` rows in order of sample_index and id, as an array; tasks send so many of each key at most."""
    order = Window.partitionBy(*key).orderBy("sample_index", "id")
    few = rows.select(*key, "sample_index", "id", *more).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    return few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("sample_index", "id", *more))).alias(name))


def exact_duplicates(samples: DataFrame) -> DataFrame:
    """Samples that repeat earlier ones, with the first COPIES ids of their group before them."""
    samples = written(spread(samples.select("id", "sample_index", "content_hash")), "hashes")
    several = samples.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select("content_hash")
    held = written(samples.join(small(several, "several"), "content_hash", "left_semi"), "copies")
    both = held.join(small(first_of(held, ["content_hash"], COPIES, "first"), "first"), "content_hash")
    earlier = F.transform(F.filter("first", lambda x: x < F.struct(F.col("sample_index"), F.col("id"))), lambda x: x["id"])
    return both.select("id", earlier.alias("duplicate_of")).where(F.size("duplicate_of") > 0)


def prompt_key() -> Column:
    """What samples of the same prompt and context have in common; NULL if both are empty."""
    key = F.concat_ws("\x1f", collapsed(F.lower(F.col("prompt"))), collapsed(F.lower(F.coalesce("context", F.lit("")))))
    return F.when(key != "\x1f", F.sha1(key))


def prompt_conflicts(samples: DataFrame) -> DataFrame:
    """Samples whose prompt and context stand with another response too: how many distinct contents, least id, and the first
    COPIES other samples with another content."""
    key = F.col("prompt_key") if "prompt_key" in samples.columns else prompt_key()
    keyed = written(spread(samples).select("id", "sample_index", "content_hash", key.alias("key")), "keys").where("key is not null")
    groups = keyed.groupBy("key").agg(F.countDistinct("content_hash").alias("n_contents"), F.count("*").alias("n_samples"), F.min("id").alias("first_id")).where("n_contents > 1")
    groups = small(groups, "groups")
    keyed = written(keyed.join(groups.select("key"), "key", "left_semi"), "conflicts")
    # of each content the first COPIES: then the first twice as many of a prompt hold COPIES of another content than any given one
    some = first_of(keyed, ["key", "content_hash"], COPIES, "few").select("key", F.inline("few"), "content_hash")
    lists = small(first_of(some, ["key"], 2 * COPIES, "few", "content_hash"), "lists")
    others = F.slice(F.transform(F.filter("few", lambda x: x["content_hash"] != F.col("content_hash")), lambda x: x["id"]), 1, COPIES)
    return keyed.join(groups, "key").join(lists, "key").select("id", "n_contents", "n_samples", "first_id", others.alias("same_prompt_as"))


def language_told(text: Column) -> Column:
    """struct<lang, letters, ascii_share, en_stopword_ratio, foreign_stopword_ratio>."""
    letters, latin = count_of(text, r"\p{L}\p{Nl}\p{No}"), count_of(text, "A-Za-z")

    def measures(w):
        n = F.size(w)
        english, foreign = F.try_divide(F.size(F.filter(w, lambda x: x.isin(*ENGLISH))), n), F.try_divide(F.size(F.filter(w, lambda x: x.isin(*FOREIGN))), n)
        return F.struct(n.alias("n"), letters.alias("letters"), F.try_divide(latin, letters).alias("ascii"), english.alias("en"), foreign.alias("other"))

    def judged(m):
        other = (m["letters"] >= 20) & ((m["ascii"] < 0.7) | ((m["n"] >= 12) & (m["other"] > 0.12) & (m["other"] > m["en"]) & (m["en"] < 0.06)))
        return F.struct(
            F.when(F.coalesce(other, F.lit(False)), "other").otherwise("en").alias("lang"), m["letters"].alias("letters"), F.round(m["ascii"], 3).alias("ascii_share"),
            F.round(m["en"], 3).alias("en_stopword_ratio"), F.round(m["other"], 3).alias("foreign_stopword_ratio"),
        )

    return bound(words(text), lambda w: bound(measures(w), judged))


def language(text: Column) -> Column:
    """`en` or `other`."""
    return language_told(text)["lang"]


def code_like(text: Column) -> Column:
    ink = F.length(text) - count_of(text, SPACE[1:-1])
    symbols = count_of(text, re.sub(r"(\W)", r"\\\1", CODE_SYMBOLS))
    # two symbols are the least that can be 8% of 20 characters
    return F.contains(text, F.lit("```")) | bound(symbols, lambda n: (n >= 2) & (ink >= 20) & (F.try_divide(n, ink) >= 0.08))


def non_english_told() -> Column:
    """The language of prompt and response without fenced code; of the prompt alone if they look like code."""
    fenced = r"(?s)```.*?(?:```|\z)"
    texts = F.struct(F.regexp_replace(F.concat_ws("\n", "prompt", "response"), fenced, " ").alias("both"), F.regexp_replace("prompt", fenced, " ").alias("prompt"))

    def judged(t):
        code = code_like(t["both"])
        few = count_of(t["prompt"], r"\p{L}") < 20
        return F.when(code, F.when(~code_like(t["prompt"]) & ~few, t["prompt"])).otherwise(t["both"])

    return bound(bound(texts, judged), lambda x: F.when(x.isNotNull(), language_told(x)))


def non_english() -> Column:
    return F.coalesce(non_english_told()["lang"], F.lit("en"))


def refusal_told(words: Column | None = None) -> Column:
    """struct<severity, phrases, vendor_mentions, words>; all in lower case."""
    # fixed value: a vendor beside the first person
    near = r"\b(?:i|i'm|me|my)\b[^.\n]{0,60}\b(?:openai|chatgpt)\b|\b(?:openai|chatgpt)\b[^.\n]{0,60}\b(?:i|i'm|me|my)\b"
    asked = F.lower(F.concat_ws(" ", "prompt", "context")).rlike(r"\b(?:openai|chatgpt)\b")

    def found(low):
        worth = functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in REFUSAL_PARTS))
        phrases = F.when(worth, F.regexp_extract_all(low, F.lit(f"({'|'.join(REFUSALS)})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        maybe = F.contains(low, F.lit("openai")) | F.contains(low, F.lit("chatgpt"))
        vendor = F.when(maybe & ~asked, F.regexp_count(low, F.lit(near))).otherwise(0)
        return F.struct(F.array_sort(F.array_distinct(phrases)).alias("phrases"), vendor.alias("vendor"), (reply_words() if words is None else words).alias("words"))

    def judged(h):
        some = F.size(h["phrases"]) > 0
        return F.struct(severity(some & (h["words"] <= REFUSAL_WORDS), some | (h["vendor"] > 0)).alias("severity"), h["phrases"].alias("phrases"), h["vendor"].alias("vendor_mentions"), h["words"].alias("words"))

    return bound(bound(F.lower(F.replace(F.col("response"), F.lit("’"), F.lit("'"))), found), judged)


def refusal() -> Column:
    return refusal_told()["severity"]


def balanced(code: Column) -> Column:
    """Whether brackets outside of strings and comments match; `!` is what no bracket closes."""
    # fixed values: what strings and comments look like
    code = F.regexp_replace(code, r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', "")
    code = F.regexp_replace(F.regexp_replace(code, r"(?:#|//)[^\n]*", ""), r"[^()\[\]{}]", "")

    def step(held, c):
        closes = c.isin(")", "]", "}") & (F.substring(held, -1, 1) == F.translate(c, ")]}", "([{"))
        return F.when(closes, F.substring(held, F.lit(1), F.length(held) - 1)).when(c.isin(")", "]", "}"), F.concat(held, F.lit("!"))).otherwise(F.concat(held, c))

    return F.aggregate(F.split(code, ""), F.lit(""), step) == ""


def formatting_issues() -> Column:
    """Names of what is wrong with a response's form, in a fixed order."""
    return bound(words(F.col("response")), _issues)


def _issues(w: Column) -> Column:
    reply = F.col("response")
    many = lambda v: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - 2), lambda i: F.array_join(F.slice(v, i, 3), " ")))
    trigrams = lambda x: bound(x, lambda v: F.when(F.size(v) > 2, many(v)).otherwise(F.array().cast("array<string>")))
    sizes = lambda t: F.struct(F.size(t["m"]).alias("m"), F.size(t["a"]).alias("a"), F.size(F.array_intersect(t["m"], t["a"])).alias("c"))
    alike = lambda n: (n["a"] > 0) & (n["c"] >= ECHO_CONTAINED * n["m"]) & (n["c"] >= ECHO_COVERED * n["a"])
    sets = F.struct(trigrams(w).alias("m"), trigrams(words(F.col("prompt"))).alias("a"))
    # as many trigrams as distinct words at least, but for two: most replies have too many for their prompt
    few = ECHO_CONTAINED * (F.size(F.array_distinct(w)) - 2) <= F.size(words(F.col("prompt")))
    echo = (F.size(w) >= ECHO_WORDS) & few & bound(sets, lambda t: bound(sizes(t), alike))
    blocks = F.regexp_extract_all(reply, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    ended = F.rtrim(reply, F.lit(BLANKS))
    line = strip(F.element_at(F.split(ended, r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), -1))
    opened = lambda x, y: F.length(F.translate(line, x, "")) < F.length(F.translate(line, y, ""))
    dangling = F.try_element_at(w, F.lit(-1)).isin(*DANGLING) | opened("[", "]") | opened("(", ")")
    truncated = (F.size(w) >= TRUNCATED_WORDS) & ~F.contains(reply, F.lit("```")) & ended.rlike(r"[\p{L}\p{N}]\z") & ~line.rlike(r"(?U)^(?:[-*•]|\d+[.)])\s") & dangling
    tests = {
        "unbalanced_code_fence": F.regexp_count(reply, F.lit("```")) % 2 == 1,
        "unbalanced_brackets": F.exists(blocks, lambda b: ~balanced(b)),
        "repeated_characters": reply.rlike(rf"([^{SPACE[1:-1]}])\1{{{REPEATED - 1},}}"),
        "prompt_echo": echo,
        "truncated": truncated,
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))


def formatting() -> Column:
    return bound(F.size(formatting_issues()), lambda n: severity(n > 1, n == 1))


def row_checks(samples: DataFrame) -> DataFrame:
    """What the checks of single samples say, in one pass over the texts; without the texts."""
    held = spread(samples).withColumn("spans", pii_spans()).withColumn("n_words", reply_words()).select(
        "id", "dataset_id", "sample_index", "category", "tokens_est", F.coalesce("content_hash", fallback_hash()).alias("content_hash"), prompt_key().alias("prompt_key"),
        empty_or_short_told(F.col("n_words")).alias("empty_or_short"), F.col("spans"), non_english_told().alias("language"), refusal_told(F.col("n_words")).alias("refused"), formatting_issues().alias("issues"),
    )
    kinds = F.aggregate("spans", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), _counted)
    foreign = F.coalesce(F.col("language.lang"), F.lit("en"))
    phrases = F.array_join("refused.phrases", ", ")
    issues = F.array_join("issues", ", ")
    return held.select(
        "id", "dataset_id", "sample_index", "category", "tokens_est", "content_hash", "prompt_key", foreign.alias("lang"), "empty_or_short",
        told(pii_severity(F.col("spans")), F.when(F.size("spans") == 0, "no personal data").otherwise(F.concat(F.lit("personal data: "), F.array_join(F.array_sort(F.map_keys(kinds)), ", "))), spans=F.col("spans"), kinds=kinds).alias("pii"),
        F.struct(F.when(foreign == "other", "warn").otherwise("pass").alias("severity"), F.when(F.col("language").isNull(), "skipped: code").otherwise(F.concat(F.lit("language: "), foreign)).alias("message"), F.to_json(F.coalesce("language", F.struct(F.lit("en").alias("lang"), *[F.lit(None).cast(k).alias(n) for n, k in (("letters", "int"), ("ascii_share", "double"), ("en_stopword_ratio", "double"), ("foreign_stopword_ratio", "double"))]))).alias("details")).alias("non_english"),
        told(F.col("refused.severity"), F.when(phrases != "", F.concat(F.lit("refusal phrases: "), phrases)).when(F.col("refused.severity") == "warn", "speaks as another vendor's model").otherwise("no refusal"), phrases=F.col("refused.phrases"), vendor_mentions=F.col("refused.vendor_mentions"), response_words=F.col("refused.words")).alias("refusal_boilerplate"),
        told(severity(F.size("issues") > 1, F.size("issues") == 1), F.when(issues != "", issues).otherwise("no formatting issues"), issues=F.col("issues")).alias("formatting"),
    )


def _counted(held: Column, span: Column) -> Column:
    """A map of counts with one more of the span's kind."""
    old = F.coalesce(F.try_element_at(held, span["kind"]), F.lit(0))
    return F.map_concat(F.map_filter(held, lambda k, _: k != span["kind"]), F.map_from_arrays(F.array(span["kind"]), F.array(old + 1)))


def fallback_hash() -> Column:
    """For samples without a content hash."""
    return F.sha2(F.concat_ws("\x1f", *(collapsed(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("prompt", "context", "response"))), 256)


def qc(samples: DataFrame) -> DataFrame:
    """(id, dataset_id, sample_index, category, tokens_est, lang, check_name, passed, severity, message, details) of each sample and each of the eight checks.

    Texts are read twice: for the checks of single samples, whose verdicts are written, and for the sets of near copies.
    """
    facts = written(row_checks(samples), "checks")
    stats = small(length_stats(facts), "stats")
    copies, same = exact_duplicates(facts), prompt_conflicts(facts).select("id", "same_prompt_as")
    near = near_lists(near_pairs(samples, facts), facts.select("id", "sample_index"))
    held = length_outlier(facts, stats).withColumnRenamed("severity", "length")
    for more in (copies, same, near):
        held = held.join(small(more, "lists"), "id", "left")
    held = held.join(F.broadcast(stats.select("median_tokens", "method", "n")))
    none = F.array().cast("array<bigint>")
    copied, conflict = F.coalesce("duplicate_of", none), F.coalesce("same_prompt_as", none)
    best = F.try_element_at(F.col("earlier"), F.lit(1))["jaccard"]
    skipped = F.col("z").isNull()
    checks = {
        "empty_or_short": F.col("empty_or_short"),
        "length_outlier": told(F.col("length"), F.when(skipped, "skipped: too few samples, or all of a length").otherwise(F.format_string("%d tokens, z %.2f", "tokens_est", "z")), tokens_est=F.when(~skipped, F.col("tokens_est")), z=F.round("z", 2), dataset_median_tokens=F.when(~skipped, F.col("median_tokens")), method=F.when(~skipped, F.col("method")), n=F.when(skipped, F.col("n"))),
        "exact_duplicate": told(severity(F.size(copied) > 0, F.size(conflict) > 0), F.when(F.size(copied) > 0, "repeats an earlier sample").when(F.size(conflict) > 0, "same prompt, other response").otherwise("no duplicates"), duplicate_of=copied, same_prompt_as=conflict),
        "near_duplicate": told(
            severity((best >= FAIL) & (F.size(copied) == 0), best.isNotNull()), F.when(best.isNotNull(), F.format_string("similar to an earlier sample (%.2f)", best)).when(F.size("later") > 0, "first occurrence of similar samples").otherwise("no similar samples"),
            similar_to=F.slice(F.coalesce(F.when(F.size("earlier") > 0, F.col("earlier")), F.col("later"), F.array().cast("array<struct<id:bigint,jaccard:double>>")), 1, NEAREST),
        ),
        "pii": F.col("pii"), "non_english": F.col("non_english"), "refusal_boilerplate": F.col("refusal_boilerplate"), "formatting": F.col("formatting"),
    }
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("check_name"), (v["severity"] == "pass").alias("passed"), v["severity"].alias("severity"), v["message"].alias("message"), v["details"].alias("details")) for k, v in checks.items())))
    return held.select("id", "dataset_id", "sample_index", "category", "tokens_est", "lang", rows)


def qc_error(samples: DataFrame, message: str) -> DataFrame:
    """The results of samples whose checks could not run."""
    return samples.select("id", "dataset_id", "sample_index", "category", "tokens_est", "lang", F.lit("qc_error").alias("check_name"), F.lit(False).alias("passed"), F.lit("fail").alias("severity"), F.lit(message[:500]).alias("message"), F.lit("{}").alias("details"))


def run_qc(samples: DataFrame, path: str) -> DataFrame:
    """Checks samples and puts the results in the place of those that the table at `path` has of these datasets.

    If the checks fail as a whole, every sample gets one result that says so.
    """
    try:
        results = written(qc(samples), "results")
    except Exception as e:  # whatever ends the run is told of each sample
        results = written(qc_error(samples, f"{type(e).__name__}: {e}"), "results")
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)
    return results


def statuses(results: DataFrame) -> DataFrame:
    """(id, category, qc_status, qc_score): the worst severity, an unknown one being as bad as fail, and the share of checks passed."""
    rank = F.when(F.col("severity") == "pass", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    worst = results.groupBy("id", "category").agg(F.max(rank).alias("r"), F.round(F.avg((F.col("severity") == "pass").cast("int")), 4).alias("qc_score"))
    return worst.select("id", "category", F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("r") + 1).alias("qc_status"), "qc_score")


def with_status(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Samples with status, score and language from their results; those without results are pending."""
    found = statuses(results).drop("category").join(results.groupBy("id").agg(F.first("lang", True).alias("found")), "id")
    own = samples.drop("qc_status", "qc_score").join(found, "id", "left")
    return own.withColumn("qc_status", F.coalesce("qc_status", F.lit("pending"))).withColumn("lang", F.coalesce("found", "lang")).drop("found")
