"""The canonical table of samples, and adapters that bring other tables into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesieve.functions.text import clean, collapsed
from lakesieve.sources.fields import class_label

# Roles in chats.
USER_ROLES = ("user", "human", "prompter")
REPLY_ROLES = ("assistant", "gpt", "bot", "model", "chatgpt")
SYSTEM_ROLES = ("system",)
CATEGORY_CHARS = 100
TURN = "struct<role:string,text:string>"


def with_derived(df: DataFrame) -> DataFrame:
    """Rows (id, dataset_id, sample_index, prompt, context, response, category) with all that is derived from their texts.

    sample_index may be missing; it is the id then.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    cleaned = {c: clean(F.col(c), kinds[c]) for c in ("prompt", "context", "response", "category")}
    cleaned["context"] = F.nullif(cleaned["context"], F.lit(""))
    cleaned["category"] = F.nullif(F.substring(cleaned["category"], 1, CATEGORY_CHARS), F.lit(""))
    index = F.col("sample_index") if "sample_index" in kinds else F.col("id")
    df = df.select("id", "dataset_id", index.cast("bigint").alias("sample_index"), *(v.alias(c) for c, v in cleaned.items()))
    key = F.concat_ws("\n", *(collapsed(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in ("prompt", "context", "response")))
    chars = F.length("prompt") + F.coalesce(F.length("context"), F.lit(0)) + F.length("response")
    return df.select(
        "*", F.length("prompt").alias("prompt_chars"), F.length("response").alias("response_chars"), F.ceil(chars / 4).cast("int").alias("tokens_est"), F.sha1(key).alias("content_hash"),
        F.lit("pending").alias("qc_status"), F.lit(None).cast("double").alias("qc_score"), F.lit(None).cast("string").alias("lang"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Dataset 1: the first line is the prompt, the rest the response, the source the category; order is that of ids."""
    text = F.coalesce("text", F.lit(""))
    at = F.locate("\n", text)
    return with_derived(docs.select(
        F.col("doc_id").alias("id"), F.lit(1).cast("bigint").alias("dataset_id"), F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("prompt"),
        F.lit(None).cast("string").alias("context"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("response"), F.col("source").alias("category"),
    ))


def first_of(turns: Column, roles: tuple[str, ...]) -> Column:
    return F.try_element_at(F.filter(turns, lambda t: t["role"].isin(*roles)), F.lit(1))["text"]


def parse_chat(turns: Column) -> tuple[Column, Column, Column]:
    """(system, prompt, response) of an ordered array<struct<role,text>>: the system turn only before the first user turn, the reply only after it."""
    n = F.size(turns)
    first = F.array_min(F.filter(F.transform(turns, lambda t, i: F.when(t["role"].isin(*USER_ROLES), i + 1)), lambda i: i.isNotNull()))
    before = F.slice(turns, 1, F.coalesce(first, n + 1) - 1)
    after = F.when(first.isNotNull(), F.slice(turns, first + 1, F.greatest(n - first, F.lit(0))))
    return first_of(before, SYSTEM_ROLES), F.try_element_at(turns, first)["text"], first_of(after, REPLY_ROLES)


def content_text(content: Column, kind: T.DataType) -> Column:
    """The text of a message: a list of parts gives the texts that aren't empty, one a line."""
    if not isinstance(kind, T.ArrayType):
        return clean(content, kind)
    part = kind.elementType
    if isinstance(part, T.StructType):
        own = {f.name: f.dataType for f in part}
        texts = F.transform(content, lambda p: clean(p["text"], own["text"])) if "text" in own else F.array().cast("array<string>")
    else:
        texts = F.transform(content, lambda p: clean(p, part))
    return clean(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))


def turns_of(chat: Column, kind: T.DataType) -> Column:
    """A chat in any of its forms as array<struct<role,text>>: {role, content} or {from, value}, or either as JSON."""
    if isinstance(kind, T.StringType):
        # a content is a text or a list of parts
        held = F.from_json(chat, "array<struct<role:string,`from`:string,content:string,value:string>>")
        parts = lambda c: F.from_json(c, "array<struct<text:string>>")
        text = lambda c: F.when(F.startswith(F.ltrim(c), F.lit("[{")) & parts(c).isNotNull(), F.array_join(F.filter(F.transform(parts(c), lambda p: clean(p["text"])), lambda t: t != ""), "\n")).otherwise(clean(c))
        return F.transform(held, lambda m: F.struct(F.lower(clean(F.coalesce(m["role"], m["from"]))).alias("role"), text(F.coalesce(m["content"], m["value"])).alias("text")))
    message = kind.elementType
    own = {f.name: f.dataType for f in message}
    role = next((c for c in ("role", "from") if c in own), None)
    body = next((c for c in ("content", "value", "text") if c in own), None)
    told = lambda m: F.struct((F.lower(clean(m[role], own[role])) if role else F.lit("")).alias("role"), (content_text(m[body], own[body]) if body else F.lit("")).alias("text"))
    return F.transform(chat, told)


def extract(rows: DataFrame, fields: dict[str, str], labels: dict[str, list[str]] | None = None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(prompt, context, response, category) of source rows under a mapping, behind the columns `keep`; other columns are not read.

    Columns named for prompt, response or context win over the turns of a chat. A chat that is no JSON is the prompt.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    got = {f: clean(F.col(f"`{c}`"), kinds[c]) for f, c in fields.items() if f != "messages"}
    if fields.get("category") in (labels or {}):
        got["category"] = class_label(F.col(f"`{fields['category']}`"), labels[fields["category"]])
    if "messages" in fields:
        chat, kind = F.col(f"`{fields['messages']}`"), kinds[fields["messages"]]
        system, prompt, response = parse_chat(turns_of(chat, kind))
        if isinstance(kind, T.StringType):
            prompt = F.when(F.from_json(chat, "array<string>").isNull(), clean(chat)).otherwise(prompt)
        got = {"prompt": prompt, "response": response, "context": system} | got
    none = F.lit(None).cast("string")
    return rows.select(*keep, *(got.get(f, none).alias(f) for f in ("prompt", "context", "response", "category")))


def from_conversations(turns: DataFrame) -> DataFrame:
    """Dataset 2: a sample for each conversation."""
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.lower("role").alias("role"), "text"))).alias("chat"))
    system, prompt, response = parse_chat(F.col("chat"))
    return with_derived(chats.select(F.col("conv_id").alias("id"), F.lit(2).cast("bigint").alias("dataset_id"), prompt.alias("prompt"), system.alias("context"), response.alias("response"), F.lit(None).cast("string").alias("category")))


def sample_text(most: int = 2000) -> Column:
    """What is embedded of a sample: prompt and response."""
    return F.substring(clean(F.concat(clean(F.col("prompt")), F.lit("\n\n"), clean(F.col("response")))), 1, most)
