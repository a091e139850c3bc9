"""Mixing sources to target weights by Pareto order sampling.

Sources share 100% of all words by weight, none beyond `cap` times its own words (the excess goes to the others by
weight). Within a source, a document's expected copies are proportional to its weight (by default log2(size + 2), so longer
texts are likelier; rounded to 1/64 of a doubling), at most `cap`, and scaled so that the expected words are the source's target. The whole part of
that number is taken for certain. The rest is its inclusion probability p: it draws a uniform number u and is ranked by
(u / (1 - u)) / (p / (1 - p)), its random odds over its inclusion odds, and documents are taken in that order until their
words meet what the whole copies leave of the target.

The order is never sorted as a whole: words are summed by (source, bin of the rank), the bin in which the target falls is
found from those sums, its rows are summed by finer bins, and only those of one fine bin, one in 2^24 of the rank's range, are ranked exactly. So
a source with a third of all rows needs no task of its own; the table of sources is one task's.

A null source is a source of its own, last in order; null and empty texts have size 0; a document of size 0 takes
nothing; texts of any length count by their words. Every row has a draw of its own: rows that agree in id, source and size are numbered.
Ties in rank go by the draw. An empty table gives no rows. Extra columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesieve.llm._rows import with_measures
from lakesieve.llm._spark import cut, free_name, small_batches

CAP = 3
BIN_BITS = 12
SEED = "mix-2"
#: Rows up to this number are sent to every task; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Steps of a doubling to which weights are rounded, and copies of equal rows numbered at once.
WEIGHT_STEPS, RUN = 64, 100_000


def uniform(seed: str, *keys: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of MD5, the same in every engine."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cap: int = CAP, cycle: int = 3) -> DataFrame:
    """(source, source_size, target) by water-filling over the table of sources."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("w", (F.row_number().over(order) - 1) % cycle + 1)
    # the fuller a source for its weight, the later it reaches its cap: those that reach it come first
    by_room = Window.orderBy(F.col("source_size") * 1.0 / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w, size = F.col("w"), F.col("source_size")
    filled = weighed.select(
        "source", "source_size", "w",
        F.sum(size).over(whole).alias("total"),
        F.coalesce(F.sum(size * cap).over(before), F.lit(0)).alias("spent"),
        F.sum(w).over(rest).alias("left"),
    )
    capped = filled.withColumn("capped", size.cast("decimal(38,0)") * cap * F.col("left") <= (F.col("total") - F.col("spent")).cast("decimal(38,0)") * w)
    spent = F.sum(F.when(F.col("capped"), size * cap).otherwise(0)).over(whole)
    left = F.sum(F.when(F.col("capped"), 0).otherwise(w)).over(whole)
    share = (w * (F.col("total") - spent)).cast("double") / left
    return capped.select("source", "source_size", F.when(F.col("capped"), (size * cap).cast("double")).otherwise(share).alias("target"))


def sizes_of(df: DataFrame, text: str, keep: list[str], name: str = "size") -> DataFrame:
    def count(texts):
        return {name: (lambda first: first[1:] - first[:-1])(texts.words()[2])}

    return with_measures(df, text, {name: "bigint"}, count, keep)


def numbered(rows: DataFrame) -> DataFrame:
    """Each row of `rows` with `number`, which tells rows that agree in all columns apart; no group of them is held at once."""
    names = rows.columns
    groups = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    runs = groups.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    last = F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1
    return runs.select(*names, F.explode(F.sequence(F.col("_run") * RUN, last)).alias("number"))


def small(table: DataFrame, what: str) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    table = cut(table, what)
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def expected(rows: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(source, q, whole, p) by source and rounded weight, scaled to the sources' targets, with source_size, target and room."""
    held = rows.where("size > 0").groupBy("source", "q").agg(F.sum("size").cast("double").alias("s")).join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    held = held.withColumn("w", F.pow(F.lit(2.0), F.col("q") / WEIGHT_STEPS))
    order = Window.partitionBy("source").orderBy(F.desc("q"))
    before = F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * cap
    rest = F.sum(F.col("w") * F.col("s")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    held = held.withColumn("full", cap * rest <= (F.col("target") - before) * F.col("w") * (1 + 1e-12))
    mine = Window.partitionBy("source")
    left = F.col("target") - F.sum(F.when(F.col("full"), F.col("s") * cap).otherwise(0.0)).over(mine)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w") * F.col("s"))).over(mine)
    held = held.withColumn("e", F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), left / free * F.col("w")))))
    held = held.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.floor("e"))
    room = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("s")).over(mine))
    return held.select("source", "q", "whole", "p", "source_size", "target", room.alias("room"))


def mix(sizes: DataFrame, cap: int = CAP, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """The rows of `sizes` (doc_id, source, size and others) with source_size, target and `copies`, how often the mix takes each.

    `weight` names a column of positive numbers; null and others weigh next to nothing. `sizes` is read several times:
    pass a written table.
    """
    sources = small(source_targets(sizes, cap).withColumnRenamed("source", "of"), "mix-sources")
    w = F.log2(F.col("size") + 2) if weight is None else F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(1e-9))
    rows = numbered(sizes).select(F.struct(*[F.col(f"`{c}`") for c in sizes.columns]).alias("row"), "number", "doc_id", "source", "size", F.round(WEIGHT_STEPS * F.log2(w)).cast("int").alias("q"))
    shares = small(expected(rows, sources, cap), "mix-shares").withColumnsRenamed({"source": "of", "q": "qq"})
    drawn = rows.join(shares, F.col("source").eqNullSafe(F.col("of")) & (F.col("q") == F.col("qq")) & (F.col("size") > 0), "left").drop("of", "qq", "source_size", "target")
    drawn = drawn.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    u = uniform(seed, F.col("doc_id"), F.col("source"), F.col("size"), F.col("number"))
    rank = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = drawn.withColumn("rank", F.when(F.col("p") > 0, rank))
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * (1 << 2 * BIN_BITS))
    drawn = drawn.withColumn("place", F.least(F.lit((1 << 2 * BIN_BITS) - 1), place).cast("int"))
    drawn = cut(drawn.select("row", "source", "size", "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"), "room", "rank", "place"), "mix-drawn")

    def edges(some: DataFrame, bin_: Column, room: str, name: str) -> DataFrame:
        """By source, the first bin up to whose end there are more words than room, and the room that is left at its start."""
        bins = some.groupBy("source", bin_.alias(name)).agg(F.sum("size").alias("words"), F.first(room).alias("all"))
        bins = bins.withColumn("stop", F.sum("words").over(Window.partitionBy("source").orderBy(name))).where("stop > all")
        left = F.col("all") - F.col("stop") + F.col("words")
        return small(bins.groupBy("source").agg(F.min(F.struct(F.col(name), left.alias("left"))).alias("e")).select(F.col("source").alias("of"), f"e.{name}", F.col("e.left").alias(f"{name}_room")), "mix-edges")

    high, low = F.shiftright("place", BIN_BITS), F.col("place").bitwiseAND(F.lit((1 << BIN_BITS) - 1))
    ranked = drawn.where("place is not null")
    first = edges(ranked, high, "room", "e1")
    at = ranked.join(first, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    second = edges(at.where(high == F.col("e1")), low, "e1_room", "e2")
    at = drawn.join(first, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").join(second, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    on = (high == F.col("e1")) & (low == F.col("e2"))
    ahead = F.col("e1").isNull() | (high < F.col("e1")) | ((high == F.col("e1")) & (F.col("e2").isNull() | (low < F.col("e2"))))
    sure = at.where(~F.coalesce(on, F.lit(False))).withColumn("extra", F.when(F.col("place").isNotNull() & ahead, 1).otherwise(0))
    words = F.sum("size").over(Window.partitionBy("source").orderBy("rank", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1))
    exact = at.where(on).withColumn("extra", F.when(F.coalesce(words, F.lit(0)) + F.col("size") / 2 <= F.col("e2_room"), 1).otherwise(0))
    both = sure.unionByName(exact)
    names = [free_name(sizes.columns, n) for n in ("source_size", "target", "copies")]
    return both.select("row.*", F.col("source_size").alias(names[0]), F.col("target").alias(names[1]), (F.col("whole") + F.col("extra")).cast("bigint").alias(names[2]))


def mix_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it, with `copy` from 1 on: see `_mixed`."""
    with small_batches(df.sparkSession):
        return _mixed(df, text, source, doc_id, cap, seed)


def _mixed(df: DataFrame, text: str, source: str, doc_id: str, cap: int, seed: str) -> DataFrame:
    """The rows of `df`, each as often as the mix takes it, with `copy` from 1 on.

    Copies are joined back by id, source, size and a hash of the row; of rows that agree in all, one stands for the copies of all.
    """
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    size, mark = free_name(df.columns, "size"), free_name(df.columns, "mark")
    held = sizes_of(df, text, df.columns, size).withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    narrow = held.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(size).alias("size"), F.col(mark).alias("mark"))
    key = ["doc_id", "source", "size", "mark"]
    taken = mix(cut(narrow, "mix-sizes"), cap, seed).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    own = {c: free_name(held.columns, f"_taken_{c}") for c in taken.columns}
    taken = cut(taken.withColumnsRenamed(own), "mix-taken")
    same = held[doc_id].eqNullSafe(taken[own["doc_id"]]) & held[source].eqNullSafe(taken[own["source"]]) & (held[size] == taken[own["size"]]) & (held[mark] == taken[own["mark"]])
    both = held.join(taken, same)
    again = both.where(F.col(own["rows"]) > 1)
    again = again.groupBy(*own.values()).agg(F.first(F.struct(*[held[c] for c in df.columns])).alias("_row")).select("_row.*", own["copies"])
    once = both.where(F.col(own["rows"]) == 1).select(*[held[c] for c in df.columns], own["copies"])
    copies = F.explode(F.sequence(F.lit(1), F.col(own["copies"]).cast("int"))).alias(free_name(df.columns, "copy"))
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in df.columns], copies)
