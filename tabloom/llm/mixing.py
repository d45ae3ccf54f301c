"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a hash-random key, so a source in key order is a random permutation of itself.
The key space is cut into equal ranges; the word counts of each (source, range) are summed, a
running sum over the ranges finds the one in which a source's budget ends, and only that range is
sorted row by row. A source of any size is thus never in one task, and no text is shuffled.
Whole passes over a source ("epochs") come first, the rest of the budget is cut in key order.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its
own, last in order; a source without words has target 0; rows equal in every used column share
what the cut leaves them evenly (rounded down); an empty table gives an empty result. Columns of
the input other than the three named ones do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import WORD_PATTERN, staged

#: Up to so many sources, their plan is broadcast (a row is about 100 bytes); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def key_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash-random key in hexadecimal; rows equal in id and text share it."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest).cast("binary"))


def sized_rows(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=17) -> DataFrame:
    """doc_id, source, size in words and mix_key of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key_of(F.col(id_col), F.col(text_col), seed).alias("mix_key"))


def source_targets(rows: DataFrame, weights=(1, 2, 3), most=3) -> DataFrame:
    """A row for each source: source_size and target, by water-filling.

    Sources in code-point order (null last) weigh `weights`, repeating, and share the sum of all
    sizes; none gets over `most` times its own size. In order of cap per weight, the level that
    the remaining weights share is known for each prefix of capped sources; the first source whose
    cap is above its level fixes the common level.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("left_weight"))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def source_cuts(rows: DataFrame, targets: DataFrame, digits=3) -> DataFrame:
    """targets with whole epochs, the key at which the rest of the budget ends and the words its row takes."""
    budget = F.floor(F.col("target") + 0.5).cast("long")
    t = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    t = t.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    ranges = rows.groupBy("source", F.substring("mix_key", 1, digits).alias("span")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("before", F.sum("words").over(running) - F.col("words"))
    r, x = ranges.alias("r"), t.alias("x")
    last = r.join(x, F.col("r.source").eqNullSafe(F.col("x.source"))).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words"))).select(F.col("r.source").alias("cut_source"), "span", (F.col("rest") - F.col("before")).alias("need"))
    inside = rows.where("size > 0").alias("d").join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.cut_source")) & (F.substring("d.mix_key", 1, digits) == F.col("l.span")))
    inside = inside.groupBy("cut_source", "mix_key", "size", "need").agg(F.count(F.lit(1)).alias("copies"))
    in_order = Window.partitionBy("cut_source").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(in_order)).withColumn("from", F.col("upto") - F.col("size") * F.col("copies"))
    cut = inside.where("`from` < need and need <= upto").select("cut_source", F.col("mix_key").alias("cut_key"), F.floor((F.col("need") - F.col("from")) / F.col("copies")).cast("long").alias("cut_take"))
    return t.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.cut_source")), "left").select("t.*", "cut_key", "cut_take").drop("rest")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), most=3, digits=3, seed=17) -> DataFrame:
    """doc_id, source, mix_key, size, source_size, target and taken (words the mix takes, repeats counted)."""
    rows = staged(sized_rows(docs, id_col, text_col, source_col, seed), "mix-rows")
    cuts = staged(source_cuts(rows, source_targets(rows, weights, most), digits), "mix-cuts")
    return with_taken(rows, cuts)


def with_taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, size, mix_key and more) with source_size, target and taken."""
    plan = cuts.withColumnRenamed("source", "plan_source")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    part = F.when(F.col("mix_key") < F.col("cut_key"), F.col("size")).when(F.col("mix_key") == F.col("cut_key"), F.col("cut_take")).otherwise(F.lit(0))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("taken", (F.col("epochs") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")).drop("plan_source", "epochs", "cut_key", "cut_take")


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), most=3, digits=3, seed=17) -> DataFrame:
    """The mixture itself, with the columns of docs (doc_id, text and source among them).

    A row is repeated as often as it is taken whole; the row at a source's cut comes once more
    with the leading words that the budget still holds. Rows that are not taken go; rows without
    words, which no budget pays for, stay once.
    """
    rows = staged(sized_rows(docs, seed=seed), "mix-rows")
    cuts = staged(source_cuts(rows, source_targets(rows, weights, most), digits), "mix-cuts")
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"), "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text"), seed).alias("mix_key"))
    one = F.greatest("size", F.lit(1))
    taken = with_taken(held, cuts).withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / one)).otherwise(1).cast("int")).withColumn("rest", F.when(F.col("size") > 0, F.col("taken") % one).otherwise(0).cast("int"))
    copies = taken.select("doc", "whole", "rest", F.posexplode(F.array_repeat(F.lit(0), F.col("whole") + F.signum("rest").cast("int"))).alias("copy", "unused"))
    words = F.split(F.regexp_replace("doc.text", "^[\\x20\\x09-\\x0D]+", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    text = F.when(F.col("copy") < F.col("whole"), F.col("doc.text")).otherwise(F.array_join(F.slice(words, 1, F.col("rest")), ""))
    return copies.select(*[text.alias(n) if n == "text" else F.col(f"doc.`{n}`").alias(n) for n in docs.columns])
