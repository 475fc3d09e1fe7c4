"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies (target over size of its
source). The documents of a source stand in an order; the expected copies are summed up along
it, a random offset is added once, and a document comes out once for each whole number that
the sum crosses at it. In order of size the words taken miss the target by at most about one
document.

The sum up to a document is the rate times its rank, and the rank is built in parts, so that a
source with a third of all rows, or a size that a third of all rows share, is many tasks:
sizes within coarse size steps, steps within the source, and hash buckets within one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_names
from tidemark.session import stage

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words separated by ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(value: Column) -> Column:
    """The first 32 bits of MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_copies: float = 3.0) -> DataFrame:
    """Per source: source_size, target and the random offset; ``sizes(source, source_size)``.

    Sources in code-point order, null last, have the weights in turn and share the sum of all
    sizes. A target stops at ``most_copies`` times its source; the excess goes to the others
    by weight. That ends at min(cap, level x weight): with sources in order of cap over
    weight, those before some place are at their cap, and the level follows from what is left.
    The table has a row for each source, so one ordered window over it is small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    capped = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn(
        "cap", F.lit(most_copies) * F.col("source_size")
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everything = Window.partitionBy()
    # were all sources before this one at their cap, this is the level of the others
    caps_before = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    weights_from = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - caps_before) / weights_from
    reached = F.when(level * F.col("weight") <= F.col("cap"), level)
    # it rises up to the right place and then falls
    found = capped.withColumn("level", reached).withColumn("level", F.max("level").over(everything))
    share = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    name = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))
    return found.select(
        "source",
        "source_size",
        share.cast("double").alias("target"),
        F.shiftright(_hash32(name), 12).alias("offset_20"),
    )


def _copies(sized: DataFrame, keep: list[str], weights: tuple[float, ...], most_copies: int, seed: str) -> DataFrame:
    by_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    total = targets(
        by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, float(most_copies)
    )
    # how many documents of the source are smaller: first within a step of sizes, then by step
    step = F.floor(F.log2(F.col("size") + 1) * 16)
    stepped = by_size.withColumn("step", step)
    in_step = Window.partitionBy("source", "step").orderBy("size")
    steps = (
        stepped.groupBy("source", "step")
        .agg(F.sum("n").alias("in_step"))
        .withColumn("before", F.sum("in_step").over(Window.partitionBy("source").orderBy("step")) - F.col("in_step"))
        .select(F.col("source").alias("s_source"), F.col("step").alias("s_step"), "before")
    )
    numbered = stepped.withColumn("smaller", F.sum("n").over(in_step) - F.col("n"))
    per_source = total.select(F.col("source").alias("p_source"), "source_size", "target", "offset_20")
    smaller = (
        numbered.join(steps, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("step") == F.col("s_step")))
        .join(per_source, F.col("source").eqNullSafe(F.col("p_source")))
        .select(
            F.col("source").alias("t_source"),
            F.col("size").alias("t_size"),
            (F.col("smaller") + F.col("before")).alias("smaller"),
            F.ceil(F.sqrt("n")).alias("buckets"),
            "source_size",
            "target",
            "offset_20",
        )
    )
    joined = sized.join(smaller, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = joined.drop("t_source", "t_size").withColumns({"digest": digest}).withColumn(
        "bucket", F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32)
    )
    keys = ["source", "size", "bucket"]
    starts = (
        keyed.groupBy(*keys)
        .agg(F.count("*").alias("in_bucket"))
        .withColumn(
            "in_buckets",
            F.sum("in_bucket").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("in_bucket"),
        )
        .select(*(F.col(k).alias(f"b_{k}") for k in keys), "in_buckets")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("digest", *keep))
    same_bucket = (
        F.col("source").eqNullSafe(F.col("b_source"))
        & (F.col("size") == F.col("b_size"))
        & (F.col("bucket") == F.col("b_bucket"))
    )
    ranked = keyed.withColumn("inside", inside).join(starts, same_bucket)
    rank = (F.col("smaller") + F.col("in_buckets") + F.col("inside")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.col("offset_20") / F.lit(float(1 << 20))
    mixed = ranked.withColumns({"rank": rank, "rate": rate, "offset": offset})
    crossed = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(
        F.col("rate") * (F.col("rank") - 1) + F.col("offset")
    )
    # rounding of the products may show one crossing too many or too few at a whole rate
    whole = F.least(F.greatest(crossed, F.lit(0)), F.lit(most_copies)).cast("long")
    return mixed.select(*keep, "source", "size", "source_size", "target", whole.alias("copies"))


def copies(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_copies: int = 3, seed: str = "mix"
) -> DataFrame:
    """doc_id, source, size, source_size, target and the number of copies, per row of ``docs``.

    Needs doc_id, text and source; a null text has size 0, a null source is a source of its
    own, and so is the empty one. Repeated rows are documents of their own. A source without
    words has target 0 and no copies. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    sized = stage(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mixing-sizes")
    return _copies(sized, ["doc_id"], weights, most_copies, seed)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_copies: int = 3, seed: str = "mix"
) -> DataFrame:
    """The mixed rows themselves: each row of ``docs``, all its columns, as often as it is taken.

    Ranks are built on narrow rows; whole rows are shuffled once, by a hash of the row. Rows
    that repeat whole share their copies evenly. Nulls count as in ``copies``; an empty table
    stays empty. Columns may have any names: inner ones are made to differ from them.
    """
    key, n_copies, n_rows, share, copy, of = free_names(docs, "_key", "_copies", "_rows", "_share", "_copy", "_of")
    keyed = docs.withColumn(key, F.expr("xxhash64(*)"))
    narrow = keyed.select("doc_id", "source", words(F.col("text")).alias("size"), F.col(key).alias("key"))
    sized = stage(narrow, "mixing-sizes")
    rows = _copies(sized, ["doc_id", "key"], weights, most_copies, seed)
    taken = rows.groupBy(F.col("key").alias(of)).agg(F.sum("copies").alias(n_copies), F.count("*").alias(n_rows))
    joined = keyed.join(taken.where(F.col(n_copies) > 0), F.col(key) == F.col(of))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    own = F.floor(F.col(n_copies) / F.col(n_rows)) + (place <= F.col(n_copies) % F.col(n_rows)).cast("int")
    out = joined.withColumn(share, own).where(F.col(share) > 0)
    repeated = F.explode(F.sequence(F.lit(1), F.col(share).cast("int"))).alias(copy)
    return out.select("*", repeated).drop(key, n_copies, n_rows, share, copy, of)
