"""Raw JSON files: discovery, reading, read status, and a profile of unknown records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.jsonfields import elements as elements_of
from tidemark.functions.jsonfields import is_array, is_object, once
from tidemark.operators.pick import top_per_group
from tidemark.sources import fields as f

RAW_GLOB = "*.{jsonl.gz,json.gz,jsonl}"


def path_date(path: str | Column) -> Column:
    """``YYYYMMDD`` folder in a path (null without one)."""
    p = F.col(path) if isinstance(path, str) else path
    found = F.regexp_extract(p, r"/(\d{8})(?=/)", 1)
    return F.when(found != "", found)


def raw_lines(
    spark: SparkSession,
    roots: Sequence[str],
    *,
    start_date: str | None = None,
    end_date: str | None = None,
    glob: str = RAW_GLOB,
    whole_file: bool = False,
) -> DataFrame:
    """Lines (or whole files) below the roots with their file and position.

    The date filter works on the ``YYYYMMDD`` folder, both ends included, and drops
    files without one; it reaches the file listing as a metadata filter. A truncated
    gzip file yields the lines before the break instead of failing the job.
    """
    reader = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
    )
    df = reader.text(list(roots), wholetext=whole_file).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    if start_date or end_date:
        day = path_date("source_file")
        df = df.where(day.isNotNull())
        if start_date:
            df = df.where(day >= start_date)
        if end_date:
            df = df.where(day <= end_date)
    return df


def parse_lines(lines: DataFrame) -> DataFrame:
    """``rec`` (VARIANT) per line and a ``corrupt`` flag; blank lines are dropped."""
    text = lines.where(F.trim("line") != "")
    return once(text, {"rec": F.try_parse_json(F.trim("line"))}).withColumn("corrupt", F.col("rec").isNull())


def records(parsed: DataFrame) -> DataFrame:
    """Readable objects only: bad lines and lines that are not objects are left out."""
    return parsed.where(~F.col("corrupt") & is_object("rec")).drop("corrupt")


def whole_file_records(files: DataFrame) -> DataFrame:
    """Objects of whole-file JSON: an array of objects, or one object."""
    parsed = parse_lines(files)
    items = F.coalesce(F.try_variant_get("rec", "$", "array<variant>"), F.array("rec"))
    rows = parsed.where("NOT corrupt").select("source_file", F.explode(items).alias("rec"))
    return rows.where(is_object("rec"))


def read_status(parsed: DataFrame, by: str = "source_file") -> DataFrame:
    """Per file: lines, readable rows, corrupt rows, whether a readable part was kept."""
    ok = ~F.col("corrupt")
    return parsed.groupBy(by).agg(
        F.count("*").alias("lines"),
        F.count_if(ok & F.schema_of_variant("rec").startswith("OBJECT")).alias("readable_rows"),
        F.count_if(F.col("corrupt")).alias("corrupt_rows"),
    ).withColumn("kept_readable_part", (F.col("corrupt_rows") > 0) & (F.col("readable_rows") > 0))


_TEXTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def nesting_depth(recs: DataFrame, rec: str = "rec") -> int:
    """How many objects and arrays stand inside one another at most, over all records.

    Brackets outside of texts are followed through each record. (A merged schema would not
    do: it stops where records disagree about a type.)
    """
    signs = F.regexp_replace(F.regexp_replace(F.to_json(rec), _TEXTS, ""), r"[^\[\]{}]", "")

    def step(state: Column, sign: Column) -> Column:
        now = state["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return recs.agg(F.max(F.aggregate(F.split(signs, ""), start, step)["most"])).first()[0] or 0


def descendants(recs: DataFrame, rec: str = "rec") -> DataFrame:
    """Every value inside a record with its key path: one row each, columns ``path`` and ``v``.

    Paths look like ``a.b`` and ``a[].b``; all elements of arrays are followed, and the
    record itself stands under the empty path. Records are opened one level after the other
    within their row, down to the deepest; nothing is shuffled.
    """

    def opened(item: Column) -> Column:
        base, v = item["path"], item["v"]
        members = F.transform(
            F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")),
            lambda e: F.struct(
                F.when(base == "", e["key"]).otherwise(F.concat(base, F.lit("."), e["key"])).alias("path"), e["value"].alias("v")
            ),
        )
        elements = F.transform(elements_of(v), lambda x: F.struct(F.concat(base, F.lit("[]")).alias("path"), x.alias("v")))
        none = F.array().cast("array<struct<path:string,v:variant>>")
        return F.when(is_object(v), members).when(is_array(v), elements).otherwise(none)

    levels = ["__level0"]
    out = recs.withColumn("__level0", F.array(F.struct(F.lit("").alias("path"), F.col(rec).alias("v"))))
    for depth in range(1, nesting_depth(recs, rec) + 1):
        levels.append(f"__level{depth}")
        out = out.withColumn(levels[-1], F.flatten(F.transform(levels[-2], opened)))
    out = out.select(*recs.columns, F.explode(F.concat(*levels)).alias("__d"))
    return out.select(*recs.columns, "__d.path", "__d.v")


def record_paths(recs: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """Every key path of every record with its value as text."""
    named = descendants(recs.select(*keep, "rec")).where("path <> '' AND NOT endswith(path, '[]')")
    return named.select(*keep, "path", F.try_variant_get("v", "$", "string").alias("value"))


def profile(recs: DataFrame, *, by: str = "source_file", samples: int = 3, order: str | None = None, first_records: int | None = None) -> DataFrame:
    """Key paths per file: occurrences, up to ``samples`` values, time and id candidates."""
    source = recs
    if first_records is not None:
        source = top_per_group(recs, keys=[by], score=order, tie=[order], k=first_records, descending=False).drop("rank")
    paths = record_paths(source, keep=[by])
    lowered = F.lower("path")

    def mentions(tokens, endings) -> Column:
        cond = F.lit(False)
        for t in tokens:
            cond = cond | lowered.contains(t)
        for e in endings:
            cond = cond | F.col("path").endswith(e)
        return cond

    # distinct values first, then at most `samples` of them: no unbounded set is built
    values = paths.where("value IS NOT NULL").groupBy(by, "path", "value").agg(F.count("*").alias("n"))
    few = top_per_group(values, keys=[by, "path"], score="value", tie=["value"], k=samples, descending=False)
    shown = few.groupBy(by, "path").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    counts = paths.groupBy(by, "path").agg(F.count("*").alias("occurrences"))
    return counts.join(shown, [by, "path"], "left").select(
        by,
        "path",
        "occurrences",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        mentions(f.TIME_TOKENS, f.TIME_ENDINGS).alias("time_candidate"),
        mentions(f.ID_TOKENS, f.ID_ENDINGS).alias("id_candidate"),
    )


KINDS = ("object", "array", "string", "number", "boolean", "null")


def kind_of(variant: str | Column) -> Column:
    """What a JSON value is: one of ``KINDS``."""
    name = F.schema_of_variant(F.col(variant) if isinstance(variant, str) else variant)
    kind = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
    return kind.when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")


def typed_profile(recs: DataFrame, *, by: str = "source_file") -> DataFrame:
    """Every path of the records per file: occurrences, count of each type, key set, three values.

    Paths are those of ``descendants``, elements of arrays (``a[]``) and the record itself (the
    empty path) included, so a path whose values differ in type shows all of them. Counts and
    values (the least, the greatest, and one chosen by hash, as text, of strings, numbers and
    booleans) are combined map-side: one row a path and task is shuffled, however many
    records there are. ``keys`` are the sorted keys seen in the objects of the path, read off the
    paths below it; a key with a dot or bracket in it is taken for a path.
    """
    found = descendants(recs.select(by, "rec")).withColumn("kind", kind_of("v"))
    scalar = F.col("kind").isin("string", "number", "boolean")
    text = F.when(scalar, F.try_variant_get("v", "$", "string"))
    paths = found.select(by, "path", "kind", text.alias("value")).groupBy(by, "path").agg(
        F.count("*").alias("occurrences"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.min("value").alias("least_value"),
        F.max("value").alias("greatest_value"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(F.xxhash64("value"), "value"))).alias("some_value"),
    )
    name = F.regexp_extract("path", r"(?:^|\.)([^.\[\]]+)$", 1)
    inner = paths.where(name != "").select(
        by, F.regexp_replace("path", r"(?:^|\.)[^.\[\]]+$", "").alias("path"), name.alias("key")
    )
    keys = inner.groupBy(by, "path").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return paths.join(keys, [by, "path"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
