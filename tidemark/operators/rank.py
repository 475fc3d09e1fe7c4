"""Equal-frequency bins, chronological splits, and exact AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.quantile import null_safe_join
from tidemark.operators.scan import micros, prefix_scan, row_index, time_bucket, value_index


def equal_bins(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    value: str,
    tie: str,
    bins: int = 10,
    rule: str = "floor",
    name: str = "decile",
) -> DataFrame:
    """Number rows 1…bins by position in (value, tie) order.

    ``floor``: floor(idx · bins / n) + 1. ``cuts``: bin d holds positions from
    int(d · n / bins) up to int((d + 1) · n / bins). The two differ when n is not a
    multiple of bins; neither is ``ntile``.
    """
    indexed = value_index(df, keys=keys, value=value, tie=tie, name="__idx")
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    full = null_safe_join(indexed, n, keys)
    idx, total = F.col("__idx"), F.col("__n")
    if rule == "floor":
        number = F.least(F.lit(bins - 1), F.floor(idx * bins / total)) + 1
    elif rule == "cuts":
        # the largest d with int(d n / bins) <= idx
        starts = F.filter(
            F.sequence(F.lit(0), F.lit(bins - 1)), lambda d: F.floor(d * total / bins) <= idx
        )
        number = F.array_max(starts) + 1
    else:
        raise ValueError("rule must be 'floor' or 'cuts'")
    return full.withColumn(name, number.cast("int")).drop("__idx", "__n")


def _check_ratios(train: float, valid: float, test: float) -> None:
    if abs(train + valid + test - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")


def _split_label(idx: Column, n: Column, train: float, valid: float) -> Column:
    # the two cuts are evaluated in double and cut toward zero
    first = (n * F.lit(float(train))).cast("bigint")
    second = (n * F.lit(float(train + valid))).cast("bigint")
    return F.when(idx < first, "train").when(idx < second, "valid").otherwise("test")


def time_split(
    df: DataFrame,
    *,
    ts: str,
    tie: Sequence[str],
    train: float = 0.70,
    valid: float = 0.15,
    test: float = 0.15,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Chronological train / valid / test by row position."""
    _check_ratios(train, valid, test)
    indexed = row_index(df, keys=[], bucket=None if bucket_seconds is None else time_bucket(ts, bucket_seconds), order=[micros(ts), *tie], name="__idx")
    n = df.agg(F.count("*").alias("__n"))
    full = null_safe_join(indexed, n, [])
    return full.withColumn("split", _split_label(F.col("__idx"), F.col("__n"), train, valid)).drop("__idx", "__n")


def entity_split_map(
    df: DataFrame,
    *,
    entity: str,
    ts: str,
    train: float = 0.70,
    valid: float = 0.15,
    test: float = 0.15,
    bucket_seconds: int | None = 86_400,
) -> DataFrame:
    """(entity, split): whole entities in order of their first time; null times drop out."""
    first = df.groupBy(entity).agg(F.min(ts).alias("__first")).dropna(subset=["__first"])
    return time_split(
        first, ts="__first", tie=[entity], train=train, valid=valid, test=test, bucket_seconds=bucket_seconds
    ).select(entity, "split")


def entity_split(df: DataFrame, *, entity: str, ts: str, **ratios: float) -> DataFrame:
    """Attach the split of the row's entity (null where the entity has no time)."""
    return df.join(entity_split_map(df, entity=entity, ts=ts, **ratios), entity, "left")


def binary_metrics(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    label: str,
    prob: str,
) -> DataFrame:
    """Rows, exact AUC, log loss, Brier score and accuracy at 0.5 per group.

    Non-finite pairs are left out and probabilities clipped to [1e-6, 1 - 1e-6]. AUC
    is the rank statistic with ties counted half; null when a group has one class.
    """
    y = F.col(label).cast("double")
    pairs = df.where(fn.is_finite(label) & fn.is_finite(prob)).select(
        *keys, y.alias("__y"), fn.clip_probability(F.col(prob).cast("double")).alias("__p")
    )
    # ranks only depend on the distinct probabilities
    counted = pairs.groupBy(*keys, "__p").agg(
        F.sum(F.when(F.col("__y") == 1, 1).otherwise(0)).alias("__pos"),
        F.sum(F.when(F.col("__y") == 1, 0).otherwise(1)).alias("__neg"),
    )
    below = prefix_scan(
        counted,
        keys=keys,
        bucket=F.floor(F.col("__p") * 1024).cast("bigint"),
        order=["__p"],
        sums={"__neg_upto": F.col("__neg")},
    )
    pos, neg, upto, p = F.col("__pos"), F.col("__neg"), F.col("__neg_upto"), F.col("__p")
    n = F.sum(pos + neg)
    wins = F.sum(pos.cast("double") * ((upto - neg) + neg / 2.0))
    pairs_n = F.sum(pos).cast("double") * F.sum(neg)
    return below.groupBy(*keys).agg(
        n.alias("rows"),
        (wins / F.when(pairs_n > 0, pairs_n)).alias("auc"),
        (F.sum(-(pos * F.ln(p) + neg * F.ln(1 - p))) / n).alias("logloss"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / n).alias("brier"),
        (F.sum(F.when(p >= 0.5, pos).otherwise(neg)) / n).alias("accuracy_0p5"),
    )


def unpivot_probabilities(
    df: DataFrame, *, keep: Sequence[str], columns: Sequence[str], name: str = "probability"
) -> DataFrame:
    """One row per probability column, ready for metrics by source."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("p")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, f"__p.{name}", "__p.p")


def calibration_bins(df: DataFrame, *, keys: Sequence[str] = (), label: str, prob: str) -> DataFrame:
    """Ten fixed-width probability bins: rows, mean prediction, observed rate."""
    binned = df.where(fn.is_finite(prob)).withColumn("prob_bin", fn.probability_bin(prob))
    out = binned.groupBy(*keys, "prob_bin").agg(
        F.count("*").alias("rows"),
        F.avg(prob).alias("mean_pred"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )
    return out.withColumn("prob_bucket", fn.probability_bin_text("prob_bin"))


def confusion(df: DataFrame, *, keys: Sequence[str] = (), actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def multiclass_metrics(
    df: DataFrame, *, keys: Sequence[str] = (), actual: str, predicted: str, classes: Sequence[str]
) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and per-class precision / recall / F1 / support.

    Everything follows from one conditional aggregate; an empty denominator gives 0.
    Balanced accuracy averages the recall of the classes that occur.
    """
    a, b = F.col(actual), F.col(predicted)
    aggs = [F.count("*").alias("rows"), F.sum((a == b).cast("int")).alias("__hit")]
    for i, c in enumerate(classes):
        aggs += [
            F.sum(((a == c) & (b == c)).cast("int")).alias(f"__tp{i}"),
            F.sum((a == c).cast("int")).alias(f"__act{i}"),
            F.sum((b == c).cast("int")).alias(f"__prd{i}"),
        ]
    g = df.groupBy(*keys).agg(*aggs)

    def ratio(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))

    cols: list[Column] = [F.col("rows"), (F.col("__hit") / F.col("rows")).alias("accuracy")]
    recalls, f1s, seen, per_class = [], [], [], []
    for i, c in enumerate(classes):
        tp, act, prd = F.col(f"__tp{i}"), F.col(f"__act{i}"), F.col(f"__prd{i}")
        precision, recall = ratio(tp, prd), ratio(tp, act)
        f1 = ratio(2.0 * tp, act + prd)
        recalls.append(recall)
        f1s.append(f1)
        seen.append((act > 0).cast("int"))
        per_class += [
            precision.alias(f"precision_{c}"),
            recall.alias(f"recall_{c}"),
            f1.alias(f"f1_{c}"),
            act.alias(f"support_{c}"),
        ]
    n_seen = sum(seen[1:], seen[0])
    cols.append((sum(recalls[1:], recalls[0]) / F.when(n_seen > 0, n_seen)).alias("balanced_accuracy"))
    cols.append((sum(f1s[1:], f1s[0]) / len(classes)).alias("macro_f1"))
    return g.select(*keys, *cols, *per_class)


def threshold_metrics(
    df: DataFrame, *, keys: Sequence[str] = (), label: str, prob: str, thresholds: Sequence[float]
) -> DataFrame:
    """Signals, precision and recall at each threshold, from one pass without a fan-out."""
    y, p = F.col(label), F.col(prob)
    aggs = [F.count("*").alias("rows"), F.sum(y.cast("bigint")).alias("positives")]
    for i, t in enumerate(thresholds):
        aggs += [
            F.sum((p >= t).cast("bigint")).alias(f"__s{i}"),
            F.sum(((p >= t) & (y == 1)).cast("bigint")).alias(f"__h{i}"),
        ]
    g = df.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"__s{i}").alias("signals"),
                F.when(F.col(f"__s{i}") > 0, F.col(f"__h{i}") / F.col(f"__s{i}")).otherwise(0.0).alias("precision"),
                F.when(F.col("positives") > 0, F.col(f"__h{i}") / F.col("positives")).otherwise(0.0).alias("recall"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return g.select(*keys, "rows", "positives", F.explode(rows).alias("__t")).select(
        *keys, "rows", "positives", "__t.*"
    )
