"""Train and test splits that keep speakers apart, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _shuffled(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"), 256)


def _marked(keys: DataFrame, key: str, train_fraction: float, seed: int) -> DataFrame:
    """(key, split) for distinct keys: the first round(fraction n), one at least and n - 1 at most, of a seeded order train.

    The cut is the n_train-th smallest hash. It is found among buckets of leading hash digits, so that no sort holds all keys
    in one task: whole buckets below the cut's bucket train, and only that bucket's keys are ranked."""
    keys = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__h", _shuffled(seed, key)).withColumn("__b", F.substring("__h", 1, 4))
    counts = keys.groupBy("__b").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).select(
        F.col("t"), F.greatest(F.lit(1), F.least(F.col("t") - 1, F.bround(F.lit(train_fraction) * F.col("t"), 0).cast("bigint"))).alias("train")
    )
    # At most 65,536 buckets, whatever the number of keys.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = keys.join(before.select("__b", "before"), "__b").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) + F.col("before"))
    return ranked.crossJoin(F.broadcast(total)).select(
        key, F.when(F.col("t") < 2, F.raise_error(F.lit("a split needs two keys at least")).cast("string")).when(F.col("__r") <= F.col("train"), "train").otherwise("test").alias("split")
    )


def speaker_split(df: DataFrame, train_fraction: float = 0.8, seed: int = 13, on_missing: str = "drop") -> DataFrame:
    """df with ``split``; all rows of a speaker are on one side. Rows without a speaker go, or raise an error with "fail"."""
    df = df.drop("split")
    if on_missing == "fail":
        df = df.where(F.when(F.col("speaker_id").isNull(), F.raise_error(F.lit("a row has no speaker")).cast("boolean")).otherwise(True))
    return df.join(_marked(df, "speaker_id", train_fraction, seed), "speaker_id")


def utterance_split(df: DataFrame, train_fraction: float = 0.8, seed: int = 13) -> DataFrame:
    """df with ``split`` by utterance; a missing speaker becomes "unknown"."""
    out = df.drop("split").join(_marked(df, "utt_id", train_fraction, seed), "utt_id")
    return out.withColumn("speaker_id", F.coalesce("speaker_id", F.lit("unknown")))


def explicit_split(df: DataFrame) -> DataFrame:
    """Datasets with a row marked train or test keep just their marked rows; the others keep all, with a null split.

    The datasets that are marked are few, whatever the rows, so they come from an aggregate and not from a window."""
    marked = F.coalesce(F.col("split").isin("train", "test"), F.lit(False))
    uses = df.groupBy("dataset_idx").agg(F.max(marked).alias("__uses"))
    return df.join(uses, "dataset_idx").where(~F.col("__uses") | marked).withColumn("split", F.when(F.col("__uses"), F.col("split"))).drop("__uses")


def split_groups(df: DataFrame) -> DataFrame:
    """(split, speaker_id), distinct."""
    return df.select("split", "speaker_id").where("speaker_id IS NOT NULL AND split IS NOT NULL").distinct()


def overlap(df: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Keys on both sides of the split; empty for a sound split."""
    train, test = (df.where(F.col("split") == s).select(key) for s in ("train", "test"))
    return train.intersect(test)


def assert_disjoint(df: DataFrame, key: str = "speaker_id") -> None:
    if not overlap(df, key).isEmpty():
        raise ValueError(f"{key} on both sides of the split")
