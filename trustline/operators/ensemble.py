"""Resampling of segments into balanced training examples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import accuracy, uniform
from ..lineage import checkpointed, stored, stored_parts
from .features import joined_features


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """df with a 0-based rank within ``by`` in ``order``, and ``group_rows``, the group's size.

    Rows are dealt by ranges of the order and sorted inside each range, where their places are numbered; a range adds the
    rows of the ranges before it. So no group is sorted by one task, and rows are exchanged once."""
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__m", F.monotonically_increasing_id())
    dealt = checkpointed(placed).withColumn("__p", F.shiftright("__m", 33)).withColumn("__m", F.col("__m").bitwiseAND((1 << 33) - 1))
    counts = dealt.groupBy(*by, "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row a range and group: a table of the size of the partitioning.
    shift = counts.select(*by, "__p", (before - F.col("__first")).alias("__b"), F.sum("__n").over(group).alias("group_rows"))
    return dealt.join(shift, [*by, "__p"]).withColumn(rank, F.col("__m") + F.col("__b")).drop("__p", "__b", "__m")


def accuracy_deciles(segments: DataFrame, by: str = "split") -> DataFrame:
    """segments with rank, group_rows and decile: pool k has ranks k M // 10 to (k + 1) M // 10; empty pools have no number."""
    out = ranked(segments, [by], ["accuracy", "segment_id"])
    pool = F.when(F.col("group_rows") >= 10, F.expr("(10 * rank + 9) div group_rows")).otherwise(F.col("rank"))
    return out.withColumn("decile", pool.cast("int"))


def draws(counts: DataFrame, n: int, seed: int = 13, min_words: int = 512, max_words: int = 512, min_segments: int = 2, least_words: int = 10, primary: float = 0.75, by: str = "split") -> DataFrame:
    """(by, sample_id, draw, target, rank) for counts (by, group_rows): as many draws a sample as can be needed.

    A sample has a primary pool; a draw is from it with probability ``primary``, else from all other segments alike. Numbers
    are hashes of seed, group, sample and draw: the same for any partitioning."""
    most = max(min_segments, math.ceil(max_words / least_words))
    spark = counts.sparkSession
    samples = spark.range(n).withColumnRenamed("id", "sample_id").crossJoin(F.broadcast(counts.select(by, "group_rows")))
    u = lambda what, *extra: uniform(F.lit(seed), F.col(by), F.col("sample_id"), *extra, F.lit(what))
    m = F.col("group_rows")
    pools = F.least(m, F.lit(10))
    out = samples.withColumn("target", (F.lit(min_words) + F.floor(u("words") * (max_words - min_words + 1))).cast("bigint")).withColumn("pool", F.floor(u("pool") * pools))
    start = lambda k: F.when(m >= 10, F.floor(k * m / 10)).otherwise(k)
    out = out.withColumn("first", start(F.col("pool"))).withColumn("size", start(F.col("pool") + 1) - F.col("first"))
    out = out.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    u1, u2 = u("kind", F.col("draw")), u("rank", F.col("draw"))
    other = F.floor(u2 * (m - F.col("size")))
    rank = F.when((u1 < primary) | (pools == 1), F.col("first") + F.floor(u2 * F.col("size"))).otherwise(F.when(other < F.col("first"), other).otherwise(other + F.col("size")))
    return out.select(by, "sample_id", "draw", "target", rank.cast("bigint").alias("rank"))


def draw_until_target(segments: DataFrame, n: int, seed: int = 13, min_words: int = 512, max_words: int = 512, min_segments: int = 2, by: str = "split") -> DataFrame:
    """Draws of n samples a group, each up to the first where its words reach the target and its draws ``min_segments``.

    segments are those of accuracy_deciles(). Only ids and word counts join here; frames are gathered later."""
    counts = segments.groupBy(by).agg(F.max("group_rows").alias("group_rows"))
    drawn = draws(counts, n, seed, min_words, max_words, min_segments, by=by)
    known = drawn.join(segments.select(by, "rank", "segment_id", "reference_words", "edit_errors"), [by, "rank"])
    before = Window.partitionBy(by, "sample_id").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    had = F.coalesce(F.sum("reference_words").over(before), F.lit(0))
    return known.withColumn("words_before", had).where((F.col("words_before") < F.col("target")) | (F.col("draw") < min_segments)).select(by, "sample_id", "draw", "target", "words_before", "rank", "segment_id", "reference_words", "edit_errors")


def gather_draws(drawn: DataFrame, segments: DataFrame, by: str = "split") -> DataFrame:
    """One row a sample: its segments' frames end to end in draw order, and the sums of their words and errors."""
    full = drawn.join(segments.select("segment_id", "ctc_tokens", "ctc_probs", "ctc_frame_len"), "segment_id")
    rows = full.groupBy(by, "sample_id").agg(
        F.array_sort(F.collect_list(F.struct("draw", "ctc_tokens", "ctc_probs"))).alias("__d"),
        F.sum("edit_errors").alias("edit_errors"), F.sum("reference_words").alias("ref_words"), F.max("ctc_frame_len").alias("ctc_frame_len"), F.count("*").alias("n_segments"),
    )
    return rows.withColumn("ctc_tokens", F.flatten(F.transform("__d", lambda d: d["ctc_tokens"]))).withColumn("ctc_probs", F.flatten(F.transform("__d", lambda d: d["ctc_probs"]))).drop("__d")


def ensemble_targets(gathered: DataFrame) -> DataFrame:
    """gathered with accuracy; samples without frames go."""
    return gathered.where(F.size("ctc_tokens") > 0).withColumn("accuracy", accuracy("edit_errors", "ref_words"))


def ensemble_samples(segments: DataFrame, n: int, seed: int = 13, min_words: int = 512, max_words: int = 512, min_segments: int = 2, by: str = "split") -> DataFrame:
    """Balanced samples with their frames and accuracies, from segments with frames and ``by``; n of each of its values.

    Test samples of each dataset on its own are those of its test segments by ``dataset_idx``."""
    pools = accuracy_deciles(segments.drop("ctc_tokens", "ctc_probs"), by)
    return ensemble_targets(gather_draws(draw_until_target(pools, n, seed, min_words, max_words, min_segments, by), segments, by))


# A task joins the frames of so many words, and so many are joined at a time, or a sixth of all.
TASK_WORDS, WAVE_WORDS, WAVES = 500_000, 4_000_000, 6


def sample_features(segments: DataFrame, n: int, seed: int = 13, min_words: int = 512, max_words: int = 512, min_segments: int = 2, by: str = "split", full: bool = False) -> DataFrame:
    """(by, sample_id, accuracy, ref_words, features...) of ensemble_samples(), stored; from segments with flagged() streams.

    A segment is drawn for many samples, so the streams of all samples are many times the segments'. They are made in at most
    six turns, whose exchanges are deleted turn by turn."""
    streams = ["ctc_flags", "ctc_values", "first_token", "last_token", "ctc_frame_len"]
    pools = accuracy_deciles(segments.select(by, "segment_id", "accuracy", "reference_words", "edit_errors"), by)
    drawn = stored(draw_until_target(pools, n, seed, min_words, max_words, min_segments, by).select(by, "sample_id", "draw", "segment_id", "reference_words", "edit_errors"))
    words = drawn.agg(F.sum("reference_words")).first()[0] or 0
    waves = max(1, min(WAVES, math.ceil(words / WAVE_WORDS)))
    tasks = max(1, math.ceil(words / waves / TASK_WORDS))

    def wave(k: int) -> DataFrame:
        mine = drawn.where(F.pmod(F.xxhash64(by, "sample_id"), F.lit(waves)) == k)
        # Draws are hashed, so segments are not sorted to meet them.
        met = mine.hint("shuffle_hash").join(segments.select("segment_id", *streams), "segment_id")
        placed = met.repartition(tasks, by, "sample_id").sortWithinPartitions(by, "sample_id", "draw")
        return joined_features(placed, [by, "sample_id"], "draw", ["edit_errors", "reference_words"], full)

    made = stored_parts(wave(k) for k in range(waves)).withColumnRenamed("reference_words", "ref_words")
    return made.withColumn("accuracy", accuracy("edit_errors", "ref_words")).drop("edit_errors")
