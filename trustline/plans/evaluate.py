"""Evaluation on samples and on windows of long recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import stored
from ..operators.ensemble import sample_features
from ..operators.features import FULL, STANDARD, ctc_features, flagged
from ..operators.metrics import per_dataset_metrics, regression_metrics
from ..operators.segments import fixed_spans, segment_dataset, slice_utterance, with_alignment, with_tokens
from ..operators.windows import aggregate_windows, pack_windows, window_targets
from .model import Predictor, predict


def real_windows(recs: DataFrame, window: int, key: str = "group_id") -> DataFrame:
    """Segments of fixed spans with ``window_idx``, packed by key; frames stay with the segments.

    recs that have ``ref_to_hyp`` and tokens are aligned already."""
    aligned = recs if "ref_to_hyp" in recs.columns else with_alignment(with_tokens(recs))
    # Stored, else segments would be made three times: packing reads their sizes twice.
    segments = stored(slice_utterance(fixed_spans(aligned, window)).withColumn("chunk", F.col("ref_start")))
    # Only sizes are packed; frames meet the windows again by segment, and are not sorted for it.
    placed = pack_windows(segments.select(key, "utt_id", "chunk", "hypothesis_words", "segment_id"), key, window)
    return segments.join(placed.select("segment_id", "window_idx").hint("shuffle_hash"), "segment_id")


def window_streams(windows: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, window_idx, ctc_frame_len, ctc_tokens, ctc_probs): each window's frames end to end, by utterance and chunk."""
    frames = windows.groupBy(key, "window_idx").agg(F.array_sort(F.collect_list(F.struct("utt_id", "chunk", "ctc_tokens", "ctc_probs"))).alias("s"), F.max("ctc_frame_len").alias("ctc_frame_len"))
    return frames.select(key, "window_idx", "ctc_frame_len", F.flatten(F.transform("s", lambda s: s["ctc_tokens"])).alias("ctc_tokens"), F.flatten(F.transform("s", lambda s: s["ctc_probs"])).alias("ctc_probs"))


def window_estimates(windows: DataFrame, predictor: Predictor, key: str = "group_id") -> DataFrame:
    """(key, window_idx, estimated_accuracy); windows whose features fail have the estimate 0."""
    features = ctc_features(window_streams(windows, key), full=set(predictor.features) - set(STANDARD) != set(), keep_invalid=True)
    return predict(features, predictor).select(key, "window_idx", "estimated_accuracy")


def evaluate_windows(windows: DataFrame, estimates: DataFrame, key: str = "group_id") -> DataFrame:
    """Accuracy and estimate of every key from its windows and their estimates."""
    return aggregate_windows(window_targets(windows, key).join(estimates, [key, "window_idx"]), key)


def dataset_test_samples(recs: DataFrame, n: int, seed: int = 13, variants: DataFrame | None = None, min_words: int = 512, max_words: int = 512, min_segments: int = 2, segment_words: tuple[int, int] = (10, 256), full: bool = False) -> DataFrame:
    """Samples with features of each dataset's own test recordings, n a dataset: sample_id, dataset_idx, split, accuracy, ref_words.

    recs have split and dataset_idx; rows that are not of the test split or of no dataset are not read. All datasets are
    segmented, drawn and gathered in one job, keyed by dataset. ``variants`` (dataset_idx, variants) tells how often each
    dataset is segmented, once where it does not; a dataset without test segments has no samples."""
    most = (variants.agg(F.max("variants")).first()[0] or 1) if variants is not None else 1
    rows = recs.where((F.col("split") == "test") & F.col("dataset_idx").isNotNull())
    # Frames stay in this table, as bytes; pools are made of ids and counts.
    parts = segment_dataset(rows, seed, most, *segment_words)
    if variants is not None:
        told = variants.select(F.col("dataset_idx").alias("__of"), "variants")
        parts = parts.join(told, parts["dataset_idx"] == told["__of"], "left").where(F.col("variant") < F.coalesce("variants", F.lit(1))).drop("__of", "variants")
    samples = sample_features(stored(flagged(parts)), n, seed, min_words, max_words, min_segments, "dataset_idx", full)
    named = samples.withColumn("sample_id", F.concat_ws("_", F.lit("test"), F.col("dataset_idx").cast("string"), F.col("sample_id").cast("string"))).withColumn("split", F.lit("test"))
    return named.select("sample_id", "dataset_idx", "split", "accuracy", "ref_words", *(FULL if full else STANDARD))


def sample_metrics(predictions: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """(partition, dataset_idx, mae, mse, pearson_correlation, n_points) of samples by their split and dataset; every sample weighs alike.

    Of ``datasets`` (dataset_idx), those without test samples have errors of 0, no correlation and no points. Rows without a
    dataset count in no dataset."""
    found = regression_metrics(predictions.where("dataset_idx IS NOT NULL").withColumnRenamed("split", "partition"), ["partition", "dataset_idx"])
    if datasets is None:
        return found
    named = datasets.select("dataset_idx").where("dataset_idx IS NOT NULL").distinct().select(F.lit("test").alias("partition"), "dataset_idx")
    return named.join(found, ["partition", "dataset_idx"], "full").fillna(0.0, ["mae", "mse"]).fillna(0, ["n_points"]).select(found.columns)


def partition_names(name: str, levels: tuple[float, ...] = ()) -> list[str]:
    """``name`` for clean rows, ``name_snr`` for clean rows and all noise levels, ``name_snr_S`` for clean rows and level S."""
    return [name, f"{name}_snr", *(f"{name}_snr_{level_name(s)}" for s in levels)]


def level_name(level: float) -> str:
    return f"{level:g}"


def union_partitions(df: DataFrame, name: str, levels: tuple[float, ...] = ()) -> DataFrame:
    """df (with snr, null for clean rows) once for each partition that a row belongs to, with ``partition``."""
    clean, mixed, *each = partition_names(name, levels)
    noisy = F.filter(F.array(F.lit(mixed), *[F.when(F.col("snr") == s, F.lit(p)) for s, p in zip(levels, each)]), lambda p: p.isNotNull())
    known = F.when(F.col("snr").isNull(), F.array(*map(F.lit, (clean, mixed, *each)))).otherwise(noisy)
    return df.withColumn("partition", F.explode(known))


def evaluate_partitions(recs: DataFrame, predictor: Predictor, window: int = 512, levels: tuple[float, ...] = ()) -> DataFrame:
    """Predictions of real (by recording) and real_part (by utterance) and of their unions with noise levels.

    recs are the test rows, clean ones and, with ``snr`` and ids of their own, noisy ones. A recording's windows are the same
    in every partition, so each recording is sliced and scored once and its result is dealt to its partitions."""
    if "snr" not in recs.columns:
        recs = recs.withColumn("snr", F.lit(None).cast("double"))
    out = None
    for name, key in (("real", "group_id"), ("real_part", "utt_id")):
        # Sums and frames are both taken from the windows, so they are made once.
        windows = stored(real_windows(recs, window, key))
        names = recs.groupBy(key).agg(F.min("dataset_idx").alias("dataset_idx"), F.max("snr").alias("snr"))
        done = union_partitions(evaluate_windows(windows, window_estimates(windows, predictor, key), key).join(names, key), name, levels).withColumnRenamed(key, "sample_id").drop("snr")
        out = done if out is None else out.unionByName(done)
    return out


def partition_metrics(predictions: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Metrics of every partition over all datasets (dataset_idx null) and by dataset.

    Errors weigh by hypothesis words, but over all datasets those of single noise levels are plain means. ``expected``
    partitions without a row have errors of 0 and no correlation."""
    single = F.col("partition").rlike("_snr_[^_]*$")
    whole = predictions.withColumn("__w", F.when(single, F.lit(1.0)).otherwise(F.col("hyp_words").cast("double")))
    whole = regression_metrics(whole, ["partition"], "__w").withColumn("dataset_idx", F.lit(None).cast("int"))
    if expected:
        named = predictions.sparkSession.createDataFrame([(p,) for p in expected], "partition string")
        whole = named.join(whole, "partition", "full").fillna(0.0, ["mae", "mse"]).fillna(0, ["n_points"])
    return whole.unionByName(per_dataset_metrics(predictions).select(whole.columns))
