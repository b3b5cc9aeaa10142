"""Word errors and accuracies of utterances, and how well estimates follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip_unit, pearson
from ..functions.text import accuracy, edit_errors, normalize_text


def utterance_metrics(recs: DataFrame) -> DataFrame:
    """Words, fewest word edits and accuracy of each utterance with a reference word; by row, without an exchange."""
    hyp = normalize_text(F.array_join("word_array", " "))
    rows = recs.withColumn("__r", normalize_text("reference")).withColumn("__h", hyp).where(F.size("__r") > 0)
    rows = rows.withColumn("reference_words", F.size("__r").cast("bigint")).withColumn("hypothesis_words", F.size("__h").cast("bigint")).withColumn("edit_errors", edit_errors("__r", "__h"))
    kept = [c for c in ("utt_id", "speaker_id", "group_id", "audio_path", "dataset_idx", "split", "snr") if c in recs.columns]
    return rows.select(*kept, "reference_words", "hypothesis_words", "edit_errors").withColumn("accuracy", accuracy("edit_errors", "reference_words"))


def keep_measured_rows(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    return rows.join(metrics.select("utt_id"), "utt_id", "left_semi")


def overall_accuracy(metrics: DataFrame, by: list[str]) -> DataFrame:
    """by, accuracy (0 without words), n_utterances."""
    a = F.coalesce(accuracy(F.sum("edit_errors"), F.nullif(F.sum("reference_words"), F.lit(0))), F.lit(0.0))
    return metrics.groupBy(*by).agg(a.alias("accuracy"), F.count("*").alias("n_utterances"))


def _metric_columns(weight: str | None) -> list[Column]:
    e = F.col("estimated_accuracy") - F.col("accuracy")
    if weight is None:
        errors = [F.avg(F.abs(e)), F.avg(e * e)]
    else:
        w = F.col(weight)
        errors = [F.coalesce(F.try_divide(F.sum(w * x), F.sum(w)), F.lit(0.0)) for x in (F.abs(e), e * e)]
    return [errors[0].alias("mae"), errors[1].alias("mse"), pearson("accuracy", "estimated_accuracy").alias("pearson_correlation"), F.count("*").alias("n_points")]


def regression_metrics(predictions: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by, mae, mse, pearson_correlation (null where undefined), n_points; errors weighted by ``weight``, correlation not."""
    return predictions.groupBy(*by).agg(*_metric_columns(weight))


def per_dataset_metrics(predictions: DataFrame, weighted: tuple[str, ...] = ("real",)) -> DataFrame:
    """Metrics by partition and dataset; partitions whose name begins with one of ``weighted`` weigh by hypothesis words."""
    w = F.lit(False)
    for prefix in weighted:
        w = w | F.col("partition").startswith(prefix)
    rows = predictions.withColumn("__w", F.when(w, F.col("hyp_words").cast("double")).otherwise(F.lit(1.0)))
    return rows.groupBy("partition", "dataset_idx").agg(*_metric_columns("__w"))


def assign_dataset(predictions: DataFrame, rows: DataFrame) -> DataFrame:
    """predictions with dataset_idx: the id less its last ``_w...`` and then its last ``_snr...``, as a group's or an utterance's."""
    base = F.regexp_replace(F.regexp_replace("sample_id", r"^(.*)_w.*$", "$1"), r"^(.*)_snr.*$", "$1")
    known = (
        rows.select(F.col("group_id").alias("__base"), "dataset_idx").unionByName(rows.select(F.col("utt_id").alias("__base"), "dataset_idx"))
        .where("__base IS NOT NULL").groupBy("__base").agg(F.min("dataset_idx").alias("dataset_idx"))
    )
    return predictions.drop("dataset_idx").withColumn("__base", base).join(known, "__base", "left").drop("__base")


def file_accuracy(windows: DataFrame, key: str = "file") -> DataFrame:
    """(key, words, expected_errors, estimated_accuracy): one less expected errors a word; null without words."""
    sums = windows.groupBy(key).agg(F.sum("word_count").cast("bigint").alias("words"), F.sum(F.col("word_count") * (1 - F.col("estimated_accuracy"))).alias("expected_errors"))
    return sums.withColumn("estimated_accuracy", clip_unit(1 - F.try_divide(F.col("expected_errors"), F.nullif(F.col("words"), F.lit(0)))))


def fit_affine(predictions: DataFrame, raw: str = "raw", target: str = "accuracy") -> DataFrame:
    """(a, b) of the least-squares line target = a + b raw; b = 0 and a the mean where raw is constant."""
    x, y = F.col(raw), F.col(target)
    b = F.coalesce(F.when(F.min(x) != F.max(x), F.try_divide(F.covar_pop(x, y), F.var_pop(x))), F.lit(0.0))
    return predictions.agg(b.alias("b"), F.avg(x).alias("__x"), F.avg(y).alias("__y")).select((F.col("__y") - F.col("b") * F.col("__x")).alias("a"), "b")


def is_validation(sample_id: str | Column = "sample_id", seed: int = 13, share: float = 0.2) -> Column:
    """Whether a sample is for validation: by its hash, so that partitioning has no say."""
    from ..functions.text import uniform

    return uniform(F.lit(seed), F.col(sample_id) if isinstance(sample_id, str) else sample_id) < share
