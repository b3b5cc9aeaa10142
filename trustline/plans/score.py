"""Scoring of new recordings, window by window, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip_unit
from ..operators.features import STANDARD, ctc_features
from ..operators.metrics import file_accuracy
from ..operators.segments import slice_ctc_by_time
from ..operators.windows import speech_in_window, word_windows
from .model import Predictor, predict


def scored_windows(recs: DataFrame, window: int = 256) -> DataFrame:
    """One row a window of words: its times, its frames (all frames if the slice has none), and how much of it is speech.

    recs have ``file`` and the final recognition's columns; one file is one row, so nothing is exchanged."""
    rows = word_windows(recs, window)
    cut = slice_ctc_by_time(rows.withColumn("__t", F.col("ctc_tokens")).withColumn("__p", F.col("ctc_probs")))
    none = F.size("ctc_tokens") == 0
    cut = cut.withColumns({"ctc_probs": F.when(none, F.col("__p")).otherwise(F.col("ctc_probs")), "ctc_tokens": F.when(none, F.col("__t")).otherwise(F.col("ctc_tokens"))}).drop("__t", "__p")
    length = F.size("ctc_tokens") * F.col("ctc_frame_len")
    timed = speech_in_window(cut.withColumn("__low", F.col("start_time")).withColumn("__high", F.col("start_time") + length), "__low", "__high")
    ratio = F.coalesce(clip_unit(F.try_divide(F.col("speech_seconds"), length)), F.lit(0.0))
    return timed.select("file", "window_idx", "start_word", "word_count", "start_time", "end_time", length.alias("audio_length"), ratio.alias("speech_ratio"), (1 - ratio).alias("non_speech_ratio"), "ctc_tokens", "ctc_probs", "ctc_frame_len")


def score_recordings(recs: DataFrame, predictor: Predictor, window: int = 256) -> DataFrame:
    """scored_windows with estimated_accuracy and expected_error_count."""
    features = ctc_features(scored_windows(recs, window), full=set(predictor.features) - set(STANDARD) != set(), keep_invalid=True)
    return predict(features, predictor).withColumn("expected_error_count", F.col("word_count") * (1 - F.col("estimated_accuracy")))


def accuracy_report(windows: DataFrame) -> DataFrame:
    """One record a file: its totals, and its windows in order as a list."""
    listed = windows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("window_idx", "start_time", "end_time", "word_count", "estimated_accuracy", "speech_ratio", "non_speech_ratio"))).alias("windows"))
    return file_accuracy(windows).join(listed, "file")
