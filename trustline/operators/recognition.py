"""Recognition documents: the final event, validation, joining to rows, and accuracy events of the server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def final_event(result: str = "result") -> Column:
    """The first event of type asr_result that is not partial; null without one."""
    return F.get(F.filter(result, lambda e: (e["type"] == "asr_result") & ~F.coalesce(e["partial_result"], F.lit(False))), F.lit(0))


def final_recognition(df: DataFrame) -> DataFrame:
    """df with ``final`` and without ``result``.

    A filter on the final event does not go below what is not deterministic, where it would find the event once more."""
    return df.withColumn("final", F.when(F.monotonically_increasing_id() >= 0, final_event())).drop("result")


def validate_recognition(df: DataFrame) -> DataFrame:
    """df with ``reason`` (null for a usable document) and ``frame_warning``.

    The warning says that the duration gives over two frames more or fewer than there are; half frames round to even."""
    out = df.withColumn("__f", final_event())
    f = F.col("__f")
    reason = (
        F.when(F.col("result").isNull(), "result_not_a_list")
        .when(f.isNull(), "no_final_result")
        .when(f["ctc_tokens"].isNull() | f["ctc_probs"].isNull(), "ctc_missing")
        .when(F.size(f["ctc_tokens"]) != F.size(f["ctc_probs"]), "ctc_lengths_differ")
        .when(f["word_array"].isNull() | f["word_times"].isNull(), "words_missing")
        .when(F.size(f["word_array"]) != F.size(f["word_times"]), "word_lengths_differ")
    )
    frames = F.bround(F.try_divide(f["audio_duration"], f["ctc_frame_len"]), 0)
    warning = reason.isNull() & F.coalesce(F.abs(frames - F.size(f["ctc_tokens"])) > 2, F.lit(False))
    return out.withColumn("reason", reason).withColumn("frame_warning", warning).drop("__f")


def attach_recognition(rows: DataFrame, recs: DataFrame, on_missing: str = "fail") -> DataFrame:
    """rows with their recognition's columns, by utt_id; a row without one raises an error, or goes with ``on_missing="drop"``."""
    clash = [c for c in recs.columns if c in rows.columns and c != "utt_id"]
    recs = recs.drop(*clash)
    if on_missing == "drop":
        return rows.join(recs, "utt_id")
    joined = rows.join(recs.withColumn("__there", F.lit(True)), "utt_id", "left")
    check = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no recognition for "), F.col("utt_id"))).cast("boolean"))
    return joined.where(check).drop("__there")


def valid_recognitions(docs: DataFrame, order: str = "batch") -> DataFrame:
    """Of each utterance's stored documents the last usable one in ``order``; a batch that was stored twice counts once.

    Which document it is follows from ids alone, so only the documents that stay are exchanged."""
    usable = validate_recognition(docs).where("reason IS NULL AND utt_id IS NOT NULL").drop("reason", "frame_warning")
    last = usable.groupBy("utt_id").agg(F.max(order).alias(order))
    return usable.join(last, ["utt_id", order], "left_semi").dropDuplicates(["utt_id"])


def pending_recognitions(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that are still to be recognised: those without a usable document among the stored ones.

    Documents that are no list of events, lack a final one or have arrays missing or of different lengths do not count, so
    their utterances are recognised again."""
    usable = validate_recognition(docs.select("utt_id", "result")).where("reason IS NULL").select("utt_id")
    return rows.join(usable, "utt_id", "left_anti")


# The fields of a server's accuracy event.
SERVER_METRICS = ("estimated_accuracy", "words_per_minute", "audio_length", "speech_ratio", "non_speech_ratio", "recognized_word_count", "expected_error_count")


def merge_server_accuracy(windows: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("file", "window_idx"), order: str = "event_pos") -> DataFrame:
    """windows with each metric overwritten by the server's value where that is not null; of several events the last wins."""
    metrics = [m for m in SERVER_METRICS if m in windows.columns and m in events.columns]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*metrics), F.col(order)).alias("__server"))
    joined = windows.join(last, list(keys), "left")
    return joined.withColumns({m: F.coalesce(F.col(f"__server.{m}"), F.col(m)) for m in metrics}).drop("__server")


def server_events(docs: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(events of windows, events of whole files) that documents hold in ``result``, with ``event_pos``.

    An event with a window_idx is of that window; one without is of the file if it is said not to be partial, else it goes."""
    told = docs.select(key, F.posexplode(F.filter("result", lambda e: e["type"] == "asr_accuracy_estimate")).alias("event_pos", "e"))
    whole = (F.col("e.partial_result") == False) & F.col("e.window_idx").isNull()  # noqa: E712
    of_files = told.where(whole).select(key, "event_pos", *[F.col(f"e.{m}").alias(m) for m in SERVER_METRICS])
    of_windows = told.where("e.window_idx IS NOT NULL").select(key, "event_pos", F.col("e.window_idx").alias("window_idx"), *[F.col(f"e.{m}").alias(m) for m in SERVER_METRICS])
    return of_windows, of_files


def with_server_accuracy(files: DataFrame, windows: DataFrame, docs: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(files, windows) with their metrics overwritten by those of the server's events in ``docs``."""
    of_windows, of_files = server_events(docs, key)
    return merge_server_accuracy(files, of_files, (key,)), merge_server_accuracy(windows, of_windows, (key, "window_idx"))
