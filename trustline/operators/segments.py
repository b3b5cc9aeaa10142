"""Word-aligned segments: reference spans, their times, their frames, and what they score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import align_words, random_spans_of
from ..functions.text import accuracy, edit_errors, normalize_text, seed_hash

BLANK = "<blk>"


def fixed_spans(df: DataFrame, window: int, words: str = "ref_tokens") -> DataFrame:
    """df with ``spans``: [0, w), [w, 2w), ...; the last is shorter. No words, no spans."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(window))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("spans", F.transform(starts, lambda s: F.struct(s.alias("ref_start"), F.least(s + window, n).alias("ref_end"))))


def random_spans(df: DataFrame, seed: int = 13, variants: int = 1, min_words: int = 10, max_words: int = 256, words: str = "ref_tokens") -> DataFrame:
    """df once a variant, with ``variant`` and ``spans`` of random lengths; the draw depends on utterance, variant and seed only."""
    out = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    return out.withColumn("spans", random_spans_of(F.size(words), seed_hash("utt_id", seed, F.col("variant")), min_words, max_words))


def with_tokens(recs: DataFrame) -> DataFrame:
    """recs with ref_tokens, hyp_tokens and hyp_at, the recogniser's word that each hypothesis token comes from."""
    split = F.flatten(F.transform("word_array", lambda w, i: F.transform(normalize_text(w), lambda t: F.struct(t.alias("t"), i.alias("i")))))
    out = recs.withColumn("ref_tokens", normalize_text("reference")).withColumn("__h", F.coalesce(split, F.array().cast("array<struct<t:string,i:int>>")))
    return out.withColumn("hyp_tokens", F.transform("__h", lambda h: h["t"])).withColumn("hyp_at", F.transform("__h", lambda h: h["i"])).drop("__h")


def with_alignment(df: DataFrame) -> DataFrame:
    """df with ``ref_to_hyp`` from ref_tokens and hyp_tokens.

    Spark does not take a Python function whose arguments hold lambdas, which inlining would give it. Arguments that are not
    deterministic are not inlined, so they are made with a random number that has no say."""
    apart = lambda c: F.when(F.monotonically_increasing_id() >= 0, F.col(c))
    rows = df.withColumns({"__ref": apart("ref_tokens"), "__hyp": apart("hyp_tokens")})
    return rows.withColumn("ref_to_hyp", align_words("__ref", "__hyp")).drop("__ref", "__hyp")


def frames_before(t: Column, frame_len: Column, n_frames: Column) -> Column:
    """Number of frames whose centre is before t: an index from the frame length, then the exact test around it."""
    base = F.greatest(F.lit(0), F.floor(t / frame_len - 0.5).cast("int") - 1)
    near = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: (base + k + 0.5) * frame_len < t)
    return F.least(n_frames, base + F.size(near))


def slice_ctc_by_time(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """df with ctc_tokens and ctc_probs cut to the frames whose centre lies in [start, end), and first_frame."""
    n, length = F.size("ctc_tokens"), F.col("ctc_frame_len")
    out = df.withColumn("first_frame", frames_before(F.col(start), length, n)).withColumn("__end", frames_before(F.col(end), length, n))
    size = F.greatest(F.lit(0), F.col("__end") - F.col("first_frame"))
    return out.withColumns({c: F.slice(c, F.col("first_frame") + 1, size) for c in ("ctc_tokens", "ctc_probs")}).drop("__end")


def span_to_time(df: DataFrame) -> DataFrame:
    """Rows (ref_start, ref_end) with hyp_start, hyp_end, hyp_stop, start_time and end_time.

    Needs ref_to_hyp, hyp_at and word_times. hyp_stop is one past the last aligned word before clamping to the words there are."""
    mapped = F.slice("ref_to_hyp", F.col("ref_start") + 1, F.col("ref_end") - F.col("ref_start"))
    n = F.size("hyp_at")
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, n - 1))
    out = df.withColumn("__m", mapped).where((F.size("__m") > 0) & (n > 0))
    out = out.withColumn("hyp_start", clamp(F.array_min("__m"))).withColumn("hyp_stop", F.array_max("__m") + 1).withColumn("hyp_end", clamp(F.array_max("__m")))
    time = lambda at, k: F.get(F.get(F.col("word_times"), F.get(F.col("hyp_at"), F.col(at))), F.lit(k))
    return out.drop("__m").withColumn("start_time", time("hyp_start", 0)).withColumn("end_time", time("hyp_end", 1))


def slice_utterance(recs: DataFrame, max_frames_per_word: int = 80, keep_ctc: bool = True) -> DataFrame:
    """Segments of recs with ``spans``, one row each, that pass the guards.

    A segment goes if it has no frame, over ``max_frames_per_word`` frames a reference word, no blank or nothing but blanks.
    Needs with_tokens(); utterances are aligned once, however many spans or variants they have, if ``ref_to_hyp`` is there."""
    if "ref_to_hyp" not in recs.columns:
        recs = with_alignment(recs)
    rows = recs.withColumn("__s", F.explode("spans")).withColumns({"ref_start": F.col("__s.ref_start"), "ref_end": F.col("__s.ref_end")}).drop("__s", "spans")
    cut = slice_ctc_by_time(span_to_time(rows.where((F.size("ref_tokens") > 0) & (F.size("hyp_tokens") > 0))))
    n, words = F.size("ctc_tokens"), F.col("ref_end") - F.col("ref_start")
    blanks = F.size(F.filter("ctc_tokens", lambda t: t == BLANK))
    kept = cut.where((n > 0) & (n <= max_frames_per_word * words) & (blanks > 0) & (blanks < n))
    ref = F.slice("ref_tokens", F.col("ref_start") + 1, words)
    hyp = F.slice("hyp_tokens", F.col("hyp_start") + 1, F.greatest(F.lit(0), F.least(F.col("hyp_stop"), F.size("hyp_tokens")) - F.col("hyp_start")))
    done = kept.withColumn("reference_words", F.size(ref).cast("bigint")).withColumn("hypothesis_words", F.size(hyp).cast("bigint")).withColumn("edit_errors", edit_errors(ref, hyp))
    done = done.withColumn("accuracy", accuracy("edit_errors", "reference_words"))
    variant = F.col("variant") if "variant" in done.columns else F.lit(0)
    done = done.withColumn("segment_id", F.concat_ws("_", "utt_id", variant.cast("string"), F.col("ref_start").cast("string"), F.col("ref_end").cast("string")))
    carried = [c for c in ("speaker_id", "group_id", "split", "dataset_idx", "variant", "partition") if c in done.columns]
    ctc = ["ctc_tokens", "ctc_probs", "ctc_frame_len"] if keep_ctc else []
    return done.select("segment_id", "utt_id", *carried, "ref_start", "ref_end", "reference_words", "hypothesis_words", "edit_errors", "accuracy", "start_time", "end_time", *ctc)


def segment_dataset(recs: DataFrame, seed: int = 13, variants: int = 1, min_words: int = 10, max_words: int = 256, keep_ctc: bool = True) -> DataFrame:
    """Segments of all utterances for all variants; alignment comes before variants multiply the rows."""
    aligned = with_alignment(with_tokens(recs))
    return slice_utterance(random_spans(aligned, seed, variants, min_words, max_words), keep_ctc=keep_ctc)


def segment_counts(segments: DataFrame) -> DataFrame:
    """(dataset_idx, train, test, total)."""
    count = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(s)
    return segments.groupBy("dataset_idx").agg(count("train"), count("test"), F.count("*").alias("total"))


def estimate_variants(segments: DataFrame, target: int = 8000) -> DataFrame:
    """(dataset_idx, variants): passes needed for ``target`` segments, from the segments of one pass; none without segments."""
    return segments.groupBy("dataset_idx").agg(F.greatest(F.lit(1), F.ceil(F.lit(target) / F.count("*"))).cast("bigint").alias("variants"))
