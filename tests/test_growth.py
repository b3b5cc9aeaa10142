"""What keeps time, memory and disk in bounds when tables grow."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from trustline import lineage, queries
from trustline.operators import ensemble, features
from trustline.plans import score
from trustline.sources import files


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_make_recognitions_again(spark, sf_dir):
    plan = optimized(queries.QUERIES["final_recognition"](spark, sf_dir))
    # The event is looked for once, above the exchange; words and frames are made once.
    assert plan.count("filter(array(") == 1 and plan.count("split(") == 1
    below = plan[plan.index("RepartitionByExpression") :]
    assert "transform(" not in below and "filter(" not in below


def test_window_reports_of_many_files_are_few_text_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    windows = spark.range(900).selectExpr(
        "id div 3 AS file", "id % 3 AS window_idx", "0.0D AS start_time", "1.0D AS end_time", "1L AS word_count", "0.25D AS estimated_accuracy", "0.5D AS speech_ratio", "0.5D AS non_speech_ratio",
    )
    kind = score.accuracy_report(windows).schema
    for most, texts in ((10_000, 1), (100, 9)):
        monkeypatch.setattr(files, "PART_WINDOWS", most)
        files.write_window_reports(windows, path)
        assert 1 <= len(list((tmp_path / "r").rglob("*.txt"))) <= texts
        read = spark.read.schema(kind).json(path, multiLine=True).select("file", "words", "windows.window_idx").collect()
        assert sorted(map(tuple, read)) == [(k, 3, [0, 1, 2]) for k in range(300)]
    files.write_window_reports(windows.limit(0), path)
    assert spark.read.schema(kind).json(path, multiLine=True).count() == 0


def test_sample_features_equal_those_of_joined_frames(spark, monkeypatch):
    rng = np.random.default_rng(4)
    kinds = ["<blk>", "<blk>", "▁a", "b", "c d", None]
    made = []
    for i in range(400):
        n = int(rng.integers(1, 40))
        tokens = [kinds[k] for k in np.repeat(rng.integers(0, 6, n), rng.integers(1, 4, n))]
        probs = [float(x) for x in rng.random(len(tokens))]
        if i % 50 == 0:
            probs[0] = [None, float("nan"), float("inf")][i // 50 % 3]
        if i % 60 == 7:
            tokens, probs = [], []
        made.append((f"s{i:03d}", "train" if i % 3 else "test", float(rng.random()), 10 + i % 30, i % 7, tokens, probs, [0.04, 0.02, None][i % 3]))
    parts = spark.createDataFrame(made, "segment_id string, split string, accuracy double, reference_words bigint, edit_errors bigint, ctc_tokens array<string>, ctc_probs array<double>, ctc_frame_len double")
    keys = ["split", "sample_id", "accuracy", "ref_words"]
    for name, most in (("WAVE_WORDS", 5_000), ("TASK_WORDS", 1_000)):
        monkeypatch.setattr(ensemble, name, most)
    for full, names in ((False, features.STANDARD), (True, features.FULL)):
        whole = features.ctc_features(ensemble.ensemble_samples(parts, 150, 5, 64, 64), full=full).select(*keys, *names)
        got = ensemble.sample_features(features.flagged(parts), 150, 5, 64, 64, full=full).select(*keys, *names)
        a, b = (sorted(map(tuple, df.collect())) for df in (whole, got))
        assert len(a) > 100 and [r[:4] for r in a] == [r[:4] for r in b]
        assert np.allclose([r[4:] for r in a], [r[4:] for r in b], rtol=1e-9, atol=1e-12)


def test_what_a_part_exchanged_goes_when_it_is_written(spark):
    def shuffled():
        return sum(f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))

    before = shuffled()
    rows = lineage.stored_parts(spark.range(200_000).where(f"id % 3 = {k}").repartition(8, "id") for k in range(3))
    assert rows.count() == 200_000 and shuffled() - before < 100_000
    assert spark.conf.get(lineage.FREE) == "false"


def test_words_of_rows_equal_those_of_exploded_frames(spark, sf_dir):
    rng = np.random.default_rng(8)
    kinds = ["<blk>", "▁a", "b", "c d", None, ""]
    made = [(f"u{i}", [kinds[k] for k in rng.integers(0, 6, n)], [float(x) for x in rng.random(n)]) for i, n in enumerate(rng.integers(0, 30, 200))]
    df = spark.createDataFrame(made + [("b", ["<blk>"] * 3, [0.5] * 3)], "utt_id string, ctc_tokens array<string>, ctc_probs array<double>")
    want = features.collapse_tokens(features.explode_frames(df.withColumn("ctc_tokens", F.transform("ctc_tokens", lambda t: F.coalesce(t, F.lit("")))), "utt_id"), "utt_id")
    a, b = (sorted((r.utt_id, r.word, round(r.prob, 9)) for r in x.collect()) for x in (want, features.collapsed_words(df, "utt_id")))
    assert a == b and len(a) > 500
    plan = optimized(queries.QUERIES["collapse_tokens"](spark, sf_dir))
    assert "Window" not in plan and "Generate" not in plan


def test_windows_meet_their_segments_without_a_sort_of_frames(spark, sf_dir):
    plan = queries.QUERIES["window_streams"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    # Segments are read, not made again.
    assert "split(" not in optimized(queries.QUERIES["window_streams"](spark, sf_dir))
