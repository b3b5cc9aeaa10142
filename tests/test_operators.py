"""Hand-made rows for every rule of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustline.functions import align, numbers, text
from trustline.operators import ensemble, features, manifest, metrics, noise, recognition, segments, splits, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_words(spark):
    df = spark.createDataFrame([("Don’t_stop, it's 5 o'clock!",), (None,), ("",), ("…",)], "t string")
    assert [r[0] for r in df.select(text.normalize_text("t")).collect()] == [["don’t", "stop", "it's", "5", "o'clock"], [], [], []]


def test_ids(spark):
    df = spark.createDataFrame([("12345_A_001_000123", None), ("12345_01_000123", ""), ("malach_1234_seg001", None), ("x", "bob"), ("123456", None)], "u string, s string")
    got = df.select(text.derive_speaker_id("u", "s"), text.derive_group_id("u")).collect()
    assert [tuple(r) for r in got] == [("12345", "12345_A_001"), ("12345", "12345_01"), ("01234", "malach_1234_seg001"), ("bob", "x"), (None, "123456")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[-1] + 1, last[j] + (x != y)))
    return row[-1]


def test_edits_and_alignment_agree_with_dynamic_programming(spark):
    rng = np.random.default_rng(5)
    pairs = [([str(x) for x in rng.integers(0, 6, rng.integers(0, 12))], [str(x) for x in rng.integers(0, 6, rng.integers(0, 12))]) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = dict(df.select("i", text.edit_errors("a", "b")).collect())
    for i, (a, b) in enumerate(pairs):
        assert got[i] == distance(a, b)
        at = align.align(a, b)
        assert list(at) == sorted(at) and all(0 <= x <= len(b) for x in at)
    assert list(align.align(["a", "b", "c"], ["a", "c"])) == [0, 1, 1]
    assert list(align.align(["a"], [])) == [0]


def test_long_alignment_is_split(monkeypatch):
    rng = np.random.default_rng(3)
    a = [str(x) for x in rng.integers(0, 9, 90)]
    b = [w for w in a if rng.random() > 0.2]
    monkeypatch.setattr(align, "MOST_CELLS", 200)
    at = align.align(a, b)
    kept = [i for i in range(len(a)) if at[i] < len(b) and a[i] == b[at[i]]]
    assert list(at) == sorted(at) and len(kept) >= len(b)


def test_spans():
    assert align.spans_of(9, 1, 10, 256) == []
    assert align.spans_of(10, 1, 10, 256) == [(0, 10)]
    for words in range(10, 400, 7):
        spans = align.spans_of(words, words, 10, 40)
        assert all(10 <= b - a <= 40 for a, b in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert words - spans[-1][1] < 10


def test_manifest_rejects(spark):
    data = [(1, "a", "p1", " "), (2, "a", "p1", "x"), (3, "a", "p1", "y"), (4, "b", None, "x"), (5, "c", "gone", "x")]
    df = spark.createDataFrame(data, "input_order int, utt_id string, audio_path string, reference string").withColumn("named_by_file", F.lit(False))
    files = spark.createDataFrame([("p1",)], "audio_path string")
    told = rows(manifest.rejected_manifest(df, files).select("input_order", "reason"), "input_order")
    assert told == [(1, "blank_reference"), (2, None), (3, "duplicate_utt_id"), (4, "missing_audio_path"), (5, "audio_not_present")]
    assert manifest.validate_manifest(df, files, skip_bad_rows=True).count() == 1
    with pytest.raises(Exception, match="bad manifest row"):
        manifest.validate_manifest(df, files).collect()
    with pytest.raises(ValueError):
        manifest.validate_manifest(df.where("input_order = 1"), files, skip_bad_rows=True)


def test_recognition_rejects(spark):
    kind = "utt_id string, result array<struct<type:string,partial_result:boolean,ctc_tokens:array<string>,ctc_probs:array<double>,ctc_frame_len:double,audio_duration:double,word_array:array<string>,word_times:array<array<double>>>>"
    frames = lambda n: (["a"] * n, [0.5] * n)
    good = ("asr_result", None, *frames(98), 0.04, 4.0, ["w"], [[0.0, 1.0]])
    cases = {
        "good": [good], "warn": [("asr_result", False, *frames(97), 0.04, 4.0, ["w"], [[0.0, 1.0]])], "none": None, "partial": [("asr_result", True, *good[2:])],
        "lengths": [("asr_result", None, ["a"] * 3, [0.1] * 2, *good[4:])], "words": [(*good[:6], ["a", "b"], [[0.0, 1.0]])], "no_words": [(*good[:6], None, None)],
    }
    got = {r[0]: (r[1], r[2]) for r in recognition.validate_recognition(spark.createDataFrame(list(cases.items()), kind)).select("utt_id", "reason", "frame_warning").collect()}
    assert got == {
        "good": (None, False), "warn": (None, True), "none": ("result_not_a_list", False), "partial": ("no_final_result", False), "lengths": ("ctc_lengths_differ", False),
        "words": ("word_lengths_differ", False), "no_words": ("words_missing", False),
    }


def test_attach_fails_on_missing(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "utt_id string"), spark.createDataFrame([("x", 1)], "utt_id string, n int")
    assert recognition.attach_recognition(a, b, "drop").count() == 1
    with pytest.raises(Exception, match="no recognition"):
        recognition.attach_recognition(a, b).collect()


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(500).select(F.concat(F.lit("u"), "id").alias("utt_id"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("speaker_id"))
    out = splits.speaker_split(df)
    splits.assert_disjoint(out)
    assert out.count() == 490
    assert dict(splits.split_groups(out).groupBy("split").count().collect()) == {"train": 39, "test": 10}
    with pytest.raises(Exception, match="no speaker"):
        splits.speaker_split(df, on_missing="fail").collect()
    with pytest.raises(Exception, match="two keys"):
        splits.speaker_split(df.where("speaker_id = 's1'")).collect()


def test_slice_has_exactly_the_centres_inside(spark):
    df = spark.createDataFrame([(i / 37, i / 37 + 0.3) for i in range(60)], "start_time double, end_time double")
    df = df.withColumn("ctc_tokens", F.array(*[F.lit(str(i)) for i in range(40)])).withColumn("ctc_probs", F.array(*[F.lit(float(i)) for i in range(40)])).withColumn("ctc_frame_len", F.lit(0.04))
    for r in segments.slice_ctc_by_time(df).collect():
        assert r.ctc_probs == [float(i) for i in range(40) if r.start_time <= (i + 0.5) * 0.04 < r.end_time]


def test_deciles(spark):
    for m in (3, 10, 37, 118):
        df = spark.range(m).select(F.col("id").cast("string").alias("segment_id"), (F.col("id") % 7 / 7.0).alias("accuracy"), F.lit("train").alias("split"))
        got = sorted((r["rank"], r["decile"]) for r in ensemble.accuracy_deciles(df).collect())
        pools = [p for p in (list(range(k * m // 10, (k + 1) * m // 10)) for k in range(10)) if p]
        assert got == [(r, k) for k, p in enumerate(pools) for r in p]


def test_features_agree(spark, sf_dir):
    from trustline.plans import fixtures

    recs = fixtures.recognitions(spark, sf_dir).limit(30)
    odd = spark.createDataFrame([("allblank", ["<blk>"] * 3, [0.5] * 3), ("nonblank", ["a", "b"], [0.5, 0.6]), ("null", [None, "<blk>"], [0.5, 0.9]), ("late", ["<blk>", "x", "▁y"], [0.2, 0.3, 0.4])], "utt_id string, ctc_tokens array<string>, ctc_probs array<double>")
    both = recs.select("utt_id", "ctc_tokens", "ctc_probs").unionByName(odd)
    a = {r.utt_id: r for r in features.ctc_features_sql(both, "utt_id", full=True).collect()}
    b = {r.utt_id: r for r in features.ctc_features(both, 0.04, full=True).collect()}
    assert set(a) == set(b) and {"null", "late"} <= set(a) and not {"allblank", "nonblank"} & set(a)
    for k in a:
        for name in features.FULL:
            assert math.isclose(a[k][name], b[k][name], rel_tol=1e-9, abs_tol=1e-9), (k, name)
    assert len(features.FULL) == 69 and len(features.STANDARD) == 25


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 5.0, 4.0), ("b", 3.0, 9.0), ("c", 20.0, 21.0)], "k string, s double, e double").withColumns({"low": F.lit(0.0), "high": F.lit(4.0)})
    assert rows(windows.merge_intervals(df, "k"), "k") == [("a", 2.0, 0.5), ("b", 1.0, 0.25), ("c", 0.0, 0.0)]


def test_packing_of_windows(spark):
    df = spark.createDataFrame([("g", f"u{i}", 0, n) for i, n in enumerate([30, 40, 70, 5])] + [("h", "u", 0, 9)], "key string, utt_id string, chunk int, hypothesis_words int")
    assert [(r.utt_id, r.window_idx) for r in windows.pack_windows(df, "key", 64).orderBy("utt_id").collect()] == [("u0", 0), ("u1", 0), ("u2", 1)]


def test_correlation_guards(spark):
    df = spark.createDataFrame([("one", 0.5, 0.5), ("flat", 0.5, 0.1), ("flat", 0.5, 0.9), ("line", 0.1, 0.2), ("line", 0.3, 0.4), ("line", 0.5, 0.6)], "k string, accuracy double, estimated_accuracy double")
    got = {r.k: r for r in metrics.regression_metrics(df, ["k"]).collect()}
    assert got["one"].pearson_correlation is None and got["flat"].pearson_correlation is None and math.isclose(got["line"].pearson_correlation, 1.0)
    assert math.isclose(got["line"].mae, 0.1)


def test_percentile(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],), ([],)], "v array<double>")
    assert [tuple(r) for r in df.select(*[numbers.nearest_rank("v", q) for q in (0, 25, 26, 100)]).collect()] == [(1.0, 1.0, 2.0, 4.0), (None,) * 4]


def test_noise_level():
    signal = (np.sin(np.arange(20000) / 7) * 8000).astype("<i2")
    out = np.frombuffer(noise.noisy(signal.tobytes(), 10.0, "u"), "<i2").astype(float)
    snr = 10 * np.log10((signal.astype(float) ** 2).mean() / ((out - signal) ** 2).mean())
    assert abs(snr - 10) < 0.3
    assert noise.noisy(b"", 10.0, "u") == b""


def test_same_result_for_any_partitioning(spark, sf_dir):
    from trustline import queries

    got = []
    for n in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, queries.QUERIES["draw_until_target"](spark, sf_dir).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_packing_over_ranges_equals_a_fold(spark):
    import random

    from trustline.operators import windows

    rng = random.Random(3)
    sizes = {"a": [rng.choice([0, 1, 5, 30, 63, 64, 200]) for _ in range(400)], "b": [70], "c": [3, 4], "d": [rng.randrange(20) for _ in range(37)], "e": [0, 0], "f": [64, 9]}
    want = {}
    for key, hs in sizes.items():
        w = n = 0
        rows = []
        for i, h in enumerate(hs):
            rows.append((i, w))
            n += h
            if n >= 64:
                w, n = w + 1, 0
        want |= {(key, i): x for i, x in rows if x < w or n >= 10}
    rows = [(k, f"u{i:04d}", i, h) for k, hs in sizes.items() for i, h in enumerate(hs)] + [(None, "u", 0, 99)]
    df = spark.createDataFrame(rows, "k string, utt_id string, chunk int, hypothesis_words int")
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {(r.k, r.chunk): r.window_idx for r in windows.pack_windows(df, "k", 64).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == want
    assert windows.pack_windows(df.limit(0), "k", 64).count() == 0


def test_edits_of_more_words_than_one_plane_has(spark):
    from trustline.functions import text

    words = [f"w{i}" for i in range(45_000)]
    df = spark.createDataFrame([(words, [*words[:5], "x", *words[6:9]]), (["a", "b"], ["b"]), (None, ["b"])], "r array<string>, h array<string>")
    assert [r[0] for r in df.select(text.edit_errors("r", "h")).collect()] == [45_000 - 9 + 1, 1, 1]


def test_partitions_of_levels(spark):
    from trustline.plans import evaluate

    df = spark.createDataFrame([("c", None), ("n5", 5.0), ("n2", 2.5), ("n9", 9.0)], "sample_id string, snr double")
    got = sorted((r.partition, r.sample_id) for r in evaluate.union_partitions(df, "real", (5.0, 2.5)).collect())
    assert got == [("real", "c"), ("real_snr", "c"), ("real_snr", "n2"), ("real_snr", "n5"), ("real_snr", "n9"), ("real_snr_2.5", "c"), ("real_snr_2.5", "n2"), ("real_snr_5", "c"), ("real_snr_5", "n5")]
    assert evaluate.partition_names("real", (5.0,)) == ["real", "real_snr", "real_snr_5"]


def test_evaluation_with_noise_levels(spark, sf_dir):
    from trustline.operators import manifest, splits
    from trustline.operators.features import STANDARD
    from trustline.plans import evaluate, fixtures, model

    recs = splits.speaker_split(manifest.with_ids(fixtures.recognitions(spark, sf_dir))).where("split = 'test'")
    noisy = manifest.expand_snr(recs, [5.0])
    rows = spark.range(60).selectExpr("concat('s', id) AS sample_id", "'train' AS split", "100L AS ref_words", "id / 60.0D AS accuracy", *[f"(id * {i + 1} % 50) / 50.0D AS {n}" for i, n in enumerate(STANDARD)])
    p = model.train(rows, STANDARD, grid=[{"step": 0.1, "leaves": 4, "least_rows": 2, "l2": 0.0}], rounds=2)
    out = evaluate.evaluate_partitions(noisy, p, 128, (5.0,)).groupBy("partition").count().collect()
    n = {r.partition: r["count"] for r in out}
    assert n["real_snr"] == n["real_snr_5"] == 2 * n["real"] > 0 and n["real_part_snr"] == 2 * n["real_part"] > 0
    held = model.validation_predictions(rows, p).collect()
    assert 0 < len(held) < 30 and all(r.split == "validation" and abs(r.residual - r.accuracy + r.estimated_accuracy) < 1e-12 for r in held)


@pytest.mark.parametrize("cells", [0, 60])
def test_long_alignments_are_those_of_the_whole_table(monkeypatch, cells):
    rng = np.random.default_rng(8)
    for _ in range(300):
        ref, hyp = (rng.choice(list("abcd"), rng.integers(0, 40)).tolist() for _ in range(2))
        whole = align.align(ref, hyp).tolist()
        with monkeypatch.context() as m:
            m.setattr(align, "MOST_CELLS", cells)
            assert align.align(ref, hyp).tolist() == whole
    ref = rng.choice(5000, 6000).astype(str).tolist()
    hyp = [w for w in ref if rng.random() > 0.1]
    got = align.align(ref, hyp)
    assert (np.diff(got) >= 0).all() and sum(j < len(hyp) and hyp[j] == w for w, j in zip(ref, got)) >= len(hyp)
