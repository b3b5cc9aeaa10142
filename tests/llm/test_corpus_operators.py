"""Duplicates, fingerprints, shards and sequences, against brute force."""

import collections
import functools
import hashlib
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustline.llm import cap_filters, components, dart_minhash, language_id, packing, queries, sharding, sketches, toxicity
from trustline.llm.common import shingle_hashes, table, text_bytes


def shingles(text):
    w = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (collections.Counter([tuple(w)]) if w else collections.Counter())


def likeness(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (60, 61), (61, 60), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {60: 60, 61: 60}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    rng = random.Random(2)
    for n in (24,):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)]
        labels = components.joined(components.components(spark.createDataFrame(edges[: n // 2], "a bigint, b bigint")), spark.createDataFrame(edges[n // 2 :], "a bigint, b bigint"))
        want = groups(30, edges)
        got = dict(labels.collect())
        assert all(got[a] == want[a] for a, b in edges for a in (a, b) if a in got) and all(a in got for e in edges if e[0] != e[1] for a in e)


def test_darts_estimate_weighted_likeness():
    base = [f"w{i}" for i in range(300)]
    other = [w if i % 30 else "z" for i, w in enumerate(base)] + ["a b c d e f"] * 12
    hashes, starts = shingle_hashes(*text_bytes(pa.array([" ".join(base), " ".join(other), "", "one", "one"])))
    s = dart_minhash.signatures(hashes, starts)
    assert abs((s[0] == s[1]).mean() - likeness(shingles(" ".join(base)), shingles(" ".join(other)))) < 0.12
    assert (s[2] == 0).all() and (s[3] == s[4]).all() and (s[[0, 1, 3]] != 0).all()


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(25):
        base = list(rng.choice(words, rng.integers(30, 200)))
        for c in range(int(rng.integers(1, 6))):
            copy = list(base)
            for _ in range(c * len(base) // 60):
                copy[rng.integers(0, len(copy))] = f"x{rng.integers(0, 999)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0], "few words", "few words", "", None, " \n "]
    bags = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if likeness(bags[a], bags[b]) >= 0.8]
    want = groups(len(texts), links)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, component_id string").repartition(5)
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_of_odd_rows(odd, nothing):
    out = dart_minhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert by[100].component_id == 3 and not by[100].kept and by[3].kept
    assert by[0].kept and by[1].kept and by[2].kept and by[0].text_class is None
    assert dart_minhash.near_duplicates(nothing).count() == 0


def test_one_text_of_a_group_is_kept_whatever_its_ids(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, long), (None, long + " more"), (None, "alone here"), (7, "a b c"), (7, "a b c"), (8, long.replace("w9 ", "v ")), (9, None), (8, long + " again")]
    out = dart_minhash.near_duplicates(spark.createDataFrame(rows[:3] + rows[3:5] + rows[6:7], "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.kept) for r in out) == [("7", True), ("7", True), ("9", True), ("None", False), ("None", True), ("None", True)]
    out = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.kept for r in out if r.doc_id == 8].count(True) == 1 and {r.component_id for r in out if r.doc_id in (None, 8)} == {8, None}


@pytest.mark.parametrize("share", [0.77, 0.795])
def test_planted_pairs_among_pages_of_a_template(spark, share):
    # Pages that are a little less than 0.8 alike fill the buckets that the planted pairs, 0.82 alike, share.
    rng, n = np.random.default_rng(5), 300
    common = int(n * 2 * share / (1 + share))
    template = [f"t{i}" for i in range(common)]
    page = lambda k: template + [f"p{k}_{i}" for i in range(n - common)]
    pages = [page(k) for k in range(400)]
    pairs = []
    for k in range(60):
        left = page(f"a{k}")
        right = list(left)
        for i in rng.choice(np.arange(2, 298, 5), 6, replace=False):
            right[i] = f"q{k}_{i}"
        pairs.append((left, right))
    texts = [" ".join(p) for p in pages] + [" ".join(t) for p in pairs for t in p]
    got = {r.doc_id: r.component_id for r in dart_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert likeness(shingles(texts[400]), shingles(texts[401])) >= 0.8 > likeness(shingles(texts[0]), shingles(texts[1]))
    assert [(got[400 + 2 * k] == 400 + 2 * k, got[401 + 2 * k] == 400 + 2 * k) for k in range(60)] == [(True, True)] * 60


def test_hub_links_copies_that_are_not_like_each_other(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(260)]
    texts = [" ".join(base)]
    for c in range(120):
        copy = list(base)
        for i in rng.choice(52, 4, replace=False):
            copy[i * 5 + 2] = f"y{c}_{i}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(500 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.component_id for r in dart_minhash.near_duplicates(df).collect()} == {380}


@pytest.mark.parametrize("block_rows", [2048, 100])
def test_family_without_its_hub_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(dart_minhash, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(260)]
    texts, edits = [], []
    for c in range(400):
        copy, places = list(base), rng.choice(52, 4, replace=False)
        for i in places:
            copy[i * 5 + 2] = f"y{c}_{i}"
        texts.append(" ".join(copy))
        edits.append(set(places))
    shingles = [{tuple(w[i : i + 5]) for i in range(256)} for w in (t.split() for t in texts)]
    # Copies that share under two edited places are far below 0.8.
    near = [(a, b) for a in range(400) for b in range(a) if len(edits[a] & edits[b]) > 1 and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    want = groups(400, near)
    got = {r.doc_id: r.component_id for r in dart_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(400)] == want


@pytest.mark.parametrize("small", [96, 3])
def test_vectors_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(cap_filters, "SMALL", small)
    monkeypatch.setattr(cap_filters, "BLOCK_ROWS", 10 * small)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    v = [list(map(float, c + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4]))) for c in centres for _ in range(6)]
    v += [v[0], [x * 3 for x in v[1]], [0.0] * 16, [float("nan")] * 16, None, [1.0, 2.0], [1.0, 2.0], [], [None] + [1.0] * 15]
    unit = [np.array(x) / np.linalg.norm(x) if x and None not in x and np.isfinite(x).all() and any(x) else None for x in v]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    links = [(a, b) for a in range(len(v)) for b in range(a) if near(unit[a], unit[b])]
    degree = collections.Counter(i for p in links for i in p)
    want = groups(len(v), links)
    df = spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: r for r in cap_filters.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(v))] == [degree[i] for i in range(len(v))]
    assert [got[i].component_id for i in range(len(v))] == want
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (None, [1.0, 0.01, 0.0]), (4, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.02]), (9, [0.0, 0.0, -0.0]), (8, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(cap_filters.near_vectors(df).collect(), key=str)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 1, -1), (-1, 1, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4), (8, 0, 8), (9, 0, 9)]


@pytest.mark.parametrize("vectors", [2_000, 50_000, 8_000_000])
def test_near_pairs_share_filters(vectors):
    rng = np.random.default_rng(1)
    words, mean_list = cap_filters.code_size(vectors)
    x, z = rng.normal(size=(2, 800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    row, number = cap_filters.decode(np.concatenate([x, y]), 2, words, mean_list)
    sets = [set() for _ in range(1600)]
    for r, f in zip(row.tolist(), number.tolist()):
        sets[r].add(f)
    assert np.mean([bool(sets[i] & sets[i + 800]) for i in range(800)]) > 0.99


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_vectors_with_a_common_direction_meet_in_few_filters(common):
    rng, n = np.random.default_rng(3), 20_000
    direction = np.eye(64)[0] * np.sqrt(common)
    noise = lambda k: (lambda z: np.sqrt(1 - common) * z / np.linalg.norm(z, axis=1, keepdims=True))(rng.normal(size=(k, 64)))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(direction + noise(n))
    z = rng.normal(size=(600, 64))
    z -= (z * x[:600]).sum(axis=1, keepdims=True) * x[:600]
    y = 0.9501 * x[:600] + np.sqrt(1 - 0.9501**2) * unit(z)
    how = cap_filters.Sizes.of(64, 2, n, 0.95, x.mean(axis=0))
    assert (how.centre is None) == (common == 0)
    places, loads = [], np.zeros(how.words**2, np.int64)
    for part in (x, y):
        directions, level, core = how.directions(part)
        assert core.mean() < 0.01
        sets = [set() for _ in part]
        for k, m in enumerate(how.lists):
            rows = np.flatnonzero(level == k)
            row, number = cap_filters.decode(directions[rows], 2, how.words, m)
            loads += np.bincount(number, minlength=len(loads)) if part is x else 0
            for r, f in zip(rows[row].tolist(), number.tolist()):
                sets[r].add(f)
        places.append(sets)
    assert np.mean([bool(a & b) for a, b in zip(places[0], places[1])]) >= 0.98
    assert (loads * (loads - 1) / 2).sum() < 0.1 * n * (n - 1) / 2


def test_centred_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "CENTRED_FROM", 100)
    rng = np.random.default_rng(12)
    base = rng.normal(size=16) * 2.2
    centres = rng.normal(size=(90, 16)) + base
    v = [list(map(float, c + rng.normal(size=16) * rng.choice([0.1, 0.4, 0.7]))) for c in centres for _ in range(4)] + [list(map(float, base)), [1.0, 2.0]]
    unit = [np.array(x) / np.linalg.norm(x) for x in v]
    links = [(a, b) for a in range(len(v)) for b in range(a) if len(v[a]) == len(v[b]) and unit[a] @ unit[b] >= 0.95]
    degree, want = collections.Counter(i for p in links for i in p), groups(len(v), links)
    got = {r.vec_id: r for r in cap_filters.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>").repartition(3)).collect()}
    assert 0.3 < np.mean([unit[i] @ unit[i + 7] for i in range(300)]) < 0.95
    assert degree[360] > 20 and got[360].n_links == degree[360]  # the mean itself
    assert sum(got[i].n_links for i in range(len(v))) >= 0.99 * sum(degree.values()) and all(got[i].n_links <= degree[i] for i in range(len(v)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(v))]) >= 0.95


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = [list(map(float, np.ones(8) + rng.normal(size=8) * 0.02)) for _ in range(70)]
    monkeypatch.setattr(cap_filters, "BLOCK_ROWS", 20)
    got = cap_filters.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")).collect()
    assert all(r.n_links == 69 and r.component_id == 0 for r in got)


def test_decoded_filters_are_those_above_the_cap():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(20, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row, number, _ = cap_filters._exceeded(unit, 2, 16, 8.0)
    rotation, codes, places = cap_filters._code(12, 2, 16)
    turned = unit @ rotation
    sums = (turned[:, places[0]] @ codes[0].T)[:, :, None] + (turned[:, places[1]] @ codes[1].T)[:, None, :]
    want = set(zip(*map(list, np.nonzero(sums.reshape(20, -1) >= cap_filters.cap_height(12, 2, 16, 8.0) * np.sqrt(2)))))
    assert set(zip(row.tolist(), number.tolist())) == {(int(a), int(b)) for a, b in want}
    row, _ = cap_filters.decode(unit, 2, 16, 8.0)
    assert np.bincount(row, minlength=20).min() >= 4


def test_fingerprints_equal_brute_force(spark, odd, nothing):
    rng = np.random.default_rng(3)
    words = [f"wörd{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 400))) for _ in range(60)] + ["", None, "x", "漢字 🙂 a b c d e f"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in sketches.edited_fingerprints(df, 6).collect()}
    assert len(got) == len(texts)
    texts = [t or "" for t in texts]
    for i, t in enumerate(texts):
        nxt, r = texts[(i + 1) % len(texts)], got[i * 3]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = set(shingles(t)), set(shingles(edited))
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a or b else 1.0)) < 0.15
    out = sketches.edited_fingerprints(odd).collect()
    assert len(out) == odd.count() and len({r.fingerprint for r in out if r.doc_id in (3, 100)}) == 1
    assert sketches.edited_fingerprints(nothing).count() == 0
    assert sketches.edited_fingerprints(df.where("doc_id = 3")).first().near_next == 1.0


def test_fingerprints_of_one_id_and_of_ranges_that_grow(spark, monkeypatch):
    rows = [(None if i % 3 else 5, f"text {i % 40} " * (i % 7 + 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(sketches, "RANGE_BYTES", 100)
    monkeypatch.setattr(sketches, "MOST_RANGES", 3)
    got = sketches.edited_fingerprints(df).collect()
    order = sorted(((i is not None, i or 0, t) for i, t in rows))
    texts = [t for *_, t in order]
    want = collections.Counter((i if has else None, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + texts[(k + 1) % 600][: len(t) // 2]).encode()).hexdigest()) for k, (has, i, t) in enumerate(order))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_sketches_merge():
    hashes, starts = shingle_hashes(*text_bytes(pa.array([" ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500)), "tiny text"])))
    a, b, c = sketches.bottom_k(hashes, starts)
    assert abs(sketches.distinct(a) / 2996 - 1) < 0.3 and sketches.distinct(c) == 1
    assert abs(sketches.resemblance(a, b) - 0.5) < 0.15 and sketches.containment(b, a) > 0.75
    assert (sketches.merge(a, b) == a).all()
    assert (sketches.sketch_of(sketches.fingerprint(a)) == a).all()


def test_shards_are_exact_and_whole(spark, odd, nothing):
    for shards in (1, 3, 16):
        out = sharding.uniform_shards(odd.repartition(3), shards).collect()
        sizes = collections.Counter(r["shard"] for r in out)
        assert len(out) == odd.count() and max(sizes.values()) - min([sizes[s] for s in range(shards)]) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.uniform_shards(nothing).count() == 0
    clash = odd.withColumnsRenamed({"lang": "__place", "source": "row"})
    assert sharding.uniform_shards(clash, 4).select("__place", "row").count() == odd.count()


def test_more_partitions_than_cells(spark):
    out = sharding.uniform_shards(spark.range(300).repartition(9), 4, cell_rows=40, most_cells=4).collect()
    assert sorted(r.id for r in out) == list(range(300)) and [sorted(r.slot for r in out if r.shard == s) for s in range(4)] == [list(range(75))] * 4


def test_fingerprints_of_clashing_columns(spark, odd):
    clash = odd.withColumnsRenamed({"lang": "key", "source": "part", "score": "marks", "shard": "one"})
    out = sketches.edited_fingerprints(clash).collect()
    assert len(out) == odd.count() and out[0].__fields__ == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sketches.fingerprints(clash.withColumnRenamed("key", "Fingerprint")).columns[-1] == "fingerprint"


def test_cells_of_large_shards(spark):
    out = sharding.uniform_shards(spark.range(1000).repartition(5), 4, cell_rows=60).collect()
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(250))


def test_matrix_has_its_margins_and_distribution(spark):
    counts = spark.createDataFrame([(0, 40), (1, 25), (3, 35)], "source int, n bigint")
    first = []
    for seed in range(60):
        rows = {r.source: list(r.sends) for r in sharding.communication_matrix(counts, [50, 30, 20], seed).collect()}
        assert [sum(rows[s]) for s in (0, 1, 3)] == [40, 25, 35] and [sum(c) for c in zip(*rows.values())] == [50, 30, 20]
        first.append(rows[0][0])
    # Hypergeometric: mean 40 x 50 / 100, variance 40 x 0.5 x 0.5 x 60 / 99.
    assert abs(np.mean(first) - 20) < 4 * np.sqrt(6.06 / 60) and 2.5 < np.var(first) < 12


@pytest.mark.parametrize("target", [None, {"a": 3.0, "b": 1.0}])
def test_mixture_is_exact(target):
    tokens = [4000, 700, 90]
    m = packing.Mixture(tokens, 64, [target.get(k, 0.0) for k in "abc"] if target else None)
    windows = -(-sum(tokens) // 64)
    taken = [[m.taken(w + 1, q) - m.taken(w, q) for q in range(3)] for w in range(windows)]
    assert all(x >= 0 for w in taken for x in w) and [sum(c) for c in zip(*taken)] == tokens
    assert [sum(w) for w in taken[:-1]] == [64] * (windows - 1)
    for q in range(3):
        for t in (0, tokens[q] // 2, tokens[q] - 1):
            w = m.window_of(t, q)
            assert m.taken(w, q) <= t < m.taken(w + 1, q)
    if target:
        assert all(abs(w[0] - 48) <= 1 for w in taken[: 2800 // 64])


def packed_ok(pieces, ids):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        raw, at = ids[d], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(raw)
            assert p.ids_crc32 == zlib.crc32(raw[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(raw)
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or s == max(by_seq)


@functools.cache
def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_BPE)


def token_ids(text):
    return np.array([*fresh_tokenizer().encode(text or "", add_special_tokens=False).ids, 1])


def test_packing_holds_every_token_once(spark, sf_dir, odd, nothing):
    docs = table(spark, sf_dir, "documents")
    packed_ok(queries.op9_packing(spark, sf_dir).collect(), {r.doc_id: token_ids(r.text) for r in docs.collect()})
    once = odd.dropDuplicates(["doc_id"])
    packed_ok(packing.pack(once, queries.BYTE_BPE).collect(), {r.doc_id: token_ids(r.text) for r in once.collect()})
    assert packing.pack(odd, queries.BYTE_BPE).agg(F.sum("length")).first()[0] == sum(len(token_ids(r.text)) for r in odd.collect())
    assert packing.pack(nothing, queries.BYTE_BPE).count() == 0


def test_words_apart_equal_the_whole_text():
    rng, words = random.Random(1), packing.text_ids(queries.BYTE_BPE)
    texts = ["".join(rng.choice(" \n\tab's.é漢1\r\x1f\xa0\0") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("  \nabc'sdlevrmt.!é漢1") for _ in range(rng.randint(1, 40))).strip().replace("  ", " ") for _ in range(3000)]
    texts += ["one <|endoftext|> two", "one<|endoftext|>two", "<|endoftext|>", "one <|endof text|> two", "", None]
    for a in range(0, len(texts), 50):
        got = words.documents(pa.array(texts[a : a + 50], pa.string()))
        assert [np.frombuffer(g, f"<u{words.width}").tolist() for g in got] == [token_ids(t)[:-1].tolist() for t in texts[a : a + 50]]
    assert 50256 in np.frombuffer(words.documents(pa.array(["one <|endoftext|> two"]))[0], f"<u{words.width}")


def test_tasks_of_other_operators_let_go_of_kept_words(spark, monkeypatch):
    df = spark.createDataFrame([(0, "one two three"), (1, "four five six")], "doc_id bigint, text string")
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([0, 1], pa.int64()), "text": ["one two three", "four five six"]})
    # A task as a worker runs it, in this process.
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: list(run(iter([batch]))))
    for work in (
        lambda: language_id.classify(df, None), lambda: toxicity.score_toxicity(df, toxicity.Toxicity({"idiot": 1.0})),
        lambda: dart_minhash._signed(df),
    ):
        words = packing.text_ids(queries.BYTE_BPE)
        assert packing.text_ids(queries.BYTE_BPE) is words
        left = weakref.ref(words)
        del words
        assert work()[0].num_rows == 2
        assert left() is None


class Counting:
    """A tokenizer that counts the characters it reads."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode(self, text, **options):
        self.chars += len(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_a_word_is_read_once_whatever_signs_follow_it():
    words, rng = packing.TextIds(queries.BYTE_BPE), random.Random(8)
    names = ["".join(rng.choice("aeinorst") for _ in range(9)) for _ in range(200)]
    text = " ".join(f"{n}{sign}" for n in names for sign in ("", ".", ",", "!", "?", "###", "$$$", "&&&", "2024", "/"))
    words.tokenizer = Counting(words.tokenizer)
    (got,) = words.documents(pa.array([text]))
    assert np.frombuffer(got, f"<u{words.width}").tolist() == token_ids(text)[:-1].tolist()
    assert words.tokenizer.chars < 1.2 * sum(len(n) + 1 for n in names)


def test_words_that_are_kept_take_bounded_memory():
    rng, words = random.Random(9), packing.TextIds(queries.BYTE_BPE)
    words.known.most = 20_000
    made = lambda: "".join(rng.choice("abc'sdlevrmt.!é漢1") for _ in range(rng.randint(1, 30)))
    often, held = [made() for _ in range(250)], []
    for _ in range(60):
        text = " ".join(rng.choice(often) if rng.random() < 0.5 else made() for _ in range(100))
        assert np.frombuffer(words.documents(pa.array([text]))[0], f"<u{words.width}").tolist() == token_ids(text)[:-1].tolist()
        held.append(words.known.held())
    # Beyond the bound by no more than what a text adds; words went, and more than once.
    assert max(held) < 20_000 + 20_000 and sum(b < a for a, b in zip(held, held[1:])) > 1


@pytest.mark.parametrize(("sources", "docs", "least_piece"), [(200, 30, 1), (200, 30, 64), (40, 50, 64), (3, 300, 64)])
def test_all_sources_keep_their_shares(spark, sources, docs, least_piece):
    # Sources of equal size lie one after another in the table.
    rows = [(i, f"word {i % 7} " * 30, f"s{i // docs:03d}") for i in range(sources * docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3, "source")
    pieces = packing.pack(df, queries.BYTE_BPE, least_piece=least_piece).collect()
    packed_ok(pieces, {i: token_ids(t) for i, t, _ in rows})
    windows = collections.defaultdict(collections.Counter)
    for p in pieces:
        windows[p.sequence_id][p.doc_id // docs] += p.length
    total, done = sum(p.length for p in pieces), collections.Counter()
    tokens = collections.Counter()
    for w in windows.values():
        tokens.update(w)
    # After any number of windows a source is at most a round, which gives it least_piece tokens or a few more, from its share.
    slack = 2 if least_piece == 1 or sources == 3 else 2 * least_piece
    for w in sorted(windows):
        done.update(windows[w])
        assert all(abs(done[s] - sum(done.values()) * tokens[s] / total) <= slack for s in range(sources))
    if least_piece == 1:
        assert all(abs(w[s] - 2048 * tokens[s] / total) <= 2 for i, w in windows.items() if i < max(windows) for s in range(sources))


def test_sources_of_all_sizes(spark):
    rng = random.Random(6)
    sizes = [1, 1, 2, 3, 7, 20, 60, 200, 700]
    rows = [(s, i) for s, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    rows = [(k, " ".join(["token"] * rng.choice([0, 1, 40, 300])), f"s{s}") for k, (s, _) in enumerate(rows)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5), queries.BYTE_BPE).collect()
    packed_ok(pieces, {i: token_ids(t) for i, t, _ in rows})


@pytest.mark.parametrize("tokens", [[5, 9, 6, 8], [1, 1], [64, 127, 100], [1000]])
@pytest.mark.parametrize("rounds", [1, 2, 3, 7])
def test_rounds_give_every_token_once(tokens, rounds):
    r, starts = packing.Rounds(sum(tokens), rounds), [sum(tokens[:i]) for i in range(len(tokens))]
    places = []
    for low, n in zip(starts, tokens):
        for at in range(n):
            (place, one), = r.runs(at, 1, low, low + n)
            places.append(place)
        runs = list(r.runs(0, n, low, low + n))
        assert sum(m for _, m in runs) == n and [p for a, m in runs for p in range(a, a + m)] == places[-n:]
    assert sorted(places) == list(range(sum(tokens)))


def test_packing_of_clashing_columns_and_null_sources(spark, odd):
    clash = odd.withColumnsRenamed({"lang": "part", "shard": "queue_key", "score": "ids"})
    pieces = packing.pack(clash, queries.BYTE_BPE, least_piece=2000).collect()
    assert sum(p.length for p in pieces) == sum(len(token_ids(r.text)) for r in odd.collect())
    one = packing.pack(odd, queries.BYTE_BPE, target={"s": 1.0}).collect()
    assert sum(p.length for p in one) == sum(p.length for p in pieces)


def test_pipeline_drops_what_is_predicted_toxic(spark, sf_dir, monkeypatch):
    import corpus_pipeline
    from trustline.llm import toxicity

    # One idiot scores between 0.3 and 0.5, two score above, none below.
    model = toxicity.Toxicity({"idiot": 1.0}, np.array([-2.0, 2.2, 0.0]))
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    some = [r.doc_id for r in docs.select("doc_id").distinct().orderBy("doc_id").limit(40).collect()]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(some[:20]), "what idiots").when(F.col("doc_id").isin(some[20:]), "idiot idiot").otherwise(F.col("text")))
    monkeypatch.setattr(queries, "table", lambda s, d, name: docs if name == "documents" else table(s, d, name))
    predicted = {r.doc_id for r in queries.op10_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.not_toxic(spark, docs, sf_dir).collect()}
    assert predicted >= set(some) and kept == {r.doc_id for r in docs.collect()} - predicted


def test_stages_of_odd_rows(spark, sf_dir, odd, nothing):
    import corpus_pipeline as cp

    clash = odd.withColumnsRenamed({"lang": "lang_pred", "score": "toxic_score", "shard": "near_class"}).withColumn("near_id", F.lit("x"))
    clash = clash.unionByName(clash.where("doc_id = 3").withColumn("text", F.lit(None).cast("string")))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, clash, sf_dir)
        assert out.dtypes == clash.dtypes and out.where("toxic_score = 9 AND near_id = 'x'").count() == out.count()
        assert stage(spark, nothing, sf_dir).count() == 0
    spoken = {r.doc_id for r in cp.known_language(spark, clash, sf_dir).collect()}
    assert not spoken & {0, 1, 2, 4} and 5 in spoken
    assert cp.not_toxic(spark, clash, sf_dir).count() == clash.count()
    kept = cp.one_of_each(spark, clash, sf_dir).collect()
    # "That it." is document 3 three times and document 100; 3 also has a null text, which is no copy.
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id in (3, 100) and r.text) == [(3, "That it.")]
    assert sum(r.doc_id == 3 and r.text is None for r in kept) == 1
    assert {r.doc_id for r in kept} == {r.doc_id for r in clash.collect()} - {100}
    assert cp.packed(spark, clash, sf_dir).agg(F.sum("length")).first()[0] == sum(len(token_ids(r.text)) for r in clash.collect())
    assert cp.packed(spark, nothing, sf_dir).count() == 0


def test_a_copy_is_not_kept_for_its_ids_null_text(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, "some words here", "a"), (5, None, "a"), (5, "some words here", "a"), (5, "", "b")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, bool(r.text)) for r in cp.one_of_each(spark, docs, sf_dir).collect()) == [(1, True), (5, False)]


def test_run_reads_documents_once_for_language_and_toxicity(spark, sf_dir, monkeypatch):
    import corpus_pipeline as cp

    seen = []
    monkeypatch.setattr(cp, "one_of_each", lambda s, docs, d: seen.append(docs) or docs)
    monkeypatch.setattr(cp, "STAGES", [*cp.STAGES[:2], ("near duplicates", cp.one_of_each)])
    monkeypatch.setattr(cp, "READ_AGAIN", {cp.one_of_each})
    assert cp.run(spark, sf_dir).columns == table(spark, sf_dir, "documents").columns
    assert "documents.parquet" not in seen[0]._jdf.queryExecution().toString()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = table(spark, sf_dir, "documents")
    kept, seen = docs, {}
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        seen[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    assert seen["language"] >= seen["toxicity"] >= seen["near duplicates"]
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 0").collect()}
    everyone = {r.doc_id for r in docs.collect()}
    assert len((everyone - seen["toxicity"]) & toxic) <= 2 and len(everyone - seen["language"]) <= 3
    texts = {r.doc_id: r.text for r in kept.collect()}
    bags = {d: shingles(t) for d, t in texts.items()}
    assert not [(a, b) for a in bags for b in bags if a < b and likeness(bags[a], bags[b]) >= 0.8]
    packed_ok(cp.packed(spark, kept, sf_dir).collect(), {d: token_ids(t) for d, t in texts.items()})


def test_shards_of_the_whole_query_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    out = queries.op8_uniform_shards(spark, sf_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in out} == {d: (len(t) + 1, zlib.crc32(t), "rows", None) for d, t in docs.items()} and len(out) == len(docs)
    shards = collections.defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r)
    assert sorted(len(s) for s in shards.values()) == sorted(len(docs) // 16 + (k < len(docs) % 16) for k in range(16))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    # A uniform shuffle keeps no order of ids: of neighbours in a shard about half descend.
    orders = [a.doc_id > b.doc_id for s in shards.values() for a, b in zip(sorted(s, key=lambda r: r.slot), sorted(s, key=lambda r: r.slot)[1:])]
    assert abs(np.mean(orders) - 0.5) < 4 * 0.5 / np.sqrt(len(orders))
