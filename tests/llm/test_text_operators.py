"""Tokens, classes and scores of texts, against the libraries, brute force and held-out labels."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustline.llm import language_id, line_quality, piece_codec, queries, sampling, token_counts, toxicity
from trustline.llm.common import Recent, fold, table, text_bytes

ALPHABET = " \n\tab cdthe.,!é▁漢🙂\0<0x0A>1234"


def strings(n, most=50, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)] + [" " * k + "a" + " " * k for k in range(9)]


def test_piece_codec_equals_library(spark, sf_dir, odd):
    texts = strings(400) + [r.text for r in table(spark, sf_dir, "documents").select("text").collect()][:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").unionByName(odd.selectExpr("cast(doc_id + 10000 as int) AS doc_id", "text"))
    lib = piece_codec.vocabulary(queries.PIECE_MODEL).library
    for r in piece_codec.encode_decode(df, queries.PIECE_MODEL).collect():
        ids = lib.encode(r.text or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_piece_codec_of_clashing_columns_and_no_rows(spark, odd, nothing):
    clash = odd.withColumnsRenamed({"lang": "ids_sha256", "source": "N_Tokens"})
    out = piece_codec.encode_decode(clash, queries.PIECE_MODEL)
    assert out.columns == ["doc_id", "text", "score", "shard", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == odd.count()
    assert {r.n_tokens for r in out.where("text IS NULL OR text = ''").collect()} == {1}
    assert piece_codec.encode_decode(nothing, queries.PIECE_MODEL).count() == 0


def test_agendas_together_equal_the_heap_and_the_library(monkeypatch):
    vocab = piece_codec.vocabulary(queries.PIECE_MODEL)
    rng = random.Random(3)
    texts = strings(2000, seed=7) + ["".join(rng.choice("abtheinrs") for _ in range(n)) for n in range(1, 400, 7)]
    together = [piece_codec.encode_ids(t, vocab) for t in texts]
    assert together == [vocab.library.encode(t, add_eos=True) for t in texts]
    assert [vocab.decode_ids(i[:-1]).removeprefix(" ") for i in together] == vocab.library.decode(together)
    monkeypatch.setattr(piece_codec, "MOST_WIDTH", 0)
    monkeypatch.setattr(piece_codec, "WIDEST", 0)
    assert together == [piece_codec.encode_ids(t, vocab) for t in texts]


def test_parts_that_are_forgotten_come_again():
    vocab, made = piece_codec.vocabulary(queries.PIECE_MODEL), []
    known = Recent(lambda parts: made.extend(parts) or piece_codec._made(vocab, parts), most_bytes=3, size=lambda parts, _: len(parts))
    first = known.of(["▁one", "▁two", "", "\n", "▁three"])
    assert first[2] == ("", 0, "") and known.of(["▁four", "▁one"])[1] == first[0]
    for i in range(4):
        known.of([f"▁{i}", f"▁{i + 50}"])
    assert made.count("▁one") == 1 and known.of(["▁one"]) == first[:1] and made.count("▁one") == 2 and known.of(["", "▁two"]) == [first[2], first[1]]


def test_a_library_that_disagrees_is_an_error():
    vocab = piece_codec.vocabulary(queries.PIECE_MODEL)
    ids, counts = vocab.encode_parts(["▁one", "▁other"])
    vocab.check(["▁one", "▁other"], ids, counts, [" one", " other"])
    with pytest.raises(ValueError):
        vocab.check(["▁one", "▁other"], ids[::-1], counts, [" one", " other"])
    with pytest.raises(ValueError):
        vocab.check(["▁one", "▁other"], ids, counts, [" one", " othre"])


def test_token_counts_equal_library(spark, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.scored_pieces(queries.PIECE_MODEL)
    lib = Tokenizer(models.Unigram(pieces, 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    df = spark.createDataFrame(list(enumerate(strings(600, seed=1))), "doc_id int, text string").unionByName(odd.selectExpr("cast(doc_id as int) AS doc_id", "text"))
    for r in token_counts.count_tokens(df, queries.PIECE_MODEL).collect():
        assert r.n_tokens == (len(lib.encode(r.text, add_special_tokens=False).ids) if r.text else 0), r.text[:40]


def test_token_counts_of_clashing_columns_and_no_rows(odd, nothing):
    clash = odd.withColumnRenamed("lang", "N_tokens")
    out = token_counts.count_tokens(clash, queries.PIECE_MODEL)
    assert out.columns[-1] == "n_tokens" and "N_tokens" not in out.columns and out.count() == odd.count()
    assert token_counts.count_tokens(nothing, queries.PIECE_MODEL).count() == 0


def test_ties_go_to_the_longest_last_piece():
    c = token_counts.Counter([("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert c.count("aaa") == 1 and c.count("aaaa") == 2
    assert c.count("aé") == 3


def test_windows_hold_every_run_of_bytes():
    data, offsets = text_bytes(pa.array(["x" * 1000, "", "abc", None, "é" * 300]))
    windows, text, length = language_id.cut_windows(data, offsets)
    for i in range(5):
        own = windows[text == i]
        whole = bytes(data[offsets[i] : offsets[i + 1]])
        runs = {whole[j : j + 5] for j in range(len(whole) - 4)}
        assert runs <= {bytes(w[j : j + 5]) for w, n in zip(own, length[text == i]) for j in range(n - 4)}
    assert set(text) == {0, 2, 4}


def small_net(seed=3):
    rng = np.random.default_rng(seed)
    mask = np.zeros((5 * 4, 6))
    for i, w in enumerate(language_id.WIDTHS):
        mask[: w * 4, 2 * i : 2 * i + 2] = 1
    net = language_id.ByteNet(["a", "b", "c"], rng.normal(size=(256, 4)), rng.normal(size=(20, 6)) * mask, rng.normal(size=6) * 0.1, rng.normal(size=(6, 3)), rng.normal(size=3))
    net.embed[0] = 0
    return net, mask


def test_network_equals_naive_convolution(spark):
    net, _ = small_net()
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(n)) + "z" for n in (1, 3, 40, 255, 256, 257, 700)]
    for r, text in zip(language_id.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), net).orderBy("doc_id").collect(), texts):
        raw = text.encode()
        total, at = np.zeros(3), 0
        while True:
            window = (raw[at : at + 256] + bytes(256))[:256]
            responses = []
            for k in range(6):
                width = language_id.WIDTHS[k // 2]
                here = [sum(net.embed[window[i + j]] @ net.filters[4 * j : 4 * j + 4, k] for j in range(width)) for i in range(252)]
                responses.append(max(0, max(here) + net.bias[k]))
            e = np.exp(np.array(responses) @ net.dense + net.offset)
            total += e / e.sum() * len(raw[at : at + 256])
            if at + 256 >= len(raw):
                break
            at += 252
        assert r.lang_pred == net.languages[total.argmax()] and np.isclose(r.score, total.max() / total.sum(), atol=1e-6)


def test_gradients_equal_differences():
    net, mask = small_net()
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(0, 256, (5, 256)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss, grads = net.gradients(windows, labels, mask)
    for w, g in zip((net.embed, net.filters, net.bias, net.dense, net.offset), grads):
        places = np.argsort(-np.abs(g).ravel())[:4]
        for at in places:
            old = w.flat[at]
            w.flat[at] = old + 1e-5
            up, _ = net.gradients(windows, labels, mask)
            w.flat[at] = old - 1e-5
            down, _ = net.gradients(windows, labels, mask)
            w.flat[at] = old
            assert np.isclose((up - down) / 2e-5, g.flat[at], rtol=1e-3, atol=1e-7)


def test_language_id_on_held_out_texts(spark, sf_dir):
    out = queries.op1_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and np.mean([r.lang_pred == r.lang for r in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_of_odd_texts(odd, nothing):
    rng = np.random.default_rng(0)
    net = language_id.fit(rng.integers(97, 99, (8, 256)).astype(np.uint8), np.arange(8) % 2, ["aa", "bb"], epochs=1)
    for model in (net, None):
        out = language_id.classify(odd, model).collect()
        assert len(out) == odd.count()
        assert all(r.lang_pred == "und" and r.score == 0 for r in out if not any(map(str.isalpha, r.text or "")))
        assert out[0].shard == "x"
        assert language_id.classify(nothing, model).count() == 0
    assert language_id.train(nothing, F.lit(True)) is None


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, chain = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    weights = {y: np.exp(sum(scores[i, y[i]] for i in range(4)) + sum(chain[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=4)}
    z = sum(weights.values())
    got, pairs, log_z = line_quality.marginals(np.concatenate([scores, scores[:1]]), np.array([0, 0, 0, 0, 2]), chain)
    assert np.allclose(got[:4], [sum(w for y, w in weights.items() if y[i]) / z for i in range(4)])
    assert np.isclose(got[4], 1 / (1 + np.exp(scores[0, 0] - scores[0, 1])))
    assert np.isclose(log_z, np.log(z) + np.log(np.exp(scores[0]).sum()))
    assert np.allclose(pairs, [[sum(w * sum((a, b) == p for p in zip(y, y[1:])) for y, w in weights.items()) / z for b in (0, 1)] for a in (0, 1)])


def test_quality_on_held_out_texts(spark, sf_dir, odd, nothing):
    out = queries.op2_line_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert len(out) > 15 and np.mean([r.predicted == r.quality for r in out]) > 0.85
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = line_quality.train(docs, labels, fold("doc_id", 3) != 1)
    scored = line_quality.score_quality(odd, field).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 for r in scored if not (r.text or "").strip())
    assert line_quality.score_quality(nothing, field).count() == 0
    assert line_quality.train(nothing, labels, F.lit(True)) is None


def test_sampled_lines_are_whole_runs(spark):
    rows = spark.createDataFrame([(1, 1, "\n".join(f"line {i} is here" for i in range(500))), (2, 0, "one\n\ntwo words")], "doc_id bigint, y int, text string")
    got = line_quality.sampled_lines(rows, 30).collect()
    lines = sorted(r.line for r in got if r.doc_id == 1)
    assert len(lines) == 30 and lines == list(range(lines[0], lines[0] + 30)) and lines[-1] < 500
    x, _, length = line_features_of("one\n\ntwo words")
    two = sorted((r for r in got if r.doc_id == 2), key=lambda r: r.line)
    assert [r.line for r in two] == [0, 1] and np.allclose([r.x for r in two], x) and [r.length for r in two] == length.tolist()


def line_features_of(text):
    return line_quality.line_features(*text_bytes(pa.array([text])))


def test_grammar_composes():
    m = toxicity.Toxicity({"idiot": 1.0})
    plain, targeted, negated, reported = (m.clause(t) for t in ("what idiots", "you idiot", "he is not an idiot", "she said idiot"))
    assert negated < plain < targeted and reported < plain
    assert m.clause("a kind word") == 0 and m.clause("i will kill you") > 0
    assert [m.clause(c) for c in m.clauses("fine. you idiot. fine")] == [targeted]
    assert not m.paths("nothing here").any() and m.paths("you idiot. fine\nidiot") @ m._factors == targeted + plain
    # The composed table equals the machines run side by side.
    rng = random.Random(2)
    for _ in range(200):
        tags = [rng.randrange(6) for _ in range(8)]
        state, states = 0, [0] * 4
        machines = (toxicity.NEGATED, toxicity.REPORTED, toxicity.TARGETED, toxicity.THREATENED)
        for t in tags:
            state, arcs = toxicity.GRAMMAR[state][t]
            moves = [x.step(s, t) for x, s in zip(machines, states)]
            states = [s for s, _ in moves]
            assert arcs == {a for _, a in moves if a is not None}


def test_threats_count_with_a_target():
    m = toxicity.Toxicity({"idiot": 1.0})
    bare, after, before, far, negated, reported = map(
        m.clause, ("kill the process", "i will kill you", "ich werde dich töten", "kill every single one of you", "i will not kill you", "she said i will kill you")
    )
    assert 0 < bare < 0.05 and after > 20 * bare and far == after and bare < before < after
    assert negated < 0.2 * after and reported < 0.5 * after
    assert m.clause("you and they") == 0


def test_stems_are_learned():
    counts = [("lowe", 40, 1), ("lowei", 39, 0), ("loweis", 12, 0), ("them", 30, 200)]
    assert list(toxicity.choose_stems([c for c in counts if c[0] != "them"], 50, 400)) == ["lowei"]


def test_stems_of_copied_texts_explain_nothing():
    found_in = [[0]] * 60 + [[0, 1]] * 20 + [[2]] * 5
    assert set(toxicity.explaining({"lowei": 1.0, "rarewo": 1.0, "chonu": 1.0}, found_in, 85, 0.3)) == {"lowei", "chonu"}


def test_stems_of_texts(spark):
    texts = ["Loweixyz and rarewording", "nothing at all", "chonu"]
    got = toxicity.stems_of_texts(spark.createDataFrame([(t,) for t in texts], "text string"), ["lowei", "rarewo", "chonu"])
    assert sorted(got) == [[0, 1], [2]]


def naive_score(model, text):
    """Every word of every sentence through the four machines side by side, without tables or shortcuts."""
    total, machines = 0.0, (toxicity.NEGATED, toxicity.REPORTED, toxicity.TARGETED, toxicity.THREATENED)
    for line in text.lower().split("\n"):
        for clause in re.split(r"(?<=[.?!]) ", line):
            states = [m.start for m in machines]
            for word in re.findall(r"[^\W_]+(?:['’][^\W_]+)?", clause):
                stems = [s for s in model.stems if word.startswith(s)]
                lists = ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS))
                tag = next((t for t, words in lists if word in words), toxicity.INSULT if stems else toxicity.OTHER)
                moves = [m.step(s, tag) for m, s in zip(machines, states)]
                states = [s for s, _ in moves]
                if tag in (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET):
                    score = model.stems[max(stems, key=len)] if tag == toxicity.INSULT else 1.0
                    for _, arc in moves:
                        score *= 1.0 if arc is None else 0.0 if arc == "" else model.arcs[arc]
                    total += score
    x = model.curve @ [1, np.log1p(total), np.sqrt(1000 * total / (len(text) + 200))]
    return 1 / (1 + np.exp(-x))


def test_scores_equal_a_naive_reading(spark, sf_dir, odd):
    model = toxicity.Toxicity({"idiot": 1.0, "idiotic": 0.5, "trash": 0.7, "scum": 1.0}, np.array([-2.0, 1.3, 0.4]), {a: 0.3 + i / 3 for i, a in enumerate(toxicity.ARCS)})
    rng = random.Random(8)
    words = "you the idiot idiotically trash scum not said kill hurt them never a b. c! d?\n e, don't we no wrote.".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [r.text for r in table(spark, sf_dir, "documents").select("text").collect()][:100] + [r.text or "" for r in odd.collect()]
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], [naive_score(model, t) for t in texts])


def test_arc_weights_are_learned():
    rng = random.Random(4)
    model = toxicity.Toxicity({"idiot": 1.0})
    # Here reported insults are as toxic as others, and negated ones are not toxic at all.
    kinds = [("what an idiot", 1), ("she said idiot", 1), ("he is not an idiot", 0), ("nothing of the kind", 0)]
    texts = [rng.choice(kinds) for _ in range(600)]
    paths = np.array([model.paths(t) for t, _ in texts])
    toxicity.fit_weights(model, paths, np.array([len(t) for t, _ in texts], float), np.array([y for _, y in texts], float))
    assert model.arcs["reported"] > 0.6 and model.arcs["negated"] < 0.2 and model.arcs["threat on target"] == 1.0
    got = model.score(np.array([model.paths(t) for t, _ in kinds]), np.array([len(t) for t, _ in kinds], float))
    assert [round(g) for g in got] == [1, 1, 0, 0]

def test_toxicity_of_odd_texts(spark, sf_dir, odd, nothing):
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    out = toxicity.score_toxicity(odd, model).collect()
    assert len(out) == odd.count() and len({r.score for r in out}) == 1 and out[0].score < 0.3
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.train(nothing, table(spark, sf_dir, "labels"), F.lit(True)).stems


def test_toxicity_sample_is_few_files_however_the_documents_are_dealt(spark, sf_dir, monkeypatch):
    samples, store = [], toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df: samples.append(store(df)) or samples[-1])
    docs, labels = table(spark, sf_dir, "documents").cache(), table(spark, sf_dir, "labels")
    models = [toxicity.train(dealt, labels, fold("doc_id", 4) != 2) for dealt in (docs.repartition(40), docs.coalesce(1))]
    assert max(len(s.inputFiles()) for s in samples) <= 8
    many, one = (sorted(map(tuple, s.collect())) for s in samples)
    wanted = labels.where((fold("doc_id", 4) != 2) & F.col("toxic").isNotNull()).join(docs, "doc_id").where("text <> ''").count()
    assert many == one and len(many) == wanted
    assert models[0].stems == models[1].stems and models[0].arcs == models[1].arcs and models[0].curve.tolist() == models[1].curve.tolist()


def test_fold_is_crc32_of_the_text(spark):
    got = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


@pytest.mark.parametrize("name", ["op4_token_counts", "op5_piece_codec", "op10_toxicity"])
def test_queries_return_a_row_a_document(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.count() == out.select("doc_id").distinct().count() == table(spark, sf_dir, "documents").count()


def test_clauses_of_long_texts_are_those_of_a_naive_reading_and_take_linear_time():
    model = toxicity.Toxicity({"idiot": 1.0, "scum": 0.5})

    def naive(text):
        """A match's clause by looking for the nearest ends on both sides."""
        done = -1
        for m in model._finditer(text):
            if m.start() >= done:
                a = max(text.rfind(e, 0, m.start()) for e in ("\n", ". ", "? ", "! "))
                done = min([e for e in (text.find(e, m.end()) for e in ("\n", ". ", "? ", "! ")) if e >= 0], default=len(text))
                yield text[a + 1 : done]

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["idiot", "scum", "you", " ", " ", ". ", ".", "?", "! ", "\n", ", ", "x", "not "]) for _ in range(rng.randrange(60)))
        assert list(model.clauses(text)) == list(naive(text))
    for line in ("they said you are an idiot of scum and more\n", "an idiot, and then some words "):
        text = line * (5_000_000 // len(line))
        began = time.perf_counter()
        paths = model.paths(text)
        assert time.perf_counter() - began < 30 and paths.sum() > 0


def test_every_language_is_learned_and_samples_stay_bounded(spark):
    rows = [(i, f"l{i % 300}" if i % 5 else "common") for i in range(6000)] + [(None, "l1"), (7000, None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, y string")
    got = sampling.bounded_ids(labelled, 4, 5000).groupBy("y").count().collect()
    assert {r.y for r in got} == {y for i, y in rows if y and i is not None} and sum(r["count"] for r in got) <= 4 * len(got)
    few = sampling.bounded_ids(labelled, 1000, 200).collect()
    assert len(few) == 200 == len({r.y for r in few})
    assert sampling.bounded_ids(labelled.limit(0), 4, 10).count() == 0
    again = sampling.bounded_ids(labelled.repartition(3), 4, 5000)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in sampling.bounded_ids(labelled, 4, 5000).collect()}


def test_texts_without_spaces_are_encoded_as_the_library_does(monkeypatch):
    vocab, rng = piece_codec.vocabulary(queries.PIECE_MODEL), random.Random(2)
    made = ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们漢字", "ab的é🙂z1\0", "e") for n in (129, 200, 300, 600, 1500)]
    made += ["".join(rng.choice(["the", "king", "ation", "of", "word", "ing"]) for _ in range(n)) for n in (40, 90, 150, 400)]
    texts = [*made, *(m + " " + n for m in made for n in made[:3]), "x " * 200 + "y" * 500]
    for rows in (1, 10_000):
        monkeypatch.setattr(piece_codec, "LEAST_ROWS", rows)
        for t in texts:
            assert piece_codec.encode_ids(t, vocab) == [*vocab.library.encode(t), vocab.eos]
    ids, counts = vocab.encode_parts([p for t in texts for p in piece_codec.split_parts(t)])
    assert ids.tolist() == [i for t in texts for i in piece_codec.encode_ids(t, vocab)[:-1]]


def test_four_megabytes_of_chinese_take_seconds():
    vocab, rng = piece_codec.vocabulary(queries.PIECE_MODEL), np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_350_000)))
    for t in (text, "\n".join(text[i : i + 1000] for i in range(0, len(text), 1000))):
        began = time.process_time()
        ids = piece_codec.encode_ids(t, vocab)
        assert time.process_time() - began < 20 and ids == [*vocab.library.encode(t), vocab.eos]


def test_document_scores_equal_all_labellings(spark):
    from itertools import product

    rng = np.random.default_rng(9)
    field = line_quality.LineField(rng.normal(size=3 * line_quality.FEATURES) * 0.3, np.array([[0.4, -0.3], [-0.5, 0.6]]), 1.3, 0.2)
    texts = ["A fine line of words.\nMENU | login | 404\n\nAnother line, as good as the first one.\n$$$ 99", "one line only", "a\nb\nc\nd\ne\nf\ng h i.", "\n\n", "x" * 300 + "\n1 2 3 4"]
    want = []
    for t in texts:
        x, _, length = line_features_of(t)
        n = len(length)
        around = np.concatenate([x, np.vstack([np.zeros((1, x.shape[1])), x[:-1]])[:n], np.vstack([x[1:], np.zeros((1, x.shape[1]))])[:n]], axis=1)
        z, mass, good = around @ field.weights, 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=n):
            weight = np.exp(sum((z[i] if y else -z[i]) / 2 for i, y in enumerate(labels)) + sum(field.chain[a, b] for a, b in zip(labels, labels[1:])))
            mass, good = mass + weight, good + weight * np.array(labels, float)
        want.append(float(field.curve(np.array([(good / mass * length).sum() / length.sum()]))[0]) if n else 0.0)
    got = line_quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), field).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], want, atol=1e-6)
