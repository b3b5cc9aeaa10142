"""The digest index, the conversation trie and conversation repair, against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trustline.llm import conversation_repair, digest_index, prefix_trie


def normalised(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def test_exact_duplicates_of_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(50, "two\t\x0b words"), (7, "two words"), (60, "two\xa0words"), (None, "two \n words"), (None, "two \n words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("x")).withColumn("row", F.lit(1))
    got = digest_index.exact_duplicates(df).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normalised(t)].append(i)
    first = lambda ids: min(ids, key=lambda i: (i is None, i))
    key = lambda r: str(r)
    want = sorted(((i, first(groups[h]), len(groups[h]), h) for i, t in rows for h in [normalised(t)]), key=key)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1} and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert digest_index.exact_duplicates(nothing).count() == 0


def test_hot_text_among_others(spark, monkeypatch):
    monkeypatch.setattr(digest_index, "HOT_SHARE", 0.1)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("hot")).when(F.col("id") % 50 == 0, F.lit("warm")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = {r.doc_id: r for r in digest_index.exact_duplicates(df, generations=4).collect()}
    assert len(got) == 400 and got[397].keep_id == 1 and got[397].group_size == 133 and not got[397].kept and got[1].kept
    assert [i for i, r in got.items() if r.kept] and sum(r.kept for r in got.values()) == len({r.text_sha256 for r in got.values()})


def test_index_persists_and_takes_a_generation_twice(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "index")
    first, second = make([(5, "a"), (9, "b b"), (7, "a")]), make([(1, "a"), (2, "c"), (3, "b  b"), (4, "c")])
    seen = lambda df: sorted((r.doc_id, r.keep_id, r.kept, r.group_size) for r in df.collect())
    assert seen(digest_index.deduplicate(first, digest_index.DigestIndex(spark, path), 0)) == [(5, 5, True, 2), (7, 5, False, 2), (9, 9, True, 1)]
    # Opened again, with other wishes: the index is as it was made.
    again = digest_index.DigestIndex(spark, path, buckets=99)
    want = [(1, 5, False, 3), (2, 2, True, 2), (3, 9, False, 2), (4, 2, False, 2)]
    assert again.buckets == 4 and seen(digest_index.deduplicate(second, again, 1)) == want
    assert seen(digest_index.deduplicate(second, again, 1)) == want
    assert again.entries().count() == 3
    small = again.compact(str(tmp_path / "compact"))
    assert sorted(small.groups().drop("digest").collect()) == sorted(again.groups().drop("digest").collect())
    assert seen(digest_index.deduplicate(make([(0, "c"), (8, "d")]), small, 2)) == [(0, 2, False, 3), (8, 8, True, 1)]


def test_entries_are_not_exchanged(spark, tmp_path):
    index = digest_index.DigestIndex(spark, str(tmp_path / "i"))
    index.add(digest_index.digests(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")), 0)
    new = digest_index.digests(spark.createDataFrame([(3, "x"), (4, "z")], "doc_id bigint, text string")).groupBy("digest").agg(F.count("*").alias("n"))
    plan = new.join(index.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    below_entries = plan[plan.index("SortMergeJoin") :].split("digest_entries")[0].rsplit("Sort [", 1)[1]
    assert "SortMergeJoin" in plan and "Exchange" not in below_entries


def trie(rows):
    """All nodes by walking every prefix of every rebuilt conversation."""
    own = collections.defaultdict(list)
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], digest(r[2], r[3]))):
        own[conv].append((role, text))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if rebuilt[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def nodes_of(df):
    out = prefix_trie.prefix_trie(df)
    assert all(t == "bigint" or c == "ends_sha256" for c, t in out.dtypes)
    return sorted((tuple(r) for r in out.collect()), key=str)


def odd_conversations():
    rng = random.Random(7)
    rows = []
    for c in [*range(60), -7, -20, -40, 401, 820, 833]:
        if c % 20 == 0 and c in (20, 820):
            continue
        like = rng.choice(range(6))
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", "", None]) if like > 4 else "ua"[t % 2], rng.choice(["a b", "c", None, "", " d\te "]) if like > 3 else f"turn {t} of {like}"))
    # Truncations of one long conversation, copies of it, a turn number twice, no numbers, no conversation.
    long = [("user", f"part {i} and {i * i}") for i in range(40)]
    rows += [(1000 + 20 * k, t, *long[t]) for k in range(12) for t in range(40 - 3 * (k // 2))]
    rows += [(7, 3, "user", "again"), (7, 3, "user", "again"), (7, None, "user", "x"), (8, None, None, None), (8, None, "z", "y"), (None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [10_000, 60, 0])
def test_trie_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(prefix_trie, "FEW_ROWS", few)
    monkeypatch.setattr(prefix_trie, "LIST_CHARS", 30)
    rows = odd_conversations() if few else [r for r in odd_conversations() if r[0] is None or r[0] < 60]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("depth", F.lit("x")).repartition(7)
    assert nodes_of(df) == trie(rows)


def test_trie_of_a_conversation_over_many_ranges_and_of_nothing(spark):
    rows = [(40, t, "u", f"w{t} x") for t in range(3000)] + [(41, t, "u", f"w{t} x") for t in range(2500)] + [(c, 0, "u", "hello") for c in range(100, 130)]
    assert nodes_of(spark.createDataFrame(rows, CONVERSATIONS)) == trie(rows)
    assert nodes_of(spark.createDataFrame([], CONVERSATIONS)) == [] == nodes_of(spark.createDataFrame([(None, 1, "u", "x")], CONVERSATIONS))


def repaired(turns):
    """Faults, least cost, audit and repaired turns of one conversation's (turn, role, text) in order, by trying every edit."""
    seen, faults = set(), []
    for _, role, text in turns:
        core = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    roles = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    asked = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        to = asked[state]
        if inserted < 3:
            c, a, out = best(i, to[0], inserted + 1)
            found.append((c + 3, "I" + a, ((to, ""), *out)))
        if i < len(turns):
            _, role, text = turns[i]
            c, a, out = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                c, a, out = best(i + 1, to[0], 0)
                found.append((c + 3 + more, "R" + a, ((to, text), *out)))
                if (state, role[:1]) in roles:
                    c, a, out = best(i + 1, role[0], 0)
                    found.append((c + more, "K" + a, ((role, text), *out)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(turns), 0, -1):  # back to front, so that long conversations need no deep recursion
        for state in asked:
            best(i, state, 0)
    cost, audit, out = best(0, "", 0)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out


def in_order(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role, text))
    return {c: sorted(ts, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())) for c, ts in by.items()}


def broken_conversations(n=120):
    rng = random.Random(11)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 4, 7, 12]) + 1):
            rows.append((c if c else None, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "alien"]), rng.choice(["Fine.", "a b", "Cut", "why?", " ", None, f"Said {t}!", "end. \n"])))
    return rows


def test_repair_equals_brute_force(spark):
    rows = broken_conversations()
    summary, turns = conversation_repair.repair(spark.createDataFrame(rows, CONVERSATIONS).withColumn("cost", F.lit("x")).repartition(5))
    got = {r.conv_id: tuple(r)[1:] for r in summary.collect()}
    lines = collections.defaultdict(list)
    for r in turns.collect():
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append((r.role, r.text))
    want = {c: repaired(ts) for c, ts in in_order([(c, t, r or "", x or "") for c, t, r, x in rows]).items()}
    assert got == {c: w[:-1] for c, w in want.items()}
    assert {c: tuple(v) for c, v in lines.items()} == {c: w[-1] for c, w in want.items() if w[-1]}


def test_damage_and_repair_equal_brute_force(spark):
    rows = broken_conversations(300)
    damaged = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        damaged += [] if kind == 0 else [row, row] if kind == 3 else [row]
    want = {c: repaired(ts) for c, ts in in_order(damaged).items()}
    none = (0, 0, 0, 0, 0, 0, "", ())
    out = conversation_repair.damage_and_repair(spark.createDataFrame(rows, CONVERSATIONS).repartition(6)).collect()
    assert len(out) == len({r[0] for r in rows}) and {r[0] for r in rows} > set(want)
    for r in out:
        *facts, lines = want.get(r.conv_id, none)
        assert tuple(r)[1:8] == tuple(facts) and r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
    assert conversation_repair.damage_and_repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_long_conversation_over_many_ranges(spark):
    rng = random.Random(3)
    roles = ["system"] + [r for _ in range(20) for r in [rng.choice(["user", "assistant", "tool"])] * rng.choice([1, 1, 20, 60])]
    rows = [(5, t, r, f"turn {t}" + rng.choice(["", "."])) for t, r in enumerate(roles)] + [(6, 0, "user", "a."), (6, 1, "assistant", "b.")]
    summary, turns = conversation_repair.repair(spark.createDataFrame(rows, CONVERSATIONS))
    got = {r.conv_id: r for r in summary.collect()}
    *facts, lines = repaired([r[1:] for r in rows if r[0] == 5])
    assert tuple(got[5])[1:] == tuple(facts) and tuple(got[6])[1:] == (0, 0, 0, 0, 0, 0, "KK")
    assert [(r.role, r.text) for r in sorted(turns.where("conv_id = 5").collect(), key=lambda r: r.place)] == list(lines)


def test_powers_equal_steps(monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 7)
    powers, rng = conversation_repair.Powers(), random.Random(5)
    for _ in range(200):
        symbols = [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(1, 7))]
        counts = [rng.choice([1, 2, 9, 40]) for _ in symbols]
        costs = conversation_repair._with_inserts(conversation_repair._END)
        for s, n in zip(symbols[::-1], counts[::-1]):
            costs = functools.reduce(lambda c, _: conversation_repair.before(s, c), range(n), costs)
        cost, audit = conversation_repair.solve(symbols, counts, powers)
        one_by_one = conversation_repair.solve([s for s, n in zip(symbols, counts) for _ in range(n)], [1] * sum(counts), powers)
        assert cost == costs[0] and (cost, audit) == one_by_one and sum(e != "I" for e in audit) == sum(counts)
