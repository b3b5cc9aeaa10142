"""The trie of conversation prefixes, by truncation peeling.

Conversations are told by 128-bit hashes of their prefixes, the exclusive or of a number for each turn and place, so equal
prefixes have equal keys wherever they lie. Equal conversations are one sequence, whose copies are counted. From its end
down to the last prefix that another sequence shares, a sequence is alone: these nodes follow from sums along it. The rest is
peeled from the deepest shared prefix: sequences that end (or begin to be alone) at a depth meet the nodes that survive from
the depth below, are grouped by prefix, which discovers the nodes there and sums them up at once, lose their last turn and
go on. A depth is a Spark round; the deepest depths that hold only a few thousand rows together are one round.

No conversation, node or list of members is ever gathered: conversations are dealt to ranges of turns whose sums are
composed, and members' ids are hashed as they stream by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, stored

# So many rows of the deepest depths together are peeled in one task.
FEW_ROWS = 10_000
# Ids of a node's members travel to their hash in texts of about this many characters.
LIST_CHARS = 1 << 16
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "end_copies"]


def _run_starts(conv: np.ndarray, last: int | None) -> np.ndarray:
    """Where each row's conversation begins in the batch; -1 if it began in a batch before."""
    new = np.ones(len(conv), bool)
    new[1:] = conv[1:] != conv[:-1]
    new[0] = conv[0] != last
    return np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: ``place`` in the conversation, counted in this partition, and the digest as two numbers."""
    part, last, met = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        at, start = np.arange(len(conv)), _run_starts(conv, last)
        place = np.where(start >= 0, at - start, at + met) + 1
        last, met = conv[-1], int(place[-1])
        digest = batch.column("digest").cast(pa.binary(16))
        lanes = np.frombuffer(digest.buffers()[1], np.int64)[2 * digest.offset : 2 * (digest.offset + len(digest))].reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(2)), batch.column("words")],
            names=["conv_id", "part", "place", "t1", "t2", "words"],
        )


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: keys of the prefix with and without the turn, and the words up to it, from the partition's first turn on."""
    part, last, keys, met = TaskContext.get().partitionId(), None, np.zeros(2, np.uint64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth, words = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "depth", "words"))
        start = _run_starts(conv, last)
        sums = np.cumsum(words)
        upto = sums - np.where(start >= 0, (sums - words)[start], -met)
        out = []
        for lane in range(2):
            term = mix64(batch.column(f"t{lane + 1}").to_numpy(zero_copy_only=False).view(np.uint64) ^ mix64(depth.astype(np.uint64) * _SALTS[lane]))
            both = np.bitwise_xor.accumulate(term)
            key = both ^ np.where(start >= 0, (both ^ term)[start], keys[lane])
            keys[lane] = key[-1]
            out += [key.view(np.int64), (key ^ term).view(np.int64)]
        last, met = conv[-1], int(upto[-1])
        arrays = [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), batch.column("depth"), batch.column("length"), *map(pa.array, (out[0], out[2], out[1], out[3])), batch.column("words"), pa.array(upto)]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "depth", "length", "k1", "k2", "p1", "p2", "words", "upto"])


def _shifts(rows: DataFrame, place: str, sums: dict[str, Column]) -> DataFrame:
    """(conv_id, part, ...) of conversations that lie in several ranges: what their ranges before sum up to.

    Only the last conversation of a range can go on in the next, so there are at most two rows a range."""
    last = F.broadcast(rows.groupBy("part").agg(F.max("conv_id").alias("conv_id")).select("conv_id").distinct())
    pieces = rows.join(last, "conv_id").groupBy("conv_id", "part").agg(*[F.max_by(c, place).alias(c) for c in sums])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("conv_id", "part", *[F.coalesce(total.over(before), F.lit(0)).cast("bigint").alias(f"{c}_before") for c, total in sums.items()])


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and (conv_id, depth, length, t1, t2, words) of all turns of the rebuilt ones."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest"),
        F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    local = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "conv_id bigint, part int, place bigint, t1 bigint, t2 bigint, words bigint"))
    shifted = local.join(F.broadcast(_shifts(local, "place", {"place": F.sum("place")})), ["conv_id", "part"], "left")
    placed = shifted.select("conv_id", (F.col("place") + F.coalesce("place_before", F.lit(0))).alias("place"), "t1", "t2", "words")
    # How many turns a conversation takes from its donor, and how many it has of its own.
    sizes = stored(local.groupBy("conv_id").agg(F.count("*").alias("n")))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("taken")
    donors = sizes.where("conv_id % 20 = 0").select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    given = F.least(F.col("taken"), F.coalesce("has", F.lit(0)))
    each = sizes.select("conv_id", "n", taken, (F.col("conv_id") - F.col("conv_id") % 20).alias("donor")).join(donors, "donor", "left")
    each = stored(each.select("conv_id", "donor", "taken", given.alias("given"), (given + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length")))
    turns = ["t1", "t2", "words"]
    first = placed.where("conv_id % 20 = 0 AND place <= 3").withColumnRenamed("conv_id", "donor")
    donated = first.join(each, "donor").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "length", *turns)
    own = placed.join(each, "conv_id").where("place > taken").select("conv_id", (F.col("place") - F.col("taken") + F.col("given")).alias("depth"), "length", *turns)
    return each.select("conv_id", "length"), donated.unionByName(own)


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns with the keys of the prefixes that they end (k1, k2) and extend (p1, p2), and ``upto``, the words of the former."""
    order = ["conv_id", "depth"]
    schema = "conv_id bigint, part int, depth bigint, length bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, words bigint, upto bigint"
    local = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_prefixed, schema))
    shifts = _shifts(local, "depth", {"k1": F.bit_xor("k1"), "k2": F.bit_xor("k2"), "upto": F.sum("upto")})
    both = local.join(F.broadcast(shifts), ["conv_id", "part"], "left")
    key = lambda c, by: F.col(c).bitwiseXOR(F.coalesce(f"{by}_before", F.lit(0))).alias(c)
    return both.select("conv_id", "depth", "length", key("k1", "k1"), key("k2", "k2"), key("p1", "k1"), key("p2", "k2"), "words", (F.col("upto") + F.coalesce("upto_before", F.lit(0))).alias("upto"))


def _members_hashes(members: DataFrame) -> DataFrame:
    """(end_rep, ends_sha256) of members (end_rep, conv_id): the hash of each one's ids in ascending order.

    Ids are joined to texts in ranges of (end_rep, conv_id); only these texts meet, and are hashed as they come in order."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, ids, chars = None, [], 0
        rows: list[tuple[int, int, str]] = []
        for batch in batches:
            for r, c in zip(batch.column("end_rep").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (r != rep or chars > LIST_CHARS):
                    rows.append((rep, ids[0], ",".join(map(str, ids))))
                    ids, chars = [], 0
                rep = r
                ids.append(c)
                chars += 20
            yield pa.RecordBatch.from_pylist([dict(zip(("end_rep", "first", "ids"), r)) for r in rows], listed_schema)
            rows = []
        if ids:
            yield pa.RecordBatch.from_pylist([{"end_rep": rep, "first": ids[0], "ids": ",".join(map(str, ids))}], listed_schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            done = []
            for r, ids in zip(batch.column("end_rep").to_pylist(), batch.column("ids").to_pylist()):
                if r != rep:
                    done += [(rep, state.hexdigest())] if state else []
                    rep, state = r, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["end_rep", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["end_rep", "ends_sha256"])

    listed_schema = pa.schema([("end_rep", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    order = ["end_rep", "conv_id"]
    lists = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(listed, "end_rep bigint, first bigint, ids string")
    return lists.repartition("end_rep").sortWithinPartitions("end_rep", "first").mapInArrow(hashed, "end_rep bigint, ends_sha256 string")


def _peel_inside(rows: DataFrame, above: int) -> DataFrame:
    """Nodes deeper than ``above``, peeled in one task; rows are the nodes (with words) and what ends at them, a few in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        state: dict[tuple, list] = {}
        levels: dict[int, set] = {}

        def meet(key: tuple, conv: int, convs: int, children: int, leaves: int, saved: int, rep: int | None, copies: int | None) -> None:
            s = state.setdefault(key, [conv, 0, 0, 0, 0, None, None])
            s[0] = min(s[0], conv)
            for i, x in enumerate((convs, children, leaves, saved), 1):
                s[i] += x
            if rep is not None:
                s[5:] = rep, copies
            levels.setdefault(key[0], set()).add(key)

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["depth"], r["k1"], r["k2"])
                if r["words"] is not None:
                    known[key] = (r["p1"], r["p2"], r["words"])
                else:
                    meet(key, r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["end_rep"], r["end_copies"])
        done = []
        for depth in range(max(levels, default=0), above, -1):
            for key in levels.pop(depth, ()):
                conv, convs, children, leaves, saved, rep, copies = state.pop(key)
                p1, p2, words = known[key]
                leaves, saved = leaves if children else 1, saved + (convs - 1) * words
                done.append(dict(zip(_NODE, (*key, p1, p2, conv, convs, children, leaves, saved, rep, copies))))
                if depth - 1 > above:
                    meet((depth - 1, p1, p2), conv, convs, 1, leaves, saved, None, None)
        yield pa.RecordBatch.from_pylist(done, pa.schema([(c, pa.int64()) for c in _NODE]))

    return rows.repartition(1).mapInArrow(run, ", ".join(f"{c} bigint" for c in _NODE))


def _ascended(nodes: DataFrame) -> DataFrame:
    """What nodes are to their parents, after the last turn is stripped."""
    none = F.lit(None).cast("bigint")
    return nodes.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", none.alias("end_rep"), none.alias("end_copies"))


def _peel(nodes: DataFrame, ends: DataFrame) -> list[DataFrame]:
    """All nodes of depth 1 and more, of nodes (depth, k1, k2, p1, p2, words) and what ends at them."""
    rows = nodes.select("depth").unionByName(ends.where("depth > 0").select("depth")).groupBy("depth").count()
    deeper = F.sum("count").over(Window.orderBy(F.desc("depth")))
    above = rows.select("depth", deeper.alias("rows")).where(F.col("rows") > FEW_ROWS).agg(F.max("depth")).first()[0] or 0
    told = nodes.unionByName(ends, allowMissingColumns=True).where(F.col("depth") > above)
    peeled = [stored(_peel_inside(told, above))]
    for depth in range(above, 0, -1):
        state = ends.where(F.col("depth") == depth).unionByName(_ascended(peeled[-1].where(F.col("depth") == depth + 1)))
        sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("end_rep").alias("end_rep"), F.max("end_copies").alias("end_copies")]
        met = state.groupBy("k1", "k2").agg(*sums).join(nodes.where(F.col("depth") == depth), ["k1", "k2"])
        met = met.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
        peeled.append(stored(met.select([F.col(c).cast("bigint").alias(c) for c in _NODE])))
    return peeled


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations, the empty one included: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c takes its first crc32(c) % 4 turns from conversation c - c % 20, as far as that has turns. Turns come by
    number, null first; turns of one number by role and digest of role and text, so repeated rows are turns like others. A
    null role or text is empty. Rows of a null conv_id belong to no conversation and are left out. Columns other than
    conv_id, turn, role and text are not read. An empty table has no nodes."""
    lengths, turns = rebuilt_turns(conversations)
    rows = stored(_prefixes(turns))
    none = F.lit(0).cast("bigint")
    ends = rows.where("depth = length").select("conv_id", "length", "k1", "k2", "upto").unionByName(lengths.where("length = 0").select("conv_id", "length", none.alias("k1"), none.alias("k2"), none.alias("upto")))
    key = ["length", "k1", "k2"]
    # Equal conversations are one sequence, called by its smallest one.
    sequences = stored(ends.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies"), F.max("upto").alias("total")))
    reps = sequences.select(F.col("rep").alias("conv_id"), "copies", "total")
    along = stored(rows.join(reps, "conv_id"))
    prefix = ["depth", "k1", "k2"]
    shared = stored(along.groupBy(*prefix).agg(F.count("*").alias("sequences"), *[F.min(c).alias(c) for c in ("p1", "p2", "words")]).where("sequences > 1").repartitionByRange("depth", "k1").drop("sequences"))
    told = along.join(shared.select(*prefix, F.lit(True).alias("shared")), prefix, "left")
    alone = stored(told.where("shared IS NULL").drop("shared"))
    deepest = told.where("shared").groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("k1", "depth").alias("k1"), F.max_by("k2", "depth").alias("k2"), F.max("upto").alias("upto"))
    goes_on = (F.col("length") > F.coalesce("depth", none)).cast("bigint")
    stops = F.col("length") == F.coalesce("depth", none)
    ended = stored(
        sequences.select(F.col("rep").alias("conv_id"), "length", "copies", "total").join(deepest, "conv_id", "left").select(
            *[F.coalesce(c, none).alias(c) for c in prefix], "conv_id", F.col("copies").alias("n_convs"), goes_on.alias("n_children"), goes_on.alias("n_leaves"),
            ((F.col("copies") - 1) * (F.col("total") - F.coalesce("upto", none))).alias("saved_tokens"), F.when(stops, F.col("conv_id")).alias("end_rep"), F.when(stops, F.col("copies")).alias("end_copies"),
        )
    )
    peeled = _peel(shared, ended)
    shared_nodes = peeled[0]
    for level in peeled[1:]:
        shared_nodes = shared_nodes.unionByName(level)
    top = ended.where("depth = 0").unionByName(_ascended(shared_nodes.where("depth = 1")))
    root = stored(
        top.agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("end_rep").alias("end_rep"), F.max("end_copies").alias("end_copies"))
        .where("n_convs > 0").select(none.alias("depth"), *[none.alias(c) for c in ("k1", "k2", "p1", "p2")], "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"), "saved_tokens", "end_rep", "end_copies")
    )
    last = F.col("depth") == F.col("length")
    tails = alone.select(
        *prefix, "p1", "p2", "conv_id", F.col("copies").alias("n_convs"), (~last).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("total") - F.col("upto") + F.col("words"))).alias("saved_tokens"), F.when(last, F.col("conv_id")).alias("end_rep"), F.when(last, F.col("copies")).alias("end_copies"),
    )
    # A parent is a shared node or the root, else it is the same sequence a turn earlier.
    parents = stored(shared_nodes.unionByName(root).select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    below = stored(shared_nodes.unionByName(tails).join(parents, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")))
    nodes = below.unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    several = sequences.where("copies > 1").select(*key, F.col("rep").alias("end_rep"))
    hashes = _members_hashes(ends.join(several, key).select("end_rep", "conv_id"))
    many = F.coalesce(F.col("end_copies") > 1, F.lit(False))
    alone_or_none = F.when(F.col("end_copies") == 1, F.sha2(F.col("end_rep").cast("string"), 256)).otherwise(F.lit(_EMPTY))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where(~many).withColumn("ends_sha256", alone_or_none).select(out).unionByName(nodes.where(many).join(hashes, "end_rep").select(out))
