"""Near-duplicate documents by DartMinHash: weighted minwise signatures from hashed darts.

Each shingle owns a half-strip weight x rank, cut into cells of unit area whose hash says how many darts lie in them
(Poisson, mean one) and where; darts are the same for every text that has the shingle. A text keeps the darts under its
shingle's weight (its count) and under a rank limit that leaves about t (ln t + 2) of them, and each dart belongs to one of
t coordinates by hash. The lowest dart of a coordinate is its signature value, and two texts agree in a coordinate with the
probability of their weighted Jaccard similarity. Coordinates that stay empty take a doubled rank limit.

Signatures are cut into bands; texts that share a band are candidates. Equal texts are one node from the start. In a band's
bucket every node is compared with the bucket's most popular nodes, those that meet most others over all bands, which are
the originals of a group of copies; nodes of other components go on to the next pivots. What a bucket then still holds of
different components is compared in full, block of nodes against block of nodes. Candidates are verified by the exact
weighted Jaccard similarity of whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cap_filters import _groups
from .common import keep_nothing, mix64, release_memory, shingle_hashes, slices, stored, text_bytes
from .components import components, joined

ROWS, BANDS = 6, 40
# Texts of this pattern have a word: something other than control characters and white space of ASCII.
HAS_WORDS = r"[^\x00-\x20]"
COORDINATES = ROWS * BANDS
BLOCK_ROWS, BLOCK_BYTES = 2048, 2 << 20
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(18)])


@cache
def _limit(t: int) -> float:
    return t * (np.log(t) + 2)


def weighted(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, their counts, and the text of each."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, text))
    h, d = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))).astype(np.float64), d[at]


def _throw(h: np.ndarray, w: np.ndarray, text: np.ndarray, limit: np.ndarray, signature: np.ndarray, t: int) -> None:
    """Fills signature (texts, t) with the lowest darts below each text's rank limit; zero where there is none."""
    # Weights in intervals [0, 1), [1, 2), [2, 4), ...; cells of an interval of width d are 1 / d of rank high.
    top = int(np.ceil(np.log2(max(w.max(initial=1.0), 1.0)))) + 1
    best_rank, best_flat, best_dart = [], [], []
    for level in range(top):
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        have = w > low
        if not have.any():
            break
        cells = np.ceil(limit[text[have]] * width).astype(np.int64)
        owner = np.repeat(np.flatnonzero(have), cells)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = mix64(h[owner] ^ mix64(index.astype(np.uint64) * np.uint64(64) + np.uint64(level + 1)))
        darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
        which = np.repeat(np.arange(len(owner)), darts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(cell[which] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = mix64(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        weight = low + width * ((place >> np.uint64(32)).astype(np.float64) / 2.0**32)
        rank = (index[which] + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32) / width
        own = owner[which]
        kept = (weight < w[own]) & (rank < limit[text[own]])
        dart, own = dart[kept], own[kept]
        best_rank.append(rank[kept])
        best_flat.append(text[own] * t + ((dart >> np.uint64(32)) % np.uint64(t)).astype(np.int64))
        best_dart.append(dart)
    rank, flat, dart = np.concatenate(best_rank), np.concatenate(best_flat), np.concatenate(best_dart)
    order = np.lexsort((dart, rank))[::-1]  # the lowest comes last and stays
    signature.reshape(-1)[flat[order]] = dart[order]


def signatures(hashes: np.ndarray, starts: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """(texts, t) signature values; rows of texts without shingles are zero."""
    n = len(starts) - 1
    h, w, text = weighted(hashes, starts)
    signature = np.zeros((n, t), np.uint64)
    total = np.bincount(text, w, n)
    limit = _limit(t) / np.maximum(total, 1)
    open_ = total > 0
    while open_.any():
        mine = open_[text]
        _throw(h[mine], w[mine], text[mine], limit, signature, t)
        open_ &= (signature == 0).any(axis=1)
        limit = limit * 2
    return signature


def _batched(starts: np.ndarray, most: int = 60_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` darts' worth of shingles."""
    load = np.cumsum(np.maximum(np.diff(starts), int(_limit(COORDINATES)) // 2)) // most
    cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(starts) - 1]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = signature.shape
    values = signature.reshape(n, t // rows, rows)
    out = np.broadcast_to(mix64(np.arange(1, t // rows + 1, dtype=np.uint64)), (n, t // rows)).copy()
    for r in range(rows):
        out = mix64(out ^ values[:, :, r]) + np.uint64(r + 1)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node binary, bands array<bigint>): node is the text's MD5, null for texts without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, starts = shingle_hashes(*text_bytes(batch.column("text")))
                bands = np.zeros((batch.num_rows, BANDS), np.uint64)
                for a, b in _batched(starts):
                    bands[a:b] = band_hashes(signatures(hashes[starts[a] : starts[b]], starts[a : b + 1] - starts[a]))
                spoken = np.diff(starts) > 0
                nodes = [hashlib.md5(t.encode()).digest() if s else None for t, s in zip(batch.column("text").to_pylist(), spoken)]
                flat = pa.array(bands[spoken].reshape(-1).view(np.int64))
                ends = np.concatenate([[0], np.cumsum(spoken * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "node", "bands"]
                )
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node binary, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' weighted Jaccard similarity is at least ``least``; texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        last: tuple[bytes, dict] = (b"", {})
        for whole in batches:
            for batch in slices(whole, "text_a"):
                kept = []
                counts = [weighted(*shingle_hashes(*text_bytes(batch.column("text_a"))))]
                h, w, text = counts[0]
                cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
                for i, (node, other) in enumerate(zip(batch.column("b").to_pylist(), batch.column("text_b"))):
                    if node != last[0]:
                        last = (node, weighted(*shingle_hashes(*text_bytes(pa.array([other.as_py()], pa.string())))))
                    hb, wb, _ = last[1]
                    ha, wa = h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
                    at = np.minimum(np.searchsorted(hb, ha), max(len(hb) - 1, 0))
                    shared = np.minimum(wa, wb[at])[hb[at] == ha].sum() if len(hb) and len(ha) else 0.0
                    kept.append(bool(shared >= least * (wa.sum() + wb.sum() - shared) - 1e-9))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(kept)), batch.column("b").filter(pa.array(kept))], names=["a", "b"])

    # The pivot's text joins last: rows of a pivot with many partners can be split, and both texts meet in no shuffle.
    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return joined.mapInArrow(run, "a binary, b binary")


def _forest(rows: pa.Table, least: float) -> tuple[pa.Array, pa.Array] | None:
    """Of one bucket's pair of blocks: (node, root of its tree here) over the links between nodes of different components."""
    low, high, bucket = (rows.column(c)[0].as_py() for c in ("low", "high", "bucket"))
    block, n = rows.column("block").to_numpy(), rows.num_rows
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    component = rows.column("component").chunk(0).dictionary_encode().indices.to_numpy()
    bands = rows.column("bands").chunk(0).flatten().to_numpy().reshape(n, -1)
    untried = component[left][:, None] != component[right][None, :]
    # A pair that shares an earlier band is compared there.
    for band in range(int(np.argmax(bands[0] == bucket))):
        untried &= bands[left, band][:, None] != bands[right, band][None, :]
    if low == high:
        untried &= left[:, None] < right[None, :]
    if not untried.any():
        return None
    at_left, at_right = untried.any(axis=1), untried.any(axis=0)
    left, right, untried = left[at_left], right[at_right], untried[np.ix_(at_left, at_right)]
    hashes, starts = shingle_hashes(*text_bytes(rows.column("text").chunk(0)))
    h, w, text = weighted(hashes, starts)
    # A shingle's second occurrence in a text is a column of its own, so the lesser counts are those of shared columns.
    of = np.repeat(np.arange(len(h)), w.astype(np.int64))
    nth = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w.astype(np.int64)).astype(np.int64)
    _, column, uses = np.unique(mix64(h[of] ^ mix64(nth.astype(np.uint64))), return_inverse=True, return_counts=True)
    column, owner = (np.cumsum(uses > 1) - 1)[column[uses[column] > 1]], text[of[uses[column] > 1]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared, wide = np.zeros(untried.shape, np.float32), 1024
    for c in range(0, int((uses > 1).sum()), wide):
        a, b = np.searchsorted(column, (c, c + wide))
        has = np.zeros((n, wide), np.float32)
        has[owner[a:b], column[a:b] - c] = 1
        shared += has[left] @ has[right].T
    size = np.diff(starts).astype(np.float64)
    i, j = np.nonzero(untried & (shared >= least * (size[left][:, None] + size[right][None, :] - shared) - 1e-9))
    if not len(i):
        return None
    i, j = left[i], right[j]
    root = np.arange(n)
    while True:  # smallest index reachable, here
        nxt = root.copy()
        np.minimum.at(nxt, i, root[j])
        np.minimum.at(nxt, j, root[i])
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    node, linked = rows.column("node").chunk(0), np.flatnonzero(root < np.arange(n))
    return node.take(pa.array(linked)), node.take(pa.array(root[linked]))


def _compared(rest: DataFrame, texts: DataFrame, labels: DataFrame, least: float, whole: bool) -> DataFrame:
    """Links (a, b) that join components of a bucket; rest (bucket, node, blocks, bytes), texts (node, text, bands).

    Nodes of a bucket are compared inside ``blocks`` random blocks or, if ``whole``, in all pairs of blocks; there the
    bucket's largest component, which has nothing to find in itself, has blocks of its own that meet only those of others."""
    rows = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    main = each.groupBy("bucket").agg(
        F.max(F.struct("n", "b", "component")).alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("parts")
    )
    blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    sides = main.where("parts > 1").select(
        "bucket", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("b") - F.col("main.b")).alias("others"), blocks(F.col("main.n"), F.col("main.b")).alias("own")
    )
    rows = rows.join(sides, "bucket").join(texts, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    if whole:
        inside = F.col("component") == F.col("main")
        rows = rows.withColumn("block", F.when(inside, F.col("others") + deal(F.col("own"))).otherwise(deal(F.col("others"))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)))
    else:
        rows = rows.withColumn("block", deal(F.col("blocks"))).withColumn("other", F.col("block"))
    pairs = rows.select("node", "component", "text", "bands", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for group in _groups(batches, ["bucket", "low", "high"]):
            if (found := _forest(group, least)) is not None:
                yield pa.RecordBatch.from_arrays(list(found), names=["a", "b"])
        release_memory()

    keys = ["bucket", "low", "high"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, least: float = 0.8, pivots: int = 8) -> DataFrame:
    """(doc_id, component_id, kept, text_class): component_id is the smallest doc_id of the texts that links reach.

    Links join texts whose weighted Jaccard similarity of five-word shingles is at least ``least``; equal texts are one
    class, ``text_class``, a hex string. Null texts, empty ones and those of white space link with nothing, not even each
    other: component_id is their own doc_id, they are kept and text_class is null. Kept is otherwise the text of the
    smallest doc_id, null ids last; if that id has several texts in the group, the one of the smallest class. Repeated rows
    are all returned, alike; no rows in, none out; other columns of docs are not read.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(_signed(docs))
    # Equal texts have equal bands, so any of them stands for its class.
    nodes = stored(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(bands.join(shared, "bucket"))
    popular = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets"))
    ranked = stored(
        members.join(popular, "node")
        .withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("meets"), "node")))
        .where(F.col("rank") <= pivots)
        .select("bucket", F.col("node").alias("pivot"), "rank")
    )
    # Only texts that meet another are read again, one of each class.
    met = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("rep_id"))
    texts = stored(docs.join(met, F.col("doc_id").eqNullSafe(F.col("rep_id"))).where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("node")).select("node", "text").dropDuplicates(["node"]))
    labels = None
    for first, last in ((1, 1), (2, pivots)):
        candidates = members.join(ranked.where(F.col("rank").between(first, last)), "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        if labels is not None:
            for end in ("a", "b"):
                candidates = candidates.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
            candidates = candidates.where("NOT (coalesce(a_in, a) <=> coalesce(b_in, b))").select("a", "b")
        found = stored(_verified(candidates, texts, least))
        labels = stored(components(found)) if labels is None else joined(labels, found)
    # All pairs with a pivot are tried or of one component by now; what is left are pairs of others in larger buckets.
    rest = members.where(F.col("size") > pivots + 1).join(ranked.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti")
    placed = rest.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    rest = stored(placed.drop("component").join(apart, "bucket", "left_semi").join(texts.select("node", F.octet_length("text").alias("bytes")), "node"))
    if not rest.isEmpty():
        sized = rest.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
        rest = stored(rest.join(sized, "bucket"))
        compared = texts.join(nodes.select("node", "bands"), "node").join(rest.select("node").distinct(), "node", "left_semi")
        for whole in (False, True):
            # Buckets of one block are done after the first round.
            found = stored(_compared(rest.where("blocks > 1") if whole else rest, compared, labels, least, whole))
            labels = joined(labels, found)
    graph = signed.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node")).select("doc_id", "node", "group")
    # Null ids come last; of an id's different texts the one of the smallest class stands for it.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")
    smallest = graph.where("group IS NOT NULL").groupBy("group").agg(first).select("group", F.col("first.doc_id").alias("least_id"), F.col("first.node").alias("least_node"))
    return graph.join(smallest, "group", "left").select(
        "doc_id",
        F.coalesce("least_id", "doc_id").alias("component_id"),
        (F.col("group").isNull() | (F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("node") == F.col("least_node")))).alias("kept"),
        F.lower(F.hex("node")).alias("text_class"),
    )
