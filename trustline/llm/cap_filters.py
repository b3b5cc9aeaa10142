"""Similar vectors by spherical-cap filters from structured random product codes.

A vector is rotated and cut into blocks; each block has a code of random unit vectors, and a filter's direction is one code
word a block, laid together: a few hundred words a block stand for tens of thousands of directions or more. List decoding
finds all directions whose inner product with the vector exceeds the cap's height: block products are compared with what the
other blocks can still add, so only promising prefixes are followed. Vectors meet in the filters that they share and are
verified there in double precision. Filters are numbered, and so many neighbours in number are a cell; a vector travels once
for each cell that it has filters in, with all its filters. A cell of many vectors is looked at block of rows against block
of rows. A pair that shares several filters counts in the first of them only, so links are counted without a list of pairs:
rows that share an earlier filter are not compared again, and each block gives a spanning forest for components.

The number of filters grows with the vectors, so that a filter holds a few tens of them, and the number of filters a vector
looks for grows with its logarithm. Of random pairs at cosine 0.9501 in 64 dimensions 99.7 % and more share a filter.

Vectors that have a direction in common would all meet in the filters around it. So filters are looked for along what is
left of a vector without the mean of all; that of two near vectors is at a lower cosine, which follows from its length, and
the lists are made as long as random pairs at that cosine need to meet. Vectors that are next to nothing but the mean have no
direction left and all meet, in blocks. Pairs are verified on the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components

BLOCK_ROWS = 1024
CELL_FILTERS = 16
# Filters of more rows in a block than this are compared as matrices.
SMALL = 96
# Vectors of one length are centred if there are so many of them, and if they are at least a sixteenth of all, so that
# sixteen means are known at most.
CENTRED_FROM = 1000
CENTRED_SHARE = 1 / 16
# Cosines of centred pairs below this ask for too long lists; lists are made for it then.
LEAST_CENTRED = 0.5


@cache
def _code(dim: int, blocks: int, words: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """A rotation, the code words of each block, and the blocks' places."""
    rng = np.random.default_rng([7, dim, blocks, words])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    codes = []
    for a, b in zip(cuts, cuts[1:]):
        c = rng.normal(size=(words, b - a))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, codes, [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def cap_height(dim: int, blocks: int, words: int, mean_list: float) -> float:
    """Height at which a random vector exceeds ``mean_list`` of the directions on average."""
    return NormalDist().inv_cdf(1 - min(0.9, mean_list / float(words) ** blocks)) / np.sqrt(dim)


def decode(unit: np.ndarray, blocks: int, words: int, mean_list: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) of all filters that the unit vectors exceed, ordered by row and number.

    A vector that exceeds fewer than ``mean_list`` / 2 lowers its own height until it exceeds as many, and takes the best."""
    row, number, score = _exceeded(unit, blocks, words, mean_list)
    least, lists = int(min(mean_list / 2, words**blocks)), mean_list
    short = np.flatnonzero(np.bincount(row, minlength=len(unit)) < least)
    full = ~np.isin(row, short)
    row, number = row[full], number[full]
    while len(short):
        lists *= 4
        r, f, s = _exceeded(unit[short], blocks, words, lists)
        order = np.lexsort((-s, r))
        r, f = r[order], f[order]
        each = np.bincount(r, minlength=len(short))
        rank = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each)
        enough = (each >= least) | (lists > words**blocks)
        kept = (rank < least) & enough[r]
        row, number = np.concatenate([row, short[r[kept]]]), np.concatenate([number, f[kept]])
        short = short[~enough]
    order = np.lexsort((number, row))
    return row[order], number[order]


def _exceeded(unit: np.ndarray, blocks: int, words: int, mean_list: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter number, sum of block products) of the filters above the cap's height, by list decoding."""
    n, dim = unit.shape
    rotation, codes, places = _code(dim, blocks, words)
    turned = unit @ rotation
    products = [turned[:, p] @ c.T for p, c in zip(places, codes)]
    need = cap_height(dim, blocks, words, mean_list) * np.sqrt(blocks)
    # What the blocks after this one can add at most.
    rest = np.zeros((blocks + 1, n))
    for j in range(blocks - 1, -1, -1):
        rest[j] = rest[j + 1] + products[j].max(axis=1)
    row, number, have = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for j in range(blocks):
        out = []
        step = max(32, (1 << 22) // words)
        for a in range(0, len(row), step):
            r = row[a : a + step]
            sums = have[a : a + step, None] + products[j][r]
            at, word = np.nonzero(sums + rest[j + 1][r][:, None] >= need)
            out.append((r[at], number[a : a + step][at] * words + word, sums[at, word]))
        row, number, have = (np.concatenate(x) for x in zip(*out)) if out else (row, number, have)
    return row, number, have


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def code_size(vectors: int) -> tuple[int, float]:
    """Code words of each of two blocks and the mean number of filters a vector: two filters for each vector in all."""
    words = max(64, math.ceil(math.sqrt(2 * vectors)))
    return words, 10 * math.log10(words**2)


def blocks_of(dim: int, blocks: int) -> int:
    """Blocks of a vector of this length: a code word of fewer than eight numbers would say too little."""
    return max(1, min(blocks, dim // 8))


@cache
def list_length(dim: int, blocks: int, words: int, cosine: float, base: float) -> float:
    """Filters a vector must look for, so that of random pairs at this cosine 995 in 1,000 meet: ``base`` or more.

    Tried on 800 pairs, the same for every run."""
    rng = np.random.default_rng([11, dim, words])
    x, z = rng.normal(size=(2, 800, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    both = np.concatenate([x, cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)])
    length = base
    while length < words**blocks / 4:
        row, number = decode(both, blocks, words, length)
        met = np.intersect1d(row[row < 800] * words**blocks + number[row < 800], (row[row >= 800] - 800) * words**blocks + number[row >= 800])
        if len(np.unique(met // words**blocks)) >= 796:
            break
        length *= 1.25
    return length


@dataclass(frozen=True)
class Sizes:
    """How vectors of one length are filtered: around ``centre``, with lists by how much of a vector the mean leaves.

    Level k of ``lists`` is for vectors of which at least ``left`` x 0.8 ** (k + 1) is left, in squared length."""

    words: int
    lists: tuple[float, ...]
    centre: np.ndarray | None = None
    left: float = 1.0
    core: float = 0.0

    def directions(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors to be filtered, the level of each, and which of them are so near the mean that what is left of two
        near ones may point anywhere: these all meet."""
        if self.centre is None:
            return unit, np.zeros(len(unit), np.int64), np.zeros(len(unit), bool)
        rest = unit - self.centre
        size = (rest**2).sum(axis=1)
        # What is nothing but the mean keeps its own direction.
        rest = np.where(size[:, None] > 1e-12, rest, unit)
        level = np.floor(np.log(np.maximum(size, 1e-12) / self.left) / math.log(0.8))
        return rest / np.linalg.norm(rest, axis=1, keepdims=True), np.clip(level, 0, len(self.lists) - 1).astype(np.int64), size <= self.core

    @staticmethod
    def of(dim: int, blocks: int, vectors: int, least: float, mean: np.ndarray | None = None) -> Sizes:
        """For so many vectors whose unit vectors have this mean."""
        words, base = code_size(vectors)
        left = 1 - float((mean**2).sum()) if mean is not None else 1.0
        cosine = lambda size: 1 - (1 - least) / size if size > 0 else -1.0
        # With little in common there is nothing to gain, with nearly all of it nothing to tell apart.
        if mean is None or left > 0.95 or cosine(left) < LEAST_CENTRED:
            return Sizes(words, (base,))
        need = lambda w, size: list_length(dim, blocks_of(dim, blocks), w, round(max(cosine(size), LEAST_CENTRED), 2), base)
        # Longer lists need more filters, else they would be fuller.
        words = max(64, math.ceil(math.sqrt(2 * vectors * max(1.0, 3 * need(words, left) / base - 2))))
        lists, size = [need(words, left)], left * 0.8
        while cosine(size) > LEAST_CENTRED:
            lists.append(need(words, size))
            size *= 0.8
        # If one of two near vectors has more left than this, what is left of them is at LEAST_CENTRED or more.
        return Sizes(words, (*lists, need(words, 0.0)), mean, left, 2 * (1 - least) / (1 - LEAST_CENTRED**2))


def _means(classes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """dim -> (vectors, mean of their unit vectors) for the lengths that are centred; sums are taken where rows lie."""
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().where(F.col("count") >= CENTRED_FROM).orderBy(F.desc("count"), "dim").limit(round(1 / CENTRED_SHARE)).collect()}
    total = classes.count()
    wanted = [d for d, n in counts.items() if n >= total * CENTRED_SHARE]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.intersect1d(dims, wanted).tolist():
                part = batch.filter(pa.array(dims == dim)).column("vector")
                have[dim] = have.get(dim, 0) + _unit(part, dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tolist() for v in have.values()], pa.list_(pa.float64()))], names=["dim", "sum"])

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in zip(batch.column("dim").to_pylist(), batch.column("sum").to_pylist()):
                have[dim] = have.get(dim, 0) + np.array(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tolist() for v in have.values()], pa.list_(pa.float64()))], names=["dim", "sum"])

    if not wanted:
        return {}
    parts = classes.select("dim", "vector").mapInArrow(sums, "dim int, sum array<double>").repartition(len(wanted), "dim")
    return {r.dim: (counts[r.dim], np.array(r["sum"]) / counts[r.dim]) for r in parts.mapInArrow(total_of, "dim int, sum array<double>").collect()}


def _filtered(classes: DataFrame, blocks: int, sizes: dict[int, Sizes], other: Sizes) -> DataFrame:
    """classes with ``filters`` array<bigint>, ascending; ``sizes`` by the vectors' length, ``other`` for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part, how = whole.filter(pa.array(dims == dim)), sizes.get(dim, other)
                step = max(32, min(2048, (1 << 22) // how.words))
                for i in range(0, part.num_rows, step):
                    batch = part.slice(i, step)
                    unit, level, core = how.directions(_unit(batch.column("vector"), dim))
                    lists = [(np.flatnonzero(level == k), m) for k, m in enumerate(how.lists)]
                    found = [(rows, *decode(unit[rows], blocks_of(dim, blocks), how.words, m)) for rows, m in lists if len(rows)]
                    # The core is one more filter, after all others.
                    found.append((np.flatnonzero(core), np.arange(core.sum()), np.full(core.sum(), how.words ** blocks_of(dim, blocks))))
                    row, number = (np.concatenate(x) for x in zip(*((rows[r], f) for rows, r, f in found)))
                    order = np.lexsort((number, row))
                    row, number = row[order], number[order]
                    ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(number))], names=[*batch.schema.names, "filters"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.mapInArrow(run, f"node binary, n bigint, vector {kind}, dim int, filters array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches in key order."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _links_in(rows: pa.Table, least: float) -> tuple[pa.Array, np.ndarray, pa.Array] | None:
    """Of one cell's pair of blocks: (node, links counted here, root of its tree here), for nodes with a link."""
    low, high, cell, dim = (rows.column(c)[0].as_py() for c in ("low", "high", "cell", "dim"))
    block, n, size = rows.column("block").to_numpy(), rows.column("n").to_numpy(), rows.num_rows
    lists = rows.column("filters").chunk(0)
    number, owner = lists.flatten().to_numpy(), np.repeat(np.arange(size), lists.value_lengths().to_numpy())
    unit = _unit(rows.column("vector").chunk(0), dim)
    here = np.flatnonzero(number // CELL_FILTERS == cell)
    here = here[np.argsort(number[here], kind="stable")]
    filters, starts, sizes = np.unique(number[here], return_index=True, return_counts=True)
    found = [_pairs_of_small(owner[here], np.repeat(sizes, sizes), number[here], unit, block if low != high else None, least)]
    # A pair that shares a filter of an earlier cell has met there.
    found[0] = _fresh(*found[0], number, owner, number < cell * CELL_FILTERS)
    for k in np.flatnonzero(sizes > SMALL):
        met = np.sort(owner[here[starts[k] : starts[k] + sizes[k]]])
        found.append(_first_met(met, unit, number, owner, int(filters[k]), block if low != high else None, least))
    i, j = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return None
    i, j = np.divmod(np.unique(np.minimum(i, j) * size + np.maximum(i, j)), size)
    links, root = np.zeros(size, np.int64), _roots(np.arange(size), i, j)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    used = np.unique(np.concatenate([i, j]))
    node = rows.column("node").chunk(0)
    return node.take(pa.array(used)), links[used], node.take(pa.array(root[used]))


def _pairs_of_small(row: np.ndarray, sizes: np.ndarray, number: np.ndarray, unit: np.ndarray, block: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows that share a filter of at most SMALL rows here; row and number are in filter order."""
    row, number = row[sizes <= SMALL], number[sizes <= SMALL]
    codes = []
    for d in range(1, SMALL):
        at = np.flatnonzero(number[d:] == number[:-d]) if d < len(number) else np.zeros(0, np.int64)
        if not len(at):
            break
        codes.append(np.minimum(row[at], row[at + d]) * len(unit) + np.maximum(row[at], row[at + d]))
    i, j = np.divmod(np.unique(np.concatenate(codes)), len(unit)) if codes else (np.zeros(0, np.int64),) * 2
    if block is not None:
        apart = block[i] != block[j]
        i, j = i[apart], j[apart]
    near = np.zeros(len(i), bool)
    for a in range(0, len(i), 16_384):
        near[a : a + 16_384] = np.einsum("ij,ij->i", unit[i[a : a + 16_384]], unit[j[a : a + 16_384]]) >= least
    return i[near], j[near]


def _fresh(i: np.ndarray, j: np.ndarray, number: np.ndarray, owner: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share none of the filters marked in ``before``."""
    if not len(i) or not before.any():
        return i, j
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    kept = before & np.isin(owner, used)
    known, column = np.unique(number[kept], return_inverse=True)
    has = np.zeros((len(used), len(known)), bool)
    has[np.searchsorted(used, owner[kept]), column] = True
    left, right = place[: len(i)], place[len(i) :]
    fresh = np.ones(len(i), bool)
    for a in range(0, len(i), 1024):
        fresh[a : a + 1024] = ~(has[left[a : a + 1024]] & has[right[a : a + 1024]]).any(axis=1)
    return i[fresh], j[fresh]


def _first_met(met: np.ndarray, unit: np.ndarray, number: np.ndarray, owner: np.ndarray, bucket: int, block: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows ``met`` of a filter that are near and share no filter before it; of different blocks, if these are given."""
    inside = np.zeros(len(unit), np.int64) - 1
    inside[met] = np.arange(len(met))
    before = (number < bucket) & (inside[owner] >= 0)
    earlier, of = number[before], inside[owner[before]]
    known, column, uses = np.unique(earlier, return_inverse=True, return_counts=True)
    # Rows that share the most frequent earlier filter have met there: only the others are compared, with all.
    new = np.ones(len(met), bool)
    if len(known) and uses.max() > 1:
        new[of[column == uses.argmax()]] = False
    rows = np.flatnonzero(new)
    out_i, out_j = [], []
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        near = unit[met[some]] @ unit[met].T >= least
        # Both rows new: the pair counts once, from the earlier row.
        near &= ~new[None, :] | (np.arange(len(met))[None, :] > some[:, None])
        if block is not None:
            near &= block[met[some]][:, None] != block[met][None, :]
        i, j = np.nonzero(near)
        out_i.append(some[i])
        out_j.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))
    return _fresh(met[i], met[j], number, owner, before)


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row, when the links (i, j) join what ``root`` has joined."""
    while True:
        nxt = root.copy()
        np.minimum.at(nxt, root[i], root[j])
        np.minimum.at(nxt, root[j], root[i])
        nxt = nxt[nxt]
        if (nxt == root).all():
            return root
        root = nxt


def near_vectors(df: DataFrame, least: float = 0.95, blocks: int = 2, words: int | None = None, mean_list: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df.

    Two rows link if the cosine of their vectors in double precision is at least ``least``. Vectors that are null, empty or
    zero, or hold null or non-finite components, link with nothing; nor do vectors of different lengths. Equal vectors are
    one class and link with each other. Null ids: such rows take part but are no component's smallest id unless all are
    null. Repeated rows count as rows. No rows in, none out; other columns are not read. ``blocks`` of ``words`` code words
    give words ** blocks filters, and a vector has ``mean_list`` on average; by default they follow from the number of distinct
    vectors, and from their mean, without which they are filtered.
    """
    v = F.col(f"`{vector_col}`")
    # Single precision travels as it is and is compared in double.
    element = getattr(df.schema[vector_col].dataType, "elementType", None)
    kind = "float" if isinstance(element, T.FloatType) else "double"
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda x: x.cast(kind)).alias("vector"))
    # Zero of either sign is the same component.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    sound = F.coalesce(
        (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("key", F.when(sound, F.unhex(F.md5(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))).cast("binary")))))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    classes = classes.withColumnRenamed("key", "node").withColumn("dim", F.size("vector"))
    classes = stored(classes.select("node", "n", "vector", "dim", "rep"))
    size, sizes = code_size(classes.count()), {}
    if words is None and mean_list is None:
        sizes = {dim: Sizes.of(dim, blocks, n, least, mean) for dim, (n, mean) in _means(classes).items()}
    filtered = stored(_filtered(classes.select("node", "n", "vector", "dim"), blocks, sizes, Sizes(words or size[0], (mean_list or size[1],))))
    cells = filtered.select("node", "dim", F.explode(F.array_distinct(F.transform("filters", lambda f: F.floor(f / CELL_FILTERS)))).alias("cell"))
    sizes = cells.groupBy("dim", "cell").agg(F.count("*").alias("size")).where("size > 1")
    # Ids find their blocks before vectors join.
    dealt = cells.join(sizes, ["dim", "cell"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    pairs = dealt.join(filtered, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if (found := _links_in(group, least)) is not None:
                node, links, root = found
                yield pa.RecordBatch.from_arrays([node, pa.array(links.astype(np.int64)), root], names=["node", "links", "root"])

    keys = ["dim", "cell", "low", "high"]
    found = stored(pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node binary, links bigint, root binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    graph = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("rep", "n", "node").join(links, "node", "left").join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("least_id"))
    of_class = of_class.join(smallest, "component").select(F.col("node").alias("key"), "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return rows.join(of_class, "key", "left").select(
        F.col("vec_id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("least_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("least_id", "vec_id"), F.col("least_id").isNull()).alias("kept"),
    )
