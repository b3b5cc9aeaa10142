"""Uniform shuffle into shards of exact sizes, drawn as a hypergeometric communication matrix.

Input partitions hold n_p rows, target cells hold exactly m_c rows. How many rows of partition p a uniform permutation
sends to cell c is a contingency table with these margins, and the table is drawn first: a binary tree over partitions
splits the cells' remaining counts with univariate hypergeometric draws, in SQL, each node on its own. Each partition
then permutes its rows locally and cuts them by its row of the table, rows are exchanged by cell, and each cell permutes
again. Shards are runs of cells, so a shard of any size is never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed

_PART_BITS = 33


def _log_factorial(x: str) -> str:
    """ln(x!) of a non-negative integer expression: Stirling's series, eight places further on."""
    z = f"(({x}) + 9D)"
    shift = " * ".join(f"(({x}) + {i}D)" for i in range(1, 9))
    series = f"1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5)) - 1D / (1680D * pow({z}, 7))"
    half_log_two_pi = "0.9189385332046727D"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {half_log_two_pi} + {series} - ln({shift}))"


def _hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """Number of good items among ``draws`` of ``total``, by inversion from the mode outwards; u is uniform in (0, 1)."""
    least_good = f"double({draws}) + {good} - {total}"
    mode = f"least(double({good}), double({draws}), greatest(0D, {least_good}, floor(({draws} + 1D) * ({good} + 1D) / ({total} + 2D))))"
    let = f"named_struct('k', double({good}), 't', double({total}), 'n', double({draws}), 'u', {u}, 'm', {mode})"
    lf = _log_factorial
    # The mode's mass: C(k, m) C(t - k, n - m) / C(t, n).
    of_good = f"{lf('h.k')} - {lf('h.m')} - {lf('h.k - h.m')}"
    of_others = f"{lf('h.t - h.k')} - {lf('h.n - h.m')} - {lf('h.t - h.k - h.n + h.m')}"
    of_all = f"{lf('h.t')} - {lf('h.n')} - {lf('h.t - h.n')}"
    mass = f"exp({of_good} + {of_others} - ({of_all}))"
    spread = "sqrt(h.n * (h.k / greatest(h.t, 1D)) * (1D - h.k / greatest(h.t, 1D)) * (h.t - h.n) / greatest(h.t - 1D, 1D))"
    reach = f"least(cast(least(h.n, h.k) as bigint), cast(20D + 12D * {spread} as bigint))"
    up = "s.pu * (h.k - s.ku) * (h.n - s.ku) / ((s.ku + 1D) * (h.t - h.k - h.n + s.ku + 1D))"
    down = "s.pd * s.kd * (h.t - h.k - h.n + s.kd) / ((h.k - s.kd + 1D) * (h.n - s.kd + 1D))"
    # One step out: the next mass above, then the next below; beyond either end the mass is zero.
    step = f"""CASE WHEN s.got >= 0D THEN s ELSE
      transform(array(named_struct('u1', IF(s.ku >= h.k OR s.ku >= h.n, 0D, {up}), 'd1', IF(s.kd <= 0D OR h.t - h.k - h.n + s.kd <= 0D, 0D, {down}))), q ->
        named_struct('sum', s.sum + q.u1 + q.d1, 'pu', q.u1, 'ku', s.ku + 1D, 'pd', q.d1, 'kd', s.kd - 1D,
          'got', CASE WHEN q.u1 > 0D AND h.u < s.sum + q.u1 THEN s.ku + 1D WHEN q.d1 > 0D AND h.u < s.sum + q.u1 + q.d1 THEN s.kd - 1D ELSE -1D END))[0] END"""
    walk = f"""transform(array({mass}), p ->
      aggregate(IF(h.u < p OR {reach} < 1, array(), sequence(1L, {reach})),
        named_struct('sum', p, 'pu', p, 'ku', h.m, 'pd', p, 'kd', h.m, 'got', IF(h.u < p, h.m, -1D)),
        (s, i) -> {step}, s -> cast(IF(s.got >= 0D, s.got, h.m) as bigint)))[0]"""
    return f"transform(array({let}), h -> {walk})[0]"


def _vector_draw(seed: int) -> str:
    """Of the items in ``cells``, how many of each kind are among ``draws``: one conditional draw after another."""
    u = f"(double(shiftrightunsigned(xxhash64({seed}L, lo, hi, j), 11)) + 0.5D) / 9007199254740992D"
    one = _hypergeometric("get(cells, j)", "a.pool", "a.need", u)
    return f"""aggregate(sequence(0, size(cells) - 1), named_struct('need', draws, 'pool', pool, 'out', cast(array() as array<bigint>)),
      (a, j) -> transform(array({one}), x -> named_struct('need', a.need - x, 'pool', a.pool - get(cells, j), 'out', array_append(a.out, x)))[0], a -> a.out)"""


def communication_matrix(counts: DataFrame, cells: list[int], seed: int = 0) -> DataFrame:
    """(source, sends array<bigint>) for counts (source int, n long): row sums are n, column sums are ``cells``."""
    parts = counts.count()
    nodes = counts.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("rows")).select(
        F.lit(0).alias("lo"),
        F.size("rows").alias("hi"),
        F.array(*[F.lit(int(c)).cast("bigint") for c in cells]).alias("cells"),
        F.transform("rows", lambda r: r["source"]).alias("ids"),
        F.expr("aggregate(rows, cast(array(0) as array<bigint>), (a, r) -> array_append(a, element_at(a, -1) + r.n))").alias("sums"),
    )
    for level in range(math.ceil(math.log2(parts)) if parts > 1 else 0):
        if level == 4:
            nodes = nodes.repartition(min(parts, 64), "lo")
        split = (
            nodes.withColumn("mid", F.expr("cast((lo + hi) div 2 as int)"))
            .withColumn("pool", F.expr("get(sums, hi) - get(sums, lo)"))
            .withColumn("draws", F.expr("get(sums, mid) - get(sums, lo)"))
            .withColumn("left", F.expr(f"IF(hi - lo > 1, {_vector_draw(seed)}, cells)"))
        )
        halves = """array(named_struct('lo', lo, 'hi', mid, 'cells', left),
          named_struct('lo', mid, 'hi', hi, 'cells', zip_with(cells, left, (c, l) -> c - l)))"""
        itself = "array(named_struct('lo', lo, 'hi', hi, 'cells', cells))"
        nodes = split.select("ids", "sums", F.explode(F.expr(f"IF(hi - lo > 1, {halves}, {itself})")).alias("node")).select("ids", "sums", "node.*")
    return nodes.where("hi > lo").select(F.expr("get(ids, lo)").alias("source"), F.col("cells").alias("sends"))


def uniform_shards(df: DataFrame, shards: int = 16, seed: int = 0, cell_rows: int = 200_000, most_cells: int = 1024, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), a uniform random permutation of its rows.

    Shard sizes differ by one at most. Nulls in any column and repeated rows are rows like others; ties cannot arise, as
    a row's random key comes from its place in the checkpoint. An empty table gives an empty result; columns of df named
    like a new one give way to it. Cells hold about ``cell_rows`` rows, more only beyond ``most_cells`` cells. The matrix has
    at most ``most_cells`` rows too: input in more partitions is written once more, in so many.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = [c for c in df.columns if c.lower() not in (shard_col.lower(), slot_col.lower())]
    # The rows travel as one column, so that none of their names can clash with those used here.
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = checkpointed(df.select(row.alias("row")))
    if rows.select(F.spark_partition_id().alias("part")).distinct().count() > most_cells:
        # Rows are read and made by as many tasks as they come in; only then are partitions laid together.
        rows = checkpointed(rows.coalesce(most_cells))
    fixed = rows.withColumn("__place", F.monotonically_increasing_id())
    opened = [F.col("row").getField(c).alias(c) for c in kept]
    # A local permutation needs no exchange: sort each partition by a random key and number its rows.
    placed = (
        fixed.withColumn("__key", F.xxhash64(F.lit(seed), "__place"))
        .sortWithinPartitions("__key", "__place")
        .withColumn("__pos", F.monotonically_increasing_id())
        .withColumn("__source", F.shiftright("__pos", _PART_BITS).cast("int"))
        .withColumn("__pos", F.col("__pos").bitwiseAND((1 << _PART_BITS) - 1))
    )
    counts = checkpointed(fixed.groupBy(F.shiftright("__place", _PART_BITS).cast("int").alias("source")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    per_shard = max(1, min(math.ceil(total / (shards * cell_rows)), max(1, most_cells // shards)))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    cells = [n // per_shard + (c < n % per_shard) for n in sizes for c in range(per_shard)]
    starts = [sum(cells[s * per_shard : s * per_shard + c]) for s in range(shards) for c in range(per_shard)]
    if not total:
        return fixed.select(*opened, F.lit(0).alias(shard_col), F.lit(0).cast("bigint").alias(slot_col))
    # Cut points: by shard, then within the shard by cell, so that a row compares with few of them.
    cuts = communication_matrix(counts, cells, seed).select(
        F.col("source").alias("__source"),
        F.expr(
            f"transform(sequence(0, {shards - 1}), s -> transform(sequence(0, {per_shard - 1}), c -> aggregate(slice(sends, 1, s * {per_shard} + c), 0L, (a, x) -> a + x)))"
        ).alias("__sends"),
    )
    cell = _cell_of(F.col("__pos"), per_shard)
    start = F.element_at(F.array(*[F.lit(int(x)).cast("bigint") for x in starts]), F.col("__cell") + 1)
    again = Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed + 1), "__place"), "__place")
    return (
        placed.join(cuts, "__source")
        .withColumn("__cell", cell)
        .withColumn(slot_col, start + F.row_number().over(again) - 1)
        .withColumn(shard_col, F.expr(f"cast(__cell div {per_shard} as int)"))
        .select(*opened, shard_col, slot_col)
    )


def _cell_of(pos: Column, per_shard: int) -> Column:
    """The last cell whose cut is not above pos; cells that get nothing share the cut of the next."""
    shard = F.size(F.filter("__sends", lambda s: s[0] <= pos)) - 1
    inner = F.get(F.col("__sends"), shard)
    return (shard * per_shard + F.size(F.filter(inner, lambda c: c <= pos)) - 1).cast(T.IntegerType())
