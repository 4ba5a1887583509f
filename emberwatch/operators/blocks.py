"""Greedy, non-overlapping choice of spans per key, with hot keys cut into blocks of rows.

Keys with at most BLOCK_ROWS rows are dealt by hash and solved whole by a kernel. Larger ones are
measured first. Their rows are cut by count, in order of time, into blocks; a block also gets the
rows of one window beyond it, so that every match that starts in it can be seen. How the choice
goes on in a block depends on where the choice before it ended, so

1. each block is solved for every possible entry at once: a map from the position at which the
   choice enters to the one at which it leaves, with one piece per different outcome;
2. maps of FAN consecutive blocks are composed into one, and these again, up to one per key;
3. entries come down the same tree: the parent's entry goes through its children's maps;
4. each block is solved again for its one real entry.

Each level is a grouping by key and parent, so no task reads more than FAN maps, and a key with
all rows of the table is worked on by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators import kernels as K
from emberwatch.operators.staging import staged
from emberwatch.packaging import ship

#: Keys with more rows are cut. A block holds so many rows, or a window's if that is more.
BLOCK_ROWS = 250_000
#: Maps that are composed at a time.
FAN = 16

KEY = K.KEY
Kernel = Callable[[pa.Table], K.Found]
_MAP = "rule_id string, entity_key string, node bigint, hi_t bigint, hi_tie bigint, out_t bigint, out_tie bigint"
_ENTRY = "rule_id string, entity_key string, node bigint, b_t bigint, b_tie bigint"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def hot_keys(rows: DataFrame) -> DataFrame | None:
    """Keys with more rows than one task should take; None if there are none. Reads only the key columns."""
    sizes = rows.groupBy(*KEY).count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= BLOCK_ROWS:
        return None
    return staged(sizes.where(F.col("count") > BLOCK_ROWS).select(*KEY))


def solve(
    rows: DataFrame, kernel: Kernel, ddl: str, order: list[str], hot: DataFrame | None = None,
    before: bool = False, merged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """What the kernel puts out for the greedy choice among its candidates, per key.

    `rows` have rule_id, entity_key, w, t and what the kernel reads; `order` puts them in order.
    `hot` names the keys that are cut into blocks. A kernel looks one window ahead, or back if
    `before`. `merged` sums rows of one time before hot keys are cut.
    """
    ship(rows.sparkSession)
    if hot is None:
        return _whole_keys(rows, kernel, ddl, order)
    cold = _whole_keys(rows.join(hot, KEY, "left_anti"), kernel, ddl, order)
    warm = rows.join(hot, KEY, "left_semi")
    return cold.unionByName(_in_blocks(merged(warm) if merged else warm, kernel, ddl, order, before))


def grouped(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a group in one partition, groups and rows in order.

    Dealt by a hash of the keys, not by the keys: Spark leaves a repartition by the keys of a join
    out, and may then change the join to one that does not deal rows by them.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _whole_keys(rows: DataFrame, kernel: Kernel, ddl: str, order: list[str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, KEY):
            found = kernel(table)
            every = np.arange(len(found.rows))
            yield from found.output(K.chain(found.among(every))).to_batches()

    return grouped(rows, KEY, order).mapInArrow(task, ddl)


def _in_blocks(rows: DataFrame, kernel: Kernel, ddl: str, order: list[str], before: bool) -> DataFrame:
    spark = rows.sparkSession
    rows = staged(rows)
    if rows.isEmpty():
        return spark.createDataFrame([], ddl)
    window = F.floor(F.col("t") / F.col("w"))
    densest = rows.groupBy(*KEY, window.alias("_c")).count().agg(F.max("count")).first()[0]
    blocks = -(-rows.count() // max(BLOCK_ROWS, densest))
    # by time and tie only: rows of one position stay together
    dealt = staged(
        rows.repartitionByRange(blocks, *KEY, *order[:2]).withColumn("block", F.spark_partition_id())
    )
    pieces, most = _pieces(dealt)
    placed = _with_halo(dealt, pieces, before)
    columns = rows.columns
    maps = staged(
        grouped(placed, [*KEY, "node"], order).mapInArrow(_local_maps(kernel, columns), _MAP)
    )
    entries = _entries(maps, pieces.select(*KEY).distinct(), most)
    entered = placed.join(entries, [*KEY, "node"])
    return grouped(entered, [*KEY, "node"], order).mapInArrow(_chosen(kernel, columns), ddl)


def _pieces(dealt: DataFrame) -> tuple[DataFrame, int]:
    """One row per key and block, numbered per key (node) in order; and the most blocks of a key."""
    found = dealt.groupBy(*KEY, "block").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("w").alias("w")
    )
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("block")) - 1
    pieces = staged(found.withColumn("node", number.cast("bigint")))
    return pieces, pieces.agg(F.max("node")).first()[0] + 1


def _with_halo(dealt: DataFrame, pieces: DataFrame, before: bool) -> DataFrame:
    """Rows with their node and `own`; rows of one window beyond a node's rows come with own false."""
    in_order = Window.partitionBy(*KEY).orderBy("node")
    see = F.lag if before else F.lead
    edge, far = ("last_t", F.col("first_t") - F.col("w")) if before else ("first_t", F.col("last_t") + F.col("w"))

    def reaches(n: int):
        other = see(edge, n).over(in_order)
        return other >= far if before else other <= far

    n = 1  # how many neighbouring blocks a window can reach into
    while not pieces.select(reaches(n).alias("more")).where("more").isEmpty():
        n *= 2
    wanted = F.array(*(F.when(reaches(k), see("block", k).over(in_order)) for k in range(1, n)))
    halo = (
        pieces.select(*KEY, "node", far.alias("far"), (wanted if n > 1 else F.array().cast("array<int>")).alias("from"))
        .select(*KEY, "node", "far", F.explode(F.filter("from", lambda b: b.isNotNull())).alias("block"))
    )
    beyond = dealt.join(halo, [*KEY, "block"]).where(F.col("t") >= F.col("far") if before else F.col("t") <= F.col("far"))
    own = dealt.join(pieces.select(*KEY, "block", "node"), [*KEY, "block"])
    columns = [c for c in dealt.columns if c != "block"]
    return own.select(*columns, "node", F.lit(True).alias("own")).unionByName(
        beyond.select(*columns, "node", F.lit(False).alias("own"))
    )


def _own(table: pa.Table, found: K.Found) -> np.ndarray:
    return np.flatnonzero(table.column("own").to_numpy()[found.rows])


def _local_maps(kernel: Kernel, columns: list[str]):
    """Per block: for entries below each candidate's start, where the choice leaves the block.

    Entries from the last start on take nothing and go through unchanged.
    """
    schema = _arrow(_MAP)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, [*KEY, "node"], rows=1):
            for part in _split(table):
                found = kernel(part.select(columns))
                own = _own(part, found)
                if not len(own):
                    continue
                last = own[K.chain_ends(found.among(own))]
                out = found.end[0][last], found.end[1][last]
                differs = np.append((np.diff(out[0]) != 0) | (np.diff(out[1]) != 0), True)
                hi = found.start[0][own], found.start[1][own]
                n = int(differs.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(k)[0].as_py()] * n, schema.field(k).type) for k in (*KEY, "node")]
                    + [pa.array(x[differs], pa.int64()) for x in (*hi, *out)],
                    schema=schema,
                )

    return task


def _split(table: pa.Table) -> Iterator[pa.Table]:
    """The groups of a table, one at a time."""
    edges = [*np.flatnonzero(K.group_starts(table, [*KEY, "node"])).tolist(), len(table)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield table.slice(a, b - a).combine_chunks()


def _chosen(kernel: Kernel, columns: list[str]):
    """Per block: what the kernel puts out for the choice from the block's entry on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, [*KEY, "node"], rows=1):
            for part in _split(table):
                found = kernel(part.select(columns))
                own = _own(part, found)
                first = found.first_after(own, part.column("b_t")[0].as_py(), part.column("b_tie")[0].as_py())
                yield from found.output(own[K.chain(found.among(own), first)]).to_batches()

    return task


class _Ranks:
    """Positions (time, tie) as places in their common order."""

    def __init__(self, *positions: tuple[np.ndarray, np.ndarray]) -> None:
        t, tie = (np.concatenate([np.asarray(p[i], dtype=np.int64) for p in positions]) for i in (0, 1))
        order = np.lexsort((tie, t))
        t, tie = t[order], tie[order]
        fresh = np.ones(len(t), dtype=bool)
        fresh[1:] = (np.diff(t) != 0) | (np.diff(tie) != 0)
        rank = np.empty(len(t), dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        self.t, self.tie = t[fresh], tie[fresh]
        self.of = np.split(rank, np.cumsum([len(p[0]) for p in positions])[:-1])


def through(hi: np.ndarray, out: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Where entries leave: the outcome of the first bound above each; unchanged beyond the last."""
    place = np.searchsorted(hi, entry, side="right")
    return np.where(place < len(hi), out[np.minimum(place, len(hi) - 1)], entry) if len(hi) else entry


def composed(maps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One map that does what the maps do one after the other; equal outcomes side by side are joined."""
    hi, out = maps[0]
    for next_hi, next_out in maps[1:]:
        beyond = next_hi > hi[-1] if len(hi) else np.ones(len(next_hi), dtype=bool)
        hi, out = np.append(hi, next_hi[beyond]), np.append(through(next_hi, next_out, out), next_out[beyond])
        keep = np.append(np.diff(out) != 0, True)[: len(out)]
        hi, out = hi[keep], out[keep]
    return hi, out


def _ranked(maps: pa.Table, *entry: tuple) -> tuple[list[tuple], _Ranks]:
    """Maps of a group by node, in order, on common ranks. Nodes without rows change nothing."""
    maps = maps.sort_by([(c, "ascending") for c in ("node", "hi_t", "hi_tie")])
    get = lambda c: maps.column(c).to_numpy()
    ranks = _Ranks((get("hi_t"), get("hi_tie")), (get("out_t"), get("out_tie")), *entry)
    node = get("node")
    cuts = np.flatnonzero(np.diff(node)) + 1
    hi, out = (np.split(x, cuts) for x in ranks.of[:2])
    nodes = [int(x[0]) for x in np.split(node, cuts) if len(x)]
    return list(zip(nodes, hi, out, strict=False)), ranks


def _up(maps: DataFrame) -> DataFrame:
    """Maps of parents of up to FAN nodes."""
    schema = _arrow(_MAP)

    def task(table: pa.Table) -> pa.Table:
        nodes, ranks = _ranked(table)
        hi, out = composed([(h, o) for _, h, o in nodes])
        about = [[table.column(k)[0].as_py()] * len(hi) for k in KEY]
        return pa.table(
            [*about, [nodes[0][0] // FAN] * len(hi), ranks.t[hi], ranks.tie[hi], ranks.t[out], ranks.tie[out]], schema=schema
        )

    parent = F.floor(F.col("node") / FAN).alias("parent")
    return maps.groupBy(*KEY, parent).applyInArrow(task, _MAP)


def _down(entries: DataFrame, maps: DataFrame) -> DataFrame:
    """Entries of the FAN children of every node that has one."""
    schema = _arrow(_ENTRY)

    def task(parent: pa.Table, children: pa.Table) -> pa.Table:
        if not parent.num_rows:
            return schema.empty_table()
        above = parent.column("node")[0].as_py()
        at = tuple(np.array([parent.column(c)[0].as_py()]) for c in ("b_t", "b_tie"))
        nodes, ranks = _ranked(children, at)
        by_node = {n: (h, o) for n, h, o in nodes}
        entry, found = ranks.of[2], []
        for node in range(above * FAN, (above + 1) * FAN):
            found.append(int(entry[0]))
            if node in by_node:
                entry = through(*by_node[node], entry)
        about = [[parent.column(k)[0].as_py()] * FAN for k in KEY]
        return pa.table([*about, list(range(above * FAN, (above + 1) * FAN)), ranks.t[found], ranks.tie[found]], schema=schema)

    parent = F.floor(F.col("node") / FAN).alias("parent")
    left = entries.groupBy(*KEY, F.col("node").alias("parent"))
    return left.cogroup(maps.groupBy(*KEY, parent)).applyInArrow(task, _ENTRY)


def _entries(maps: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """The position at which the choice enters each node, by a tree over `most` nodes at most."""
    levels = [maps]
    while most > FAN:
        levels.append(staged(_up(levels[-1])))
        most = -(-most // FAN)
    lowest = F.lit(K.LOWEST).cast("bigint")
    entries = keys.select(*KEY, F.lit(0).cast("bigint").alias("node"), lowest.alias("b_t"), lowest.alias("b_tie"))
    for level in reversed(levels):
        entries = _down(entries, level)
    return entries
