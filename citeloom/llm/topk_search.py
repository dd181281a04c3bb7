"""Exact top-k inner-product search with dual cover trees.

Vectors are turned into integers, floor(1024 * x) per component.  Queries are the rows whose vec_id is divisible by
``EVERY``.  The top level of the rows' cover tree is one for all: ``CELLS`` pivots, picked one by one as the farthest from
those before among a sample of at most ``SAMPLE`` rows; every row belongs to its nearest pivot's cell, and a cell's radius
covers all of its rows.  Cells of more than ``ROW_BLOCK`` rows are dealt into several blocks.  With centres c and radii r
that cover a node's points, no inner product between two nodes exceeds

    <cq, cr> + rq * |cr| + rr * |cq| + rq * rr.

First each query searches the cell that promises most, which gives it a kth score; then it is sent only to the blocks of
those cells whose bound is not below that score.  A task holds one block, builds its cover tree once, takes the
queries that were sent in groups of ``QUERY_BLOCK`` with a cover tree over each, and walks pairs of nodes from the top; a pair is
pruned once its bound is below the worst kth score of all queries under the query node.  Bounds carry a slack for rounding,
so ties are never lost; scores are exact (floats while they hold all integers, else Python's integers).  The k best of all
blocks are the result, ties to the smaller vec_id.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id.  Rows of a
query's vec_id are no candidates for it.  Repeated vec_ids as candidates each count.  Rows that share a query's vec_id are one
query: its list has the best scores of all of them, so a candidate can stand there once for each.  Vectors of another
length than the query give no score with it.  A component beyond 2**62 counts as that, and a score beyond 64 bits as the
nearest number that has 64.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import drop_stash, stash, tidy

K = 10
EVERY = 100
SCALE = 1024
CELLS, SAMPLE = 128, 20_000
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384
LEAF, QUERY_LEAF, FAN = 192, 48, 12
#: Share of the magnitudes by which a bound may be off through rounding (doubles have 53 bits; sums of many terms).
SLACK = 1e-9
LARGEST = 1 << 62
_NONE = np.iinfo(np.int64).min + 1  # its negative still fits


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond 64 bits count as the largest (or least) such number."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    for kind, exact in ((np.float32, 2**24), (np.float64, 2**53)):
        if bound < exact:  # every sum on the way is a whole number that the type holds
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63) + 2, 2**63 - 1).astype(np.int64)


class CoverTree:
    """Nested covers by distance: each node's points lie within its radius of its centre, which is one of them.

    A node's children are centred on points picked one by one, each the farthest from those before, until all points are
    within half of the node's radius of one (or ``FAN`` are picked); points go to the nearest centre.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        start = np.arange(len(points))
        d = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        stack = [(start, 0, d, -1)]
        while stack:
            members, centre, d, parent = stack.pop()
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(d.max()))
            self.children.append([])
            self.members.append(members)
            if parent >= 0:
                self.children[parent].append(node)
            if len(members) <= leaf or d.max() == 0:
                continue
            goal = d.max() / 2
            centres, nearest, which = [centre], d.copy(), np.zeros(len(members), np.int64)
            while nearest.max() > goal and len(centres) < FAN:
                new = int(members[nearest.argmax()])
                e = np.sqrt(((points[members] - points[new]) ** 2).sum(axis=1))
                closer = e < nearest
                which[closer], nearest = len(centres), np.minimum(nearest, e)
                centres.append(new)
            for k, c in enumerate(centres):
                own = which == k
                if own.any():
                    stack.append((members[own], c, nearest[own], node))
        self.centres = points[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.radii = np.array(self.radius)


def block_topk(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int = K, tree: CoverTree | None = None, least: np.ndarray | None = None, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (vec_id, score) of each query in this block; missing places have vec_id -1.

    ``tree`` is the rows' tree; scores below ``least`` are of no use to a query; ``scored`` is told the pairs worked out.
    """
    qt, rt = CoverTree(queries.astype(np.float64), QUERY_LEAF), tree or CoverTree(rows.astype(np.float64))
    ids = np.full((len(queries), k), -1, np.int64)
    scores = np.full((len(queries), k), _NONE, np.int64)
    floor = np.full(len(queries), -np.inf) if least is None else np.where(least == _NONE, -np.inf, least.astype(np.float64))
    worst = floor.copy()

    def bound(q: int, rs: list[int]) -> np.ndarray:
        size = (qt.norms[q] + qt.radii[q]) * (rt.norms[rs] + rt.radii[rs])
        return rt.centres[rs] @ qt.centres[q] + qt.radii[q] * rt.norms[rs] + rt.radii[rs] * qt.norms[q] + qt.radii[q] * rt.radii[rs] + SLACK * size + 1.0

    def leaf(q: int, r: int) -> None:
        qi, ri = qt.members[q], rt.members[r]
        if scored is not None:
            scored.append(len(qi) * len(ri))
        got = products(queries[qi], rows[ri])
        got = np.where(row_ids[ri][None, :] == query_ids[qi][:, None], _NONE, got)  # a query's own rows
        # doubles of scores beyond 2**53 may be off by a little
        some = np.flatnonzero((got >= worst[qi][:, None] - 1e-12 * np.abs(worst[qi][:, None])).any(axis=0)) if np.isfinite(worst[qi]).all() else np.arange(len(ri))
        if not len(some):
            return
        # the group's best so far and what is new, best first, ties to the smaller id
        all_scores = np.concatenate([scores[qi], got[:, some]], axis=1)
        all_ids = np.concatenate([ids[qi], np.broadcast_to(row_ids[ri][some], (len(qi), len(some)))], axis=1)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        scores[qi], ids[qi] = np.take_along_axis(all_scores, best, axis=1), np.take_along_axis(all_ids, best, axis=1)
        ids[qi] = np.where(scores[qi] == _NONE, -1, ids[qi])
        worst[qi] = np.maximum(floor[qi], np.where(scores[qi, k - 1] == _NONE, -np.inf, scores[qi, k - 1]))

    stack = [(0, 0, float(bound(0, [0])[0]))]
    while stack:
        q, r, most = stack.pop()
        if most < worst[qt.members[q]].min():
            continue
        deeper_q, deeper_r = qt.children[q], rt.children[r]
        if not deeper_q and not deeper_r:
            leaf(q, r)
        elif deeper_q and (not deeper_r or qt.radii[q] > rt.radii[r]):
            stack += [(c, r, float(bound(c, [r])[0])) for c in deeper_q]
        else:
            b = bound(q, deeper_r)
            # the most promising is walked first, so that later ones are pruned
            stack += [(q, deeper_r[j], float(b[j])) for j in np.argsort(b)]
    return ids, scores


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer components, valid rows only."""
    xs = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False)))
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(xs, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")).alias("v"))


def pivots(rows: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """By vector length, the pivots among the sample: the ``SAMPLE`` rows of least hash, fewer if there are fewer."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    out = {}
    for dim in sorted({len(v) for v in sample}):
        points = np.array([v for v in sample if len(v) == dim], np.float64)
        picks, nearest = [], np.full(len(points), np.inf)
        while len(picks) < cells and (not picks or nearest.max() > 0):
            picks.append(int(nearest.argmax()) if picks else int(np.linalg.norm(points - points.mean(axis=0), axis=1).argmin()))
            nearest = np.minimum(nearest, np.linalg.norm(points - points[picks[-1]], axis=1))
        out[dim] = points[picks]
    return out


def vectors_by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By vector length: the rows of a batch, and their components."""
    flat = batch.column("v")
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
    dims = np.diff(ends)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, values[ends[rows][:, None] + np.arange(dim)]


def in_cells(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (the nearest pivot; -1 where a length has none), far (its distance) and deal (a number of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() << 36
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim, at, v in vectors_by_length(batch):
                if dim in centres:
                    c = centres[dim]
                    near = (v.astype(np.float64) @ c.T * -2 + (c * c).sum(axis=1)).argmin(axis=1)
                    cell[at], far[at] = near, np.linalg.norm(v - c[near], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell), pa.array(far), pa.array(deal + np.arange(batch.num_rows))], names=["vec_id", "v", "cell", "far", "deal"])
            deal += batch.num_rows

    return rows.select("vec_id", "v").mapInArrow(tidy(run), "vec_id long, v array<long>, cell int, far double, deal long")


def _search(sent: DataFrame, placed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """deal, query_id, vec_id, score: the k best of each query in each block of the cells that it is sent to.

    ``sent`` has deal, vec_id, v, own (the query's own cell), dim, cell and least; ``blocks`` the number of blocks of each (dim, cell).
    """
    at = ["dim", "cell", "block"]
    kinds = [*at, "is_query", "own", "deal", "vec_id", "least", "v"]
    rows = placed.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod("deal", F.col("blocks"))).withColumn("is_query", F.lit(False)).withColumn("own", F.lit(0)).withColumn("least", F.lit(0).cast("long"))
    asked = sent.join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("is_query", F.lit(True))
    grouped = rows.select(*kinds).union(asked.select(*kinds)).repartition(*at).sortWithinPartitions(*at, "is_query", "own", "deal")  # queries of one cell stand together
    schema = pa.schema([("deal", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal tree
            if not held[True] or not held[False]:
                held[True] = []
                return
            if len(held[False]) > 1:
                held[False] = [tuple(np.concatenate(x) for x in zip(*held[False], strict=True))]
            row_ids, rows_, *_ = held[False][0]
            tree = tree or CoverTree(rows_.astype(np.float64))
            ids, vectors, deal, least = (np.concatenate(x) for x in zip(*held[True], strict=True))
            best, scores = block_topk(ids, vectors, row_ids, rows_, k, tree, least)
            there = best >= 0
            times = there.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(deal, times)), pa.array(np.repeat(ids, times)), pa.array(best[there]), pa.array(scores[there])], schema=schema)
            held[True] = []

        for batch in batches:
            dims, cells, block, is_query, deal, ids, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "block", "is_query", "deal", "vec_id", "least"))
            v = batch.column("v")
            ends, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            new = (np.diff(dims) != 0) | (np.diff(cells) != 0) | (np.diff(block) != 0) | (is_query[1:] != is_query[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = (int(dims[a]), int(cells[a]), int(block[a]))
                if own != key:
                    yield from found()
                    key, tree, held = own, None, {False: [], True: []}
                for lo in range(a, b, QUERY_BLOCK):
                    hi = min(lo + QUERY_BLOCK, b)
                    held[bool(is_query[a])].append((ids[lo:hi], values[ends[lo] : ends[hi]].reshape(hi - lo, own[0]), deal[lo:hi], least[lo:hi]))
                    if is_query[a] and sum(len(x[0]) for x in held[True]) >= QUERY_BLOCK:
                        yield from found()
        yield from found()

    return grouped.mapInArrow(tidy(run), "deal long, query_id long, vec_id long, score long")


def topk(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    rows = stash(quantized(vectors), "topk-vectors")
    centres = pivots(rows)
    placed = stash(in_cells(rows, centres).withColumn("dim", F.size("v")), "topk-cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    blocks = stash(sizes.select("dim", "cell", "n", "radius", F.ceil(F.col("n") / ROW_BLOCK).cast("long").alias("blocks")), "topk-blocks")
    # at most CELLS rows for each length of the sample
    radius = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in blocks.where("cell >= 0").collect()}
    count = blocks.select("dim", "cell", "blocks")
    # NumPy arrays by length: cells that have rows, their centres, sizes and radii
    known = {dim: [c for c in range(len(p)) if (dim, c) in radius] for dim, p in centres.items()}

    def bounds(dim: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = known[dim]
        c, r = centres[dim][own], np.array([radius[dim, x][1] for x in own])
        size = np.linalg.norm(v, axis=1)[:, None]
        product = v.astype(np.float64) @ c.T
        return product, product + r * size + SLACK * size * (np.linalg.norm(c, axis=1) + r) + 1.0

    def send(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, where = [], []
                least = np.full(batch.num_rows, _NONE) if first else batch.column("least").to_numpy(zero_copy_only=False)
                for dim, at, v in vectors_by_length(batch):
                    own = np.array(known.get(dim, []), np.int64)
                    if not len(own):
                        if first:  # a length without pivots has one cell
                            who.append(at)
                            where.append(np.full(len(at), -1))
                        continue
                    product, most = bounds(dim, v)
                    # the first search is in the cell of the best centre among those with enough rows
                    large = np.array([radius[dim, c][0] > k for c in own])
                    home = np.where(large, product, -np.inf).argmax(axis=1) if large.any() else most.argmax(axis=1)
                    if first:
                        who.append(at)
                        where.append(own[home])
                    else:
                        go = most >= np.where(least[at] == _NONE, -np.inf, least[at])[:, None]
                        go[np.arange(len(at)), home] = False
                        i, j = np.nonzero(go)
                        who.append(at[i])
                        where.append(own[j])
                for i in range(0, len(who)):
                    part = batch.take(pa.array(who[i]))
                    yield pa.RecordBatch.from_arrays([part.column("deal"), part.column("vec_id"), part.column("v"), part.column("own"), pa.array(where[i].astype(np.int32)), pa.array(least[who[i]])], names=["deal", "vec_id", "v", "own", "cell", "least"])

        return run

    kind = "deal long, vec_id long, v array<long>, own int, cell int, least long"
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("cell", "own")
    to = queries.select("deal", "vec_id", "v", "own").mapInArrow(tidy(send(True)), kind).withColumn("dim", F.size("v"))
    home = stash(_search(to, placed, count, k), "topk-first")
    by_query = Window.partitionBy("deal").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("n", F.row_number().over(by_query)).where(F.col("n") == k).select(F.col("deal").alias("of"), F.col("score").alias("least"))
    told = queries.join(kth, F.col("deal") == F.col("of"), "left").select("deal", "vec_id", "v", "own", F.coalesce("least", F.lit(_NONE)).alias("least"))
    to = stash(told.mapInArrow(tidy(send(False)), kind).withColumn("dim", F.size("v")), "topk-sent")
    found = home.union(_search(to, placed, count, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = stash(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk-result")
    drop_stash(rows, placed, blocks, home, to)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
