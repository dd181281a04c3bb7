"""Hard negatives by vantage-point trees over norm-augmented vectors.

Components become floor(256 * x); a row's score with an anchor is their integer inner product.  An anchor's positives are the
``POSITIVES`` best other rows of its label; for each of them the ``NEGATIVES`` best rows of other labels are mined whose score
s is in the window 80 * p <= 100 * s <= 100 * p of the positive's score p.

With M the largest length, a row x becomes (x, sqrt(M² - |x|²)) and an anchor q becomes (q, 0), so their squared distance is
|q|² + M² - 2 * score: the best scores are the nearest rows, and a window of scores is an annulus of distances.

* Top of the tree: vantage points from a sample (``SAMPLE`` rows and ``SAMPLE_BYTES`` at most) halve the rows level by level into
  cells of about a block; every row is placed, and a cell keeps the least and largest distance of its rows to each vantage
  point above it.  Between them lie bounds on every score of an anchor in the cell.
* The sample also gives each anchor a first kth score (positives) and a first kth score in each window (negatives), so it is sent
  only to the cells that can do better and, for negatives, that meet the annulus.
* A task holds one block (``BLOCK_BYTES`` at most; larger cells have several), builds its tree once and takes anchors in groups.  Each
  anchor walks the leaves nearest first, inside its annulus, and ends at the first leaf that cannot hold a better row than
  its kth; anchors that are at one leaf are scored together.
* The best of all blocks are the result; ties go to the smaller vec_id.  Bounds carry a slack for rounding, so none is lost.

Rows take no part whose label, vec_id or vector is null, or whose vector is empty or holds a null or non-finite component.
Rows with the anchor's vec_id are not "other" rows.  Repeated vec_ids each count, as anchors and as candidates.  Vectors of
another length give no score with an anchor.  A component beyond 2**62 counts as that, and a score beyond 64 bits as
the nearest number that has 64.  An anchor without positives, and a positive without a row in its window, give
no rows.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import drop_stash, stash, tidy
from citeloom.llm.topk_search import products, vectors_by_length

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 5
SAMPLE, SAMPLE_BYTES = 4096, 1 << 24
BLOCK_BYTES, BLOCK_ROWS = 1 << 23, 16_384
LEVELS, LEAF, ANCHORS = 8, 512, 1024
#: Share of the magnitudes by which a bound may be off through rounding.
SLACK = 1e-9
LARGEST = 1 << 62
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def _augmented(rows: np.ndarray, most: float) -> np.ndarray:
    v = rows.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))[:, None]], axis=1)


class VantageTree:
    """Rows halved by their distance to a vantage point, again and again; ``paths`` has (vantage point, least, largest
    distance) of each point above a leaf."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF, levels: int = 64, most: float | None = None):
        self.most = float((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) if most is None else most
        points = _augmented(rows, self.most)
        self.vantage: list[np.ndarray] = []
        self.cuts: list[tuple[int, float, int, int]] = []  # of each inner node: vantage point, distance that halves, the two children (leaves: -1 - number)
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        self.root = self._grow(points, np.arange(len(points)), [], leaf, levels) if len(points) else None

    def _grow(self, points: np.ndarray, members: np.ndarray, path: list, leaf: int, levels: int) -> int:
        if len(members) > leaf and levels > 0:
            # a vantage point at the rim parts the rows best
            far = np.linalg.norm(points[members] - points[members].mean(axis=0), axis=1)
            vantage = points[members[far.argmax()]]
            d = np.linalg.norm(points[members] - vantage, axis=1)
            cut = float(np.partition(d, len(d) // 2)[len(d) // 2])
            near = d < cut
            if near.any():
                k, node = len(self.vantage), len(self.cuts)
                self.vantage.append(vantage)
                self.cuts.append((k, cut, 0, 0))
                ends = [self._grow(points, members[own], [*path, (k, float(d[own].min()), float(d[own].max()))], leaf, levels - 1) for own in (near, ~near)]
                self.cuts[node] = (k, cut, *ends)
                return node
        self.leaves.append(members)
        self.paths.append(path)
        return -len(self.leaves)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[dict[int, np.ndarray]]]:
        """The leaf of each row, and by leaf the distances of its rows to the vantage points above."""
        points = _augmented(rows, self.most)
        which = np.zeros(len(rows), np.int64)
        seen: list[dict[int, np.ndarray]] = [{} for _ in self.leaves]
        stack = [(self.root, np.arange(len(rows)), {})]
        while stack:
            node, at, far = stack.pop()
            if node < 0:
                which[at], seen[-1 - node] = -1 - node, far
                continue
            k, cut, near, rest = self.cuts[node]
            d = np.linalg.norm(points[at] - self.vantage[k], axis=1)
            for child, own in ((near, d < cut), (rest, d >= cut)):
                stack.append((child, at[own], {**{p: x[own] for p, x in far.items()}, k: d[own]}))
        return which, seen


def score_bounds(anchors: np.ndarray, vantage: list[np.ndarray], most: float, paths: list[list[tuple[int, float, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score that each anchor can have with rows below each path."""
    q = anchors.astype(np.float64)
    size = (q * q).sum(axis=1)
    near, far = np.zeros((len(q), len(paths))), np.full((len(q), len(paths)), np.inf)
    d: dict[int, np.ndarray] = {}
    for j, path in enumerate(paths):
        for k, least, largest in path:
            if k not in d:
                d[k] = np.linalg.norm(np.concatenate([q, np.zeros((len(q), 1))], axis=1) - vantage[k], axis=1)
            near[:, j] = np.maximum(near[:, j], np.maximum(d[k] - largest, least - d[k]))
            far[:, j] = np.minimum(far[:, j], d[k] + largest)
    slack = (SLACK * (size + most + 1.0) + 1.0)[:, None]
    # nothing is farther than twice the larger sphere
    far = np.minimum(far, (np.sqrt(size) + np.sqrt(most))[:, None])
    both = (size + most)[:, None]
    return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


class Block:
    """Rows (ids, labels, vectors) under a vantage-point tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.tree = VantageTree(rows, leaf)
        order = np.concatenate(self.tree.leaves)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.ends = np.cumsum([0, *map(len, self.tree.leaves)])

    def best(self, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, same: bool, k: int, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores (n x k; ``_NONE`` where there is none) of the best rows of the anchor's label (``same``) or of
        others, with a score from ``low`` to ``high``; those below ``least`` are of no use."""
        smallest, largest = score_bounds(anchors, self.tree.vantage, self.tree.most, self.tree.paths)
        floor = np.maximum(low, least)
        found, scores = np.full((len(anchors), k), -1, np.int64), np.full((len(anchors), k), _NONE, np.int64)
        largest = np.where((smallest > high[:, None]) | (largest < floor[:, None]), -np.inf, largest)
        order = np.argsort(-largest, axis=1, kind="stable")  # nearest leaves first
        alive = np.arange(len(anchors))
        for turn in range(order.shape[1]):
            leaf = order[alive, turn]
            worst = np.maximum(scores[alive, k - 1], floor[alive])
            reach = largest[alive, leaf]
            go = (reach > -np.inf) & (reach >= worst)
            alive, leaf = alive[go], leaf[go]
            if not len(alive):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for q in np.split(alive[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                j = int(order[q[0], turn])
                a, b = self.ends[j], self.ends[j + 1]
                got = products(anchors[q], self.rows[a:b])
                if scored is not None:
                    scored.append(got.size)
                fits = ((self.labels[a:b] == labels[q][:, None]) == same) & (self.ids[a:b] != ids[q][:, None]) & (got <= high[q][:, None]) & (got >= np.maximum(scores[q, k - 1], floor[q])[:, None])
                some = np.flatnonzero(fits.any(axis=0))
                if not len(some):
                    continue
                all_scores = np.concatenate([scores[q], np.where(fits[:, some], got[:, some], _NONE)], axis=1)
                all_ids = np.concatenate([found[q], np.broadcast_to(self.ids[a:b][some], (len(q), len(some)))], axis=1)
                pick = np.lexsort((all_ids, all_scores == _NONE, -np.maximum(all_scores, _NONE + 1)), axis=1)[:, :k]
                scores[q], found[q] = np.take_along_axis(all_scores, pick, axis=1), np.take_along_axis(all_ids, pick, axis=1)
        return found, scores


# ---------------------------------------------------------------- rows, cells and blocks

def labelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components, of rows that take part."""
    xs = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    whole = F.transform(xs, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def block_rows(dim: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))


def sampled(rows: DataFrame, dim: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length, ids, labels and vectors of the rows of least hash."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).toPandas()
    lengths = some["v"].map(len)
    return {d: (part["vec_id"].to_numpy(), part["label"].to_numpy(), np.array(part["v"].tolist(), np.int64)) for d, part in some.groupby(lengths)}


_PLACED = "vec_id long, label long, v array<long>, dim int, cell int, far array<double>, deal long"


def in_cells(rows: DataFrame, tops: dict[int, VantageTree]) -> DataFrame:
    """Adds dim, cell (-1 for a length without a tree), far (distances to the vantage points above) and deal (a number of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId() << 36
        for batch in batches:
            dims, cell = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32)
            far: list[list[float]] = [[] for _ in range(batch.num_rows)]
            for dim, at, v in vectors_by_length(batch):
                dims[at] = dim
                if dim in tops:
                    which, seen = tops[dim].place(v)
                    cell[at] = which
                    for c, (path, d) in enumerate(zip(tops[dim].paths, seen, strict=True)):
                        if path and len(own := at[which == c]):
                            for i, row in zip(own.tolist(), np.stack([d[k] for k, _, _ in path], axis=1).tolist(), strict=True):
                                far[i] = row
            columns = [pa.array(dims), pa.array(cell), pa.array(far, pa.list_(pa.float64())), pa.array(deal + np.arange(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *columns], names=["vec_id", "label", "v", "dim", "cell", "far", "deal"])
            deal += batch.num_rows

    return rows.select("vec_id", "label", "v").mapInArrow(tidy(run), _PLACED)


class Top:
    """What tasks know of the cells of one vector length: paths with the distances of all rows, and the sample."""

    def __init__(self, tree: VantageTree, cells: dict[int, tuple[list[float], list[float]]], sample: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.cells = np.array(sorted(cells), np.int64)
        self.vantage, self.most, self.sample = tree.vantage, tree.most, sample
        self.paths = [[(k, least, largest) for (k, _, _), least, largest in zip(tree.paths[c], *cells[c], strict=True)] for c in self.cells.tolist()]

    def cells_for(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which cells can hold a score from ``low`` to ``high`` of each anchor."""
        smallest, largest = score_bounds(anchors, self.vantage, self.most, self.paths)
        return (largest >= low[:, None]) & (smallest <= high[:, None])


_SENT = "deal long, vec_id long, label long, v array<long>, dim int, cell int, place int, low long, high long, least long"
_SENT_NAMES = ["deal", "vec_id", "label", "v", "dim", "cell", "place", "low", "high", "least"]


def send(anchors: DataFrame, tops: dict[int, Top], same: bool, k: int) -> DataFrame:
    """The anchors (deal, vec_id, label, v, place, low, high), once for each cell that can hold one of their best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lows, highs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "low", "high"))
            for dim, at, v in vectors_by_length(batch):
                if dim in tops:
                    top, least = tops[dim], []
                    block = Block(*top.sample)
                    for i in range(0, len(at), ANCHORS):
                        own, part = at[i : i + ANCHORS], v[i : i + ANCHORS]
                        least.append(block.best(ids[own], labels[own], part, lows[own], highs[own], np.full(len(own), _NONE), same, k)[1][:, k - 1])
                    least = np.concatenate(least)
                    who, where = np.nonzero(top.cells_for(v, np.maximum(lows[at], least), highs[at]))
                    where = top.cells[where]
                else:
                    least = np.full(len(at), _NONE)
                    who, where = np.arange(len(at)), np.full(len(at), -1)
                part = batch.take(pa.array(at[who]))
                columns = [part.column("deal"), part.column("vec_id"), part.column("label"), part.column("v"), pa.array(np.full(len(who), dim, np.int32)), pa.array(where.astype(np.int32)), part.column("place"), part.column("low"), part.column("high"), pa.array(least[who])]
                yield pa.RecordBatch.from_arrays(columns, names=_SENT_NAMES)

    return anchors.select("deal", "vec_id", "label", "v", "place", "low", "high").mapInArrow(tidy(run), _SENT)


def visit(sent: DataFrame, placed: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """deal, place, vec_id, score: the k best of each sent anchor in each block of the cells it is sent to."""
    at = ["dim", "cell", "block"]
    kinds = [*at, "is_anchor", "deal", "vec_id", "label", "v", "place", "low", "high", "least"]
    nothing = {"place": F.lit(0), "low": F.lit(0).cast("long"), "high": F.lit(0).cast("long"), "least": F.lit(0).cast("long")}
    rows = placed.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod("deal", F.col("blocks"))).withColumn("is_anchor", F.lit(False)).withColumns(nothing)
    asked = sent.join(blocks, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("is_anchor", F.lit(True))
    grouped = rows.select(*kinds).union(asked.select(*kinds)).repartition(*at).sortWithinPartitions(*at, "is_anchor", "deal", "place")
    schema = pa.schema([("deal", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if held[True] and (block or held[False]):
                if block is None:
                    _, ids, labels, v, *_ = (np.concatenate(x) for x in zip(*held[False], strict=True))
                    block, held[False] = Block(ids, labels, v), []
                deal, ids, labels, v, place, low, high, least = (np.concatenate(x) for x in zip(*held[True], strict=True))
                best, scores = block.best(ids, labels, v, low, high, least, same, k)
                there = scores != _NONE
                times = there.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(deal, times)), pa.array(np.repeat(place, times)), pa.array(best[there]), pa.array(scores[there])], schema=schema)
            held[True] = []

        for batch in batches:
            if not batch.num_rows:
                continue
            dims, cells, own_block, is_anchor, *plain = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "block", "is_anchor", "deal", "vec_id", "label", "place", "low", "high", "least"))
            v = batch.column("v")
            ends, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            new = (np.diff(dims) != 0) | (np.diff(cells) != 0) | (np.diff(own_block) != 0) | (is_anchor[1:] != is_anchor[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = (int(dims[a]), int(cells[a]), int(own_block[a]))
                if own != key:
                    yield from found()
                    key, block, held = own, None, {False: [], True: []}
                for lo in range(a, b, ANCHORS):
                    hi = min(lo + ANCHORS, b)
                    deal, ids, labels, *rest = (x[lo:hi] for x in plain)
                    held[bool(is_anchor[a])].append((deal, ids, labels, values[ends[lo] : ends[hi]].reshape(hi - lo, own[0]), *rest))
                    if is_anchor[a] and sum(len(x[0]) for x in held[True]) >= ANCHORS:
                        yield from found()
        yield from found()

    return grouped.mapInArrow(tidy(run), "deal long, place int, vec_id long, score long")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, v)."""
    rows = stash(rows, "negatives-rows")
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most"))
    largest = dims.agg(F.max("dim")).first()[0]
    sample = sampled(rows, largest) if largest else {}
    # one row for each length of the sample
    known = {r["dim"]: r for r in dims.where(F.col("dim").isin([int(d) for d in sample])).collect()} if sample else {}
    trees = {}
    for dim, (_, _, v) in sample.items():
        levels = min(LEVELS, max(0, int(np.ceil(np.log2(known[dim]["n"] / block_rows(dim))))))
        trees[dim] = VantageTree(v, max(1, len(v) >> levels), levels, known[dim]["most"])
    placed = stash(in_cells(rows, trees), "negatives-placed")
    ends = [f(F.get("far", F.lit(i))).alias(f"{name}{i}") for i in range(LEVELS) for f, name in ((F.min, "least"), (F.max, "most"))]
    sizes = stash(placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), *ends), "negatives-cells")
    tops = {}
    for dim, tree in trees.items():
        # at most 2 ** LEVELS rows
        cells = {r["cell"]: tuple([r[f"{name}{i}"] for i in range(len(tree.paths[r["cell"]]))] for name in ("least", "most")) for r in sizes.where((F.col("dim") == dim) & (F.col("cell") >= 0)).collect()}
        tops[dim] = Top(tree, cells, sample[dim])
    fits = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    blocks = sizes.select("dim", "cell", F.ceil(F.col("n") / fits).cast("long").alias("blocks"))
    anchors = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("deal", "vec_id", "label", "v")
    asked = anchors.select("*", F.lit(0).alias("place"), F.lit(_NONE).cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high"))
    found = visit(send(asked, tops, True, positives), placed, blocks, True, positives)
    mine = stash(_first(found, positives, "deal").select("deal", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # 80 p <= 100 s <= 100 p has no solution for p < 0
    windows = mine.where("positive_score >= 0").select("deal", "place", F.expr("positive_score - positive_score div 5").alias("low"), F.col("positive_score").alias("high"))
    found = visit(send(anchors.join(windows, "deal"), tops, False, negatives), placed, blocks, False, negatives)
    mined = _first(found, negatives, "deal", "place").select("deal", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = mined.join(mine, ["deal", "place"]).join(anchors.select("deal", F.col("vec_id").alias("anchor_id")), "deal")
    out = stash(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-result")
    drop_stash(rows, placed, sizes, mine)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved by one first, as its contract asks."""
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
