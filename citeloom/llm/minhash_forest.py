"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document's set: the distinct 4-word shingles of its lower-cased (A-Z) text, as 64-bit hashes.  Two sets link when
100 * |A and B| >= 80 * |A or B|, which is always confirmed on the full sets.

1. Documents of one set form a class; from here on each class counts once.  A class's signature has ``TREES`` * ``DEPTH`` MinHash
   values.  Tree t orders the signatures rotated by t * ``DEPTH`` values; classes that share the first ``DEPTH`` values of a tree
   are a region of it.  Linked sets meet in a region but for a chance of (1 - 0.8 ** 4) ** 32 < 1e-7.
2. In some of the sorted orders, ``FIRST`` and then ``THEN``, each class is compared with its neighbour if their common prefix
   makes a region.  Families of near copies become one component here, at two comparisons a class and order.
3. What is left are regions that hold several components.  Inside one, components are joined to a cluster where signatures of
   their classes agree in ``AGREE`` values or more (a link has fewer by a chance below 1e-6).  Depth adapts: a region of
   over ``CROWD`` classes is divided by the next values of the order, by ``BRANCHES`` different ones so that linked sets stay
   together in one (but for 0.2 ** 3); parts that are still large after ``LEVELS`` are dealt in blocks, each pair of blocks to a
   task.  Nothing is left out at any size.
4. Clusters are few and hold what may link.  Full sets of a cluster meet in pairs of bounded blocks, where all overlaps of
   two blocks are products of sparse columns; the largest component of a cluster is not compared with itself.  A
   task returns a spanning forest of its links, never all pairs.

A null text, or one without a word, has no set: n_shingles 0, no link, its own component.  Repeated rows each get a row.
A null doc_id takes part; components are named by the smallest doc_id that is not null, and kept is true for rows of that
doc_id (all of them, if repeated; of a component of null ids, all rows).  An empty table gives no rows.  A text of any
length is read whole, at about 100 bytes of memory a byte of it.  Extra columns are ignored, whatever their names.  Hash
collisions (64 bits) are taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import documents, drop_stash, mix64, stash, text_pieces, tidy
from citeloom.llm.ngram_join import set_hash, shingle_sets, texts_of
from citeloom.operators.components import connected_components
from citeloom.operators.skew import join_by

NGRAM = 4
TREES, DEPTH = 32, 4
HASHES = TREES * DEPTH
#: Sets of fewer shingles link only if equal.
FIRST_SIZE = 4
FIRST, THEN = (0, 16), (4, 8, 12, 20, 24, 28)
AGREE = 78
CROWD, LEVELS, BRANCHES = 4096, 3, 3
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Tokens that are multiplied at once.
COLUMNS = 4096
_TIMES = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_THEN = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A signature of ``HASHES`` 16-bit values for each (non-empty) set: the last bits of each hash function's minimum."""
    first = np.cumsum([0, *map(len, sets)])[:-1]
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        h = every * _TIMES[k]
        h ^= h >> np.uint32(15)
        h *= _THEN[k]
        out[:, k] = np.minimum.reduceat(h, first) & np.uint32(0xFFFF)
    return out


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_sum, set_id (null without words), n, sig (null for sets that link only if equal)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_sum", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, offs in text_pieces(batches):
            sets = shingle_sets(raw, offs, NGRAM)
            large = [i for i, s in enumerate(sets) if len(s) >= FIRST_SIZE]
            sigs: list[bytes | None] = [None] * len(sets)
            for i, sig in zip(large, minhashes([sets[i] for i in large]) if large else (), strict=True):
                sigs[i] = sig.tobytes()
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_sum"), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_sum")).mapInArrow(tidy(run), "doc_id long, text_sum long, set_id long, n long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, grams of the wanted classes (set_id, from)."""
    schema = pa.schema([("set_id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, offs in text_pieces(batches):
            sets = shingle_sets(raw, offs, NGRAM)
            # texts of one checksum may differ; only the wanted set goes on
            keep = [i for i, (s, want) in enumerate(zip(sets, piece.column("set_id").to_pylist(), strict=True)) if len(s) and set_hash(s) == want]
            yield pa.RecordBatch.from_arrays([piece.column("set_id").take(pa.array(keep, pa.int64())), pa.array([sets[i].astype(np.int64) for i in keep], pa.list_(pa.int64()))], schema=schema)

    return texts_of(docs, wanted).select("set_id", "text").mapInArrow(tidy(run), "set_id long, grams array<long>")


def prefix(tree: Column) -> Column:
    """The values of a signature (bytes) that make a region of the tree."""
    return F.substring("sig", 1 + tree * 2 * DEPTH, F.lit(2 * DEPTH))


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """set_id, tree, region of every class and tree, and region, n of the regions of two classes or more."""
    each = classes.where(F.col("sig").isNotNull()).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("set_id", "tree", F.xxhash64("tree", prefix(F.col("tree"))).alias("region"))
    shared = each.groupBy("region").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    return each, shared.select("region", "n")


# ---------------------------------------------------------------- candidates

def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1) >= AGREE


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10 * n >= 8 * m) & (10 * m >= 8 * n)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def neighbours(members: DataFrame, trees: tuple[int, ...]) -> DataFrame:
    """a, b: classes (set_id, part, n, sig) next to each other in an order, of one region and different parts."""
    width = HASHES * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, sid, part, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "set_id", "part", "n"))
            sig = _signatures(batch.column("sig"))
            if last is not None:
                tree, sid, part, n, sig = (np.concatenate([x, y]) for x, y in zip(last, (tree, sid, part, n, sig), strict=True))
            last = tuple(x[-1:] for x in (tree, sid, part, n, sig))
            near = (tree[1:] == tree[:-1]) & (part[1:] != part[:-1]) & _sizes_fit(n[1:], n[:-1]) & (sig[1:, :DEPTH] == sig[:-1, :DEPTH]).all(axis=1) & _agreeing(sig[1:], sig[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[1:], sid[:-1])[near]), pa.array(np.maximum(sid[1:], sid[:-1])[near])], schema=_PAIRS)

    turned = F.concat(F.substring("sig", 1 + F.col("tree") * 2 * DEPTH, F.lit(width)), F.substring("sig", F.lit(1), F.col("tree") * 2 * DEPTH))
    orders = members.withColumn("tree", F.explode(F.array(*map(F.lit, trees)))).select("tree", turned.alias("sig"), "set_id", "part", "n")
    return orders.repartitionByRange("tree", "sig").sortWithinPartitions("tree", "sig", "set_id").mapInArrow(tidy(run), "a long, b long").distinct()


def mixed_regions(places: DataFrame) -> DataFrame:
    """region, n of the regions (set_id, part, tree, region) that hold several parts."""
    return places.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("region", "n")


def region_edges(places: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the parts whose classes agree inside a region; depth adapts to how crowded a region is."""
    ready: DataFrame | None = None
    held: list[DataFrame] = []
    level = 0
    while True:
        sizes = stash(mixed_regions(places), "forest-sizes")
        held.append(sizes)
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        small = sizes if total[1] <= CROWD or level == LEVELS else sizes.where(F.col("n") <= CROWD)
        rows = join_by(places, small, "region", F.col("n"), total[0])
        ready = rows if ready is None else ready.union(rows)
        if small is sizes:
            break
        crowded = join_by(places, sizes.where(F.col("n") > CROWD), "region", F.col("n"), total[0])
        # the values that come next in the tree's order
        value = F.substring("sig", 1 + 2 * ((F.col("tree") * DEPTH + DEPTH + BRANCHES * level + F.col("branch")) % HASHES), F.lit(2))
        divided = crowded.drop("n").join(classes.select("set_id", "sig"), "set_id").withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
        places = stash(divided.select("set_id", "part", "tree", F.xxhash64("region", "branch", value).alias("region")), "forest-deeper")
        held.append(places)
        level += 1
    blocks = F.ceil(F.col("n") / CROWD).cast("long")
    dealt = ready.join(classes.select("set_id", F.col("n").alias("size"), "sig"), "set_id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "part", "size", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done() -> pa.RecordBatch:
            edges = agreeing_parts(*(np.concatenate(x) for x in zip(*group, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([x for _, x in edges], pa.int64())], schema=_PAIRS)

        for batch in batches:
            if not batch.num_rows:
                continue
            region, i, j, part, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "i", "j", "part", "size"))
            sig = _signatures(batch.column("sig"))
            cuts = [0, *(np.flatnonzero((np.diff(region) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(region)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = (region[lo], i[lo], j[lo])
                if own != key:
                    if group:
                        yield done()
                    key, group = own, []
                group.append((part[lo:hi], size[lo:hi], sig[lo:hi]))
        if group:
            yield done()

    out = stash(dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(tidy(run), "a long, b long").distinct(), "forest-region-edges")
    drop_stash(*held)
    return out


def agreeing_parts(part: np.ndarray, size: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of parts, joined where classes of two parts agree.  A class is compared with the classes that no
    walk has reached yet, so parts that agree cost little more than one comparison each."""
    edges, open_ = [], np.ones(len(part), bool)
    members = {p: np.flatnonzero(part == p) for p in np.unique(part).tolist()}
    while open_.any():
        queue = [int(part[open_.argmax()])]
        open_[members[queue[0]]] = False
        while queue:
            own = queue.pop()
            for x in members[own].tolist():
                rest = np.flatnonzero(open_)
                if not len(rest):
                    return edges
                rest = rest[_sizes_fit(size[rest], size[x])]
                for other in np.unique(part[rest[_agreeing(sig[rest], sig[x])]]).tolist():
                    edges.append((own, other))
                    open_[members[other]] = False
                    queue.append(other)
    return edges


# ---------------------------------------------------------------- exact overlaps

def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set (distinct tokens) of one list with every one of the other."""
    tokens, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    # only tokens of both sides count; they get columns of their own
    ours, theirs = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    ours[where[rows < len(left)]] = True
    theirs[where[rows >= len(left)]] = True
    both = ours & theirs
    column = np.cumsum(both) - 1
    rows, columns = rows[both[where]], column[where[both[where]]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(columns, (first, first + COLUMNS))
        marks = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        marks[rows[lo:hi], columns[lo:hi] - first] = 1
        out += marks[: len(left)] @ marks[len(left) :].T
    return out.astype(np.int64)


def cluster_links(members: DataFrame, grams: DataFrame) -> DataFrame:
    """a, b: links between classes of different parts of a cluster (set_id, part, cluster, n), a spanning forest from each task.

    A cluster is dealt in blocks of about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles, each pair of blocks to a task.  The
    largest part of a cluster has blocks of its own, which are not paired with each other.
    """
    by_part = members.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    need = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("long")
    most = by_part.groupBy("cluster").agg(F.max(F.struct("m", "s", "part")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    most = most.select("cluster", F.col("top.part").alias("top"), "m", need(F.col("top.m"), F.col("top.s")).alias("first"), need(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest")).where("rest > 0")
    most = stash(most, "forest-blocks")
    total = most.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    placed = join_by(members, most, "cluster", F.col("m"), total)
    deal = F.xxhash64("set_id", F.lit(7))
    placed = placed.withColumn("block", F.when(F.col("part") == F.col("top"), F.pmod(deal, F.col("first"))).otherwise(F.col("first") + F.pmod(deal, F.col("rest"))))
    others = F.sequence(F.when(F.col("part") == F.col("top"), F.col("first")).otherwise(F.lit(0).cast("long")), F.col("first") + F.col("rest") - 1)
    placed = placed.withColumn("other", F.explode(others)).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "part")
    dealt = placed.join(grams, "set_id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done() -> pa.RecordBatch:
            left, right = ([r for r in group if r[2] == k] for k in key[1:])
            edges: list[tuple[int, int]] = []
            if left and right:
                sizes = [np.array([len(r[3]) for r in side]) for side in (left, right)]
                shared = overlaps([r[3] for r in left], [r[3] for r in right])
                parts = [np.array([r[1] for r in side]) for side in (left, right)]
                linked = (180 * shared >= 80 * (sizes[0][:, None] + sizes[1][None, :])) & (parts[0][:, None] != parts[1][None, :])
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for x, y in zip(*(at.tolist() for at in np.nonzero(linked)), strict=True):
                    p, q = find(int(parts[0][x])), find(int(parts[1][y]))
                    if p != q:
                        root[p] = q
                        edges.append((left[x][0], right[y][0]))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([x for _, x in edges], pa.int64())], schema=_PAIRS)

        for batch in batches:
            flat = batch.column("grams")
            ends = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            names = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "set_id", "part")]
            for r, (cluster, i, j, block, set_id, part) in enumerate(zip(*names, strict=True)):
                if (cluster, i, j) != key:
                    if group:
                        yield done()
                    key, group = (cluster, i, j), []
                group.append((set_id, part, block, values[ends[r] : ends[r + 1]].copy()))
        if group:
            yield done()

    out = stash(dealt.mapInArrow(tidy(run), "a long, b long"), "forest-cluster-links")
    drop_stash(most)
    return out


def confirmed(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """a, b of the pairs that link, by their full sets."""
    left, right = grams.select(F.col("set_id").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("set_id").alias("b"), F.col("grams").alias("gb"))
    overlap = F.size(F.array_intersect("ga", "gb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(180 * overlap >= 80 * (F.size("ga") + F.size("gb"))).select("a", "b")


# ---------------------------------------------------------------- the operator

def minhash_forest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sets = stash(document_sets(docs), "forest-sets")
    named = sets.where(F.col("set_id").isNotNull()).groupBy("set_id")
    source = F.min(F.struct("text_sum", F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("from")
    every = stash(named.agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), source, F.first("sig").alias("sig")), "forest-classes")
    each, shared = regions(every)
    shared = stash(shared, "forest-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = stash(join_by(each, shared, "region", F.col("n"), total).drop("n"), "forest-places")
    classes = stash(every.join(places.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "n", "sig", "from"), "forest-candidates")
    grams = stash(full_sets(docs, classes.select("set_id", "from")), "forest-grams")
    links: list[DataFrame] = []
    parts: DataFrame | None = None

    def settle(more: DataFrame) -> None:
        nonlocal parts
        links.append(more)
        found = links[0]
        for table in links[1:]:
            found = found.union(table)
        old, parts = parts, stash(connected_components(found), "forest-parts")
        if old is not None:
            drop_stash(old)

    def with_part(rows: DataFrame) -> DataFrame:
        if parts is None:
            return rows.withColumn("part", F.col("set_id"))
        return rows.join(parts.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id")).drop("component")

    for trees in (FIRST, THEN):
        settle(stash(confirmed(neighbours(with_part(classes), trees), grams), "forest-links"))
    open_ = stash(with_part(places), "forest-open")
    met = region_edges(open_, classes)
    clusters = stash(connected_components(met), "forest-clusters")
    members = stash(with_part(classes.select("set_id", "n")).join(clusters.select(F.col("node").alias("part"), F.col("component").alias("cluster")), "part"), "forest-members")
    settle(cluster_links(members, grams))
    components = with_part(every.select("set_id", "least_id", "copies"))
    names = components.groupBy("part").agg(F.min("least_id").alias("component_id"))
    result = stash(components.join(names, "part").select("set_id", "component_id", "copies"), "forest-result")
    drop_stash(every, shared, places, open_, classes, grams, met, clusters, members, parts, *links)
    own = sets.select("doc_id", "set_id", F.col("n").alias("n_shingles"))
    total = result.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    linked = join_by(own.where(F.col("set_id").isNotNull()), result, "set_id", F.col("copies"), total).select("doc_id", "n_shingles", "component_id")
    alone = own.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in generate_series(1, len(ws) - 3)]) END AS grams FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)
), r AS (
  SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.x
), c AS (
  SELECT x, min(root) AS component_id FROM r GROUP BY x
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.x
"""
