"""Near-duplicate documents by a prefix-tree join of their n-gram sets.

A document's set: the distinct 3-word shingles of its lower-cased (A-Z) text, as 64-bit hashes; their order is the
global order.  Two sets link when 100 * |A and B| >= 90 * |A or B|.

1. Documents of one set form a class, found by a hash of the set; from here on each class counts once.
2. Blocking, without loss: sets of like size cut the global order into equal ranges, more than the tokens in which sets
   that link can differ, so linked sets agree wholly in some ranges.  A set sends a signature of each range in which it
   has tokens.  There are so many spare ranges that linked sets agree in one with tokens, but for sets that are
   crowded into few ranges (a share of ``CROWDED`` of all sets by chance, whatever the texts): these send the empty ranges too.
   Sets that share a signature, directly or through others, are a candidate cluster.
3. A cluster is dealt in blocks of about ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles, each pair of blocks to a task of
   bounded size.  There the prefix-tree join runs: the sets of one block, in the global order, are put into a
   path-compressed trie; the other block's sets walk it together, sharing the overlap counted on the way, and a subtree
   is left once no walker can still reach the overlap it needs, given the tokens that remain on the paths and to itself.
4. A task returns a number per set and a spanning forest of its links, never all pairs; the components of the forests
   are the components of the links.

A null text, or one without a word, has no set: n_shingles 0, no link, its own component.  Repeated rows each get a row
and are links of each other.  A null doc_id takes part; components are named by the smallest non-null doc_id.  An empty
table gives no rows.  A text of any length is read whole, at about 100 bytes of memory a byte of it.  Extra columns are
ignored, whatever their names.  Hash collisions (64 bits) are taken as equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import TO_LOWER, SpanHash, documents, drop_stash, mix64, renamed, stash, text_pieces, tidy, word_spans
from citeloom.operators.components import connected_components

NGRAM = 3
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Tokens of a path that are walked before bounds are looked at again.
STEP = 64
FIRST_SIZE, GROWTH, CROWDED = 9, 1.4, 1e-4
_KEYS = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def needed(total: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of linked sets whose sizes add up to ``total``: 100 i >= 90 (total - i)."""
    return -(-9 * total // 19)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, ngram: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of ``ngram`` words (8 at most) of each row."""
    start, end, row = word_spans(raw, offs)
    hashes = SpanHash(TO_LOWER[raw]).of(start, end)
    rows = len(offs) - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]) if len(row) else np.zeros(rows + 1, np.int64)
    grams = np.zeros(0, np.uint64)
    if len(hashes) >= ngram:
        grams = mix64(sum(hashes[k : len(hashes) - ngram + 1 + k] * _KEYS[k] for k in range(ngram)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= ngram:
            out.append(np.unique(grams[a : b - ngram + 1]))
        elif b > a:
            out.append(mix64(np.array([sum(int(h) * int(k) for h, k in zip(hashes[a:b], _KEYS, strict=False)) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(grams: np.ndarray) -> int:
    total = mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix64(np.array([total], np.uint64) + np.uint64(len(grams)))[0].astype(np.int64))


def crowded(n: int, ranges: int, filled: int) -> float:
    """How likely ``n`` tokens fall into ``filled`` of the ranges or fewer: exact, or (large n) a bound from above."""
    if n <= 400:
        # chance of each number of ranges with tokens, token by token
        chance = np.zeros(ranges + 2)
        chance[0] = 1.0
        k = np.arange(ranges + 2)
        for _ in range(n):
            chance = chance * k / ranges + np.concatenate([[0.0], (chance * (ranges - k) / ranges)[:-1]])
        return float(chance[: filled + 1].sum())
    # Chernoff for the number of empty ranges, which are negatively associated
    mean, least = ranges * math.exp(n * math.log1p(-1.0 / ranges)), ranges - filled
    return 1.0 if least <= mean else math.exp(least - mean + least * math.log(mean / least)) if mean > 0 else 0.0


@lru_cache(1)
def size_buckets() -> list[tuple[int, int, int, int]]:
    """(first size, last size, tokens in which linked sets can differ, ranges) of each bucket of set sizes, up to 2**40."""
    out, low = [], FIRST_SIZE
    while low < 1 << 40:
        high = -int(-low * GROWTH // 1) - 1
        differ = max(s - 2 * needed(s) for s in range(max(2 * low, 2 * high - 60), 2 * high + 1))
        ranges = differ + 1
        while crowded(low, ranges, differ) > CROWDED:
            ranges += 1 + ranges // 1000
        out.append((low, high, differ, ranges))
        low = high + 1
    return out


@lru_cache(4096)
def range_edges(ranges: int) -> np.ndarray:
    return np.array([(j << 64) // ranges for j in range(1, ranges)], np.uint64)


def signatures(grams: np.ndarray) -> np.ndarray:
    """Hashes of a set's ranges, under its own size bucket and, if a larger set of the next can link, under that."""
    n = len(grams)
    if n < FIRST_SIZE:
        return np.zeros(0, np.int64)  # sets below FIRST_SIZE link only if equal
    buckets = size_buckets()
    own = next(i for i, (_, high, _, _) in enumerate(buckets) if n <= high)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(grams ^ np.uint64(0xD6E8FEB86659FD93)))])
    out = []
    for i in (own, own + 1):
        low, _, differ, ranges = buckets[i]
        if i > own and 10 * n < 9 * low:
            continue
        cut = np.concatenate([[0], np.searchsorted(grams, range_edges(ranges)), [n]])
        filled = np.diff(cut) > 0
        sig = mix64(sums[cut[1:]] - sums[cut[:-1]] + mix64(np.arange(ranges, dtype=np.uint64) + np.uint64(i << 40)))
        # linked sets agree in ranges - differ ranges at least, so in one with tokens if more than differ have some
        out.append(sig[filled] if filled.sum() > differ else sig)
    return np.concatenate(out).astype(np.int64)


class Trie:
    """A path-compressed prefix tree of token sets, in the global order, that many walkers pass through together."""

    def __init__(self, sets: list[np.ndarray]):
        self.tokens = np.unique(np.concatenate(sets))
        paths = [np.searchsorted(self.tokens, s) for s in sets]
        lists = [p.tolist() for p in paths]
        self.order = sorted(range(len(sets)), key=lists.__getitem__)
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])

    def join(self, walkers: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For each stored set (its number) the walkers that link to it."""
        sizes = np.array([len(w) for w in walkers])
        every = np.concatenate(walkers)
        owner = np.repeat(np.arange(len(walkers)), sizes)
        at = np.searchsorted(self.tokens, every)
        # a walker's tokens up to a token of the tree are those whose place here is not beyond it
        width = len(self.tokens) + 1
        passed, begin = owner * width + at, np.cumsum(sizes) - sizes
        known = self.tokens[np.minimum(at, width - 2)] == every
        ranks, owner = at[known], owner[known]
        by_rank = np.argsort(ranks, kind="stable")
        owner = owner[by_rank]
        first = np.searchsorted(ranks[by_rank], np.arange(width))
        stack = [(0, len(self.paths), 0, np.arange(len(walkers)), np.zeros(len(walkers), np.int64))]
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()
            a, b = self.paths[lo], self.paths[hi - 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m]) if hi - lo > 1 else ()
            shared = depth + int(differ[0]) if len(differ) else m
            longest, least = int(self.sizes[lo:hi].max()), int(self.sizes[lo:hi].min())
            while depth < shared and len(alive):
                to = min(depth + STEP, shared)
                path = a[depth:to]
                seen = np.concatenate([owner[first[r] : first[r + 1]] for r in path.tolist()])
                overlap = overlap + np.bincount(seen, minlength=len(walkers))[alive]
                depth = to
                left = sizes[alive] + begin[alive] - np.searchsorted(passed, alive * width + path[-1], side="right")
                ok = overlap + np.minimum(longest - depth, left) >= needed(sizes[alive] + least)
                if not ok.all():
                    alive, overlap = alive[ok], overlap[ok]
            if not len(alive):
                continue
            while lo < hi and len(self.paths[lo]) == shared:
                yield self.order[lo], alive[overlap >= needed(sizes[alive] + shared)]
                lo += 1
            while lo < hi:
                token, to = self.paths[lo][shared], lo + 1
                while to < hi and self.paths[to][shared] == token:
                    to += 1
                stack.append((lo, to, shared, alive, overlap))
                lo = to


def join_blocks(stored: list[tuple[int, int, np.ndarray]], walkers: list[tuple[int, int, np.ndarray]], same: bool) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Of (id, copies, set) rows: linked documents by id, and a spanning forest of the links."""
    links: dict[int, int] = {}
    root: dict[int, int] = {}
    forest = []

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    copies = np.array([c for _, c, _ in walkers])
    for i, found in Trie([s for _, _, s in stored]).join([s for _, _, s in walkers]):
        me, own, _ = stored[i]
        found = [j for j in found.tolist() if walkers[j][0] != me]
        if not found:
            continue
        links[me] = links.get(me, 0) + int(copies[found].sum())
        for j in found:
            other = walkers[j][0]
            if not same:
                links[other] = links.get(other, 0) + own
            a, b = find(me), find(other)
            if a != b:
                root[a] = b
                forest.append((me, other))
    return links, forest


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_sum (a checksum of the text), set_id (null without words), n, sigs."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_sum", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("sigs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, offs in text_pieces(batches):
            sets = shingle_sets(raw, offs)
            sigs = [signatures(s) for s in sets]
            ends = np.cumsum([0, *map(len, sigs)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_sum"), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_sum")).mapInArrow(tidy(run), "doc_id long, text_sum long, set_id long, n long, sigs array<long>")


def candidate_clusters(sets: DataFrame) -> DataFrame:
    """set_id, cluster, of all sets that share a range with another."""
    each = sets.where(F.col("set_id").isNotNull() & (F.size("sigs") > 0)).groupBy("set_id").agg(F.first("sigs").alias("sigs"))
    postings = each.select("set_id", F.explode("sigs").alias("sig"))
    shared = postings.groupBy("sig").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least <> most").select("sig", "least")
    edges = postings.join(shared, "sig").where("set_id <> least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    return connected_components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the text of the row that its column from (text_sum, no_id, doc_id) names, one for equal rows."""
    key = ["_sum", "_no_id", "_id"]
    texts = docs.select(F.xxhash64("text").alias("_sum"), F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "text")
    asked = wanted.select(F.col("from.text_sum").alias("_sum"), F.col("from.no_id").alias("_no_id"), F.coalesce("from.doc_id", F.lit(0)).alias("_id"), *[c for c in wanted.columns if c != "from"])
    # rows of one key meet in the join, so that the copies go without another shuffle
    return texts.join(asked, key).dropDuplicates(key).drop(*key)


def block_links(members: DataFrame) -> DataFrame:
    """From set_id, copies, cluster, blocks, text: rows (set_id, links, null) and forest edges (set_id, 0, other)."""
    kind = pa.schema([("cluster", pa.int64()), ("set_id", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, offs in text_pieces(batches):
            sets = shingle_sets(raw, offs)
            # a doc_id that stands for several texts brings them all; only the wanted set goes on
            keep = [i for i, (s, want) in enumerate(zip(sets, piece.column("set_id").to_pylist(), strict=True)) if len(s) and set_hash(s) == want]
            columns = [piece.column(c).take(pa.array(keep, pa.int64())) for c in ("cluster", "set_id", "copies", "blocks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].astype(np.int64) for i in keep], pa.list_(pa.int64()))], schema=kind)

    with_grams = members.mapInArrow(tidy(grams), "cluster long, set_id long, copies long, blocks long, grams array<long>")
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    dealt = with_grams.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "copies", "grams")
    grouped = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "set_id")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored, walkers, last = None, [], [], None

        def done() -> pa.RecordBatch | None:
            if key is None or not stored or not walkers:
                return None
            counts, forest = join_blocks(stored, walkers, key[1] == key[2])
            a = [*counts, *(x for x, _ in forest)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([*counts.values(), *([0] * len(forest))], pa.int64()), pa.array([*([None] * len(counts)), *(x for _, x in forest)], pa.int64())], names=["set_id", "links", "other"]) if a else None

        for batch in batches:
            flat = batch.column("grams")
            ends = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False).view(np.uint64)
            names = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "set_id", "copies")]
            for r, (cluster, i, j, own, set_id, copies) in enumerate(zip(*names, strict=True)):
                if (cluster, i, j) != key:
                    if (out := done()) is not None:
                        yield out
                    key, stored, walkers, last = (cluster, i, j), [], [], None
                if set_id == last:
                    continue  # repeated rows of one text
                last = set_id
                row = (set_id, copies, values[ends[r] : ends[r + 1]].copy())
                if own == i:
                    stored.append(row)
                if own == j:
                    walkers.append(row)
        if (out := done()) is not None:
            yield out

    return grouped.mapInArrow(tidy(links), "set_id long, links long, other long")


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (doc_id, text_sum, set_id, n), and per set_id: component (a set_id), component_id, n_links."""
    sets = stash(document_sets(docs), "ngram-sets")
    classes = stash(sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min(F.struct("text_sum", F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("from"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")), "ngram-classes")
    clusters = stash(candidate_clusters(sets), "ngram-clusters")
    weighed = clusters.join(classes, "set_id").select("cluster", "set_id", "copies", "from", "n")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    wanted = weighed.join(weighed.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").select("cluster", "set_id", "copies", "blocks", "from")
    members = texts_of(docs, wanted).select("cluster", "set_id", "copies", "blocks", "text")
    links = stash(block_links(members), "ngram-links")
    parts = stash(connected_components(links.where("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b"))), "ngram-parts")
    named = parts.join(classes, parts["node"] == classes["set_id"]).groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = parts.join(named, "component").select(F.col("node").alias("set_id"), "component", "component_id")
    counted = links.where("other is null").groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = classes.join(by_set, "set_id", "left").join(counted, "set_id", "left")
    result = stash(joined.select("set_id", F.coalesce("component", "set_id").alias("component"), F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "ngram-result")
    drop_stash(classes, clusters, links, parts)
    return sets.select("doc_id", "text_sum", "set_id", "n"), result


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that the row links with) for every row."""
    sets, result = set_components(docs)
    own = sets.select("doc_id", "set_id", F.col("n").alias("n_shingles"))
    linked = own.where(F.col("set_id").isNotNull()).join(result, "set_id").select("doc_id", "n_shingles", "component_id", "n_links")
    alone = own.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row of the smallest doc_id (null last; then the
    least set and text checksum).  A text without words has no copies but equal rows.  Of equal rows one stays."""
    sets, result = set_components(docs)
    rows = sets.groupBy("doc_id", "text_sum", "set_id").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_id", "text_sum", "times")).alias("first")
    linked = rows.where(F.col("set_id").isNotNull()).join(result.select("set_id", "component"), "set_id").groupBy("component").agg(first).select("first.doc_id", "first.text_sum", "first.times")
    kept = linked.union(rows.where(F.col("set_id").isNull()).select("doc_id", "text_sum", "times"))
    # names that are free in docs
    kept = stash(kept.toDF(*renamed(["_doc_id", "_text_sum", "_times"], docs.columns)), "ngram-kept")
    names = kept.columns
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])))
    once = found.where(F.col(names[2]) == 1).select(*docs.columns)
    # only rows that are there several times are compared
    return once.union(found.where(F.col(names[2]) > 1).dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in generate_series(1, len(ws) - 2)]) END AS grams FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), r AS (
  SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.x
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.x = s.doc_id) AS component_id, (SELECT CAST(count(*) AS BIGINT) FROM p WHERE p.a = s.doc_id) AS n_links FROM s
"""
