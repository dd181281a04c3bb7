"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities and counts of words, word beginnings and spellings with signs removed and digits read as letters in a lexicon, their summed and
greatest weights, hits within ``NEAR`` words of a second-person word, the rates of capitals, of "!" and "?", of other
punctuation and of obfuscated words (letters with digits or signs, or spelled letter by letter), and the text's size.

The lexicon is learned from the labelled texts: words, word beginnings (4 to 6 bytes) and obfuscated spellings that many toxic and hardly any
other texts hold, with their log-odds, ``LEXICON`` of each kind at most.  To keep the trees honest the lexicon is
learned on one half of the sample when the other half's features are made, and the other way round; scoring uses the
whole sample's.  Trees are grown on binned features; isotonic regression on the cross-fitted margins gives
probabilities, corrected from the balanced sample to the labels' own share.

Learned from at most ``LEARN_ROWS`` texts of each label outside the held-out fold.  A null or empty text has all
features 0 and gets a score.  Without labels of both kinds the score is the known share (0 if none).  A null doc_id is not
held out.  Repeated rows each get a row, with one score; a document with contradicting labels is learned as label 0.  An
empty table gives no rows.  A text of any length is read whole, at about 100 bytes of memory a byte of it.  No shuffle of
texts; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import TO_LOWER, SpanHash, documents, held_out, text_pieces, tidy, word_spans
from citeloom.llm.sampling import labelled_texts

LEARN_ROWS = 1500
LEXICON = 400
NEAR = 5
TREES, DEPTH, BINS, RATE, LEAF_ROWS = 60, 3, 32, 0.15, 12
#: Second-person words of the four languages.
SECOND_PERSON = ["deine", "dein", "dich", "dir", "du", "euch", "ihr", "te", "ti", "toi", "tu", "tus", "tú", "ustedes", "usted", "votre", "vous", "you", "your", "you're", "yours"]
KINDS = ("word", 4, 5, 6, "spelled")

#: Letters for the lexicon: ASCII letters and every byte of a longer UTF-8 sequence.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[0x21, 0x3F]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_INNER = np.zeros(256, bool)
_INNER[[*range(0x30, 0x3A), 0x21, 0x24, 0x40, 0x2A, 0x23]] = True
#: The letter that a byte stands for in an obfuscated spelling; 0 for none.
_SPELLS = np.where(_LETTER, TO_LOWER[np.arange(256)], 0).astype(np.uint8)
for _a, _b in zip(b"0134578$@", b"oieastbsa", strict=True):
    _SPELLS[_a] = _b
N_FEATURES = 16


def hash_bytes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return SpanHash(raw).of(ends - [len(w) for w in words], ends) if words else np.zeros(0, np.uint64)


_YOU = np.sort(hash_bytes([w.encode() for w in SECOND_PERSON]))


class Words:
    """Hashes of the letter runs of a piece of rows, as whole words and as beginnings, and of obfuscated spellings.

    An obfuscated spelling is a white-space word of several letter runs or with a digit or sign that stands for a letter,
    less its other bytes; ``first`` and ``after`` are the places of its runs.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.low = TO_LOWER[raw]
        self.start, self.end, self.row = word_spans(raw, offs, _LETTER[raw])
        self.spans = SpanHash(self.low)
        self.hashes = {kind: self._of(kind) for kind in KINDS if kind != "spelled"}
        self.rows: dict[str | int, np.ndarray] = dict.fromkeys(self.hashes, self.row)
        start, end, row = self.whole = word_spans(raw, offs)
        self.firsts, self.afters = np.searchsorted(self.start, start), np.searchsorted(self.start, end)
        spells = _SPELLS[raw]
        at = np.concatenate([[0], np.cumsum(spells > 0)])
        stands = np.concatenate([[0], np.cumsum((spells > 0) & ~_LETTER[raw])])
        runs = self.afters - self.firsts
        odd = (runs > 0) & ((runs > 1) | (stands[end] > stands[start]))
        self.first, self.after, self.rows["spelled"] = self.firsts[odd], self.afters[odd], row[odd]
        self.hashes["spelled"] = SpanHash(spells[spells > 0]).of(at[start[odd]], at[end[odd]]) if odd.any() else np.zeros(0, np.uint64)

    def _of(self, kind: str | int) -> np.ndarray:
        if kind == "word":
            return self.spans.of(self.start, self.end)
        end = np.minimum(self.start + kind, self.end)
        # a shorter word has no such beginning; 0 is in no lexicon
        return np.where(self.end - self.start > kind, self.spans.of(self.start, end), np.uint64(0))


def _pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of texts of about ``limit`` bytes."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= limit:
            size += len(texts[to])
            to += 1
        yield at, np.frombuffer(b"".join(texts[at:to]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64)
        at = to


def learn_lexicon(texts: list[bytes], y: np.ndarray) -> dict[str | int, tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and log-odds by kind.  Texts are read in pieces; only a count per distinct word is held."""
    counted: dict[str | int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {kind: [] for kind in KINDS}
    for at, raw, offs in _pieces(texts):
        found = Words(raw, offs)
        for kind in KINDS:
            # each text counts once for each of its words
            hashes, row = found.hashes[kind], found.rows[kind]
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])[: len(row)] & (hashes != 0)
            words, index = np.unique(hashes[new], return_inverse=True)
            own = y[at + row[new]]
            counted[kind].append((words, np.bincount(index, own == 1, minlength=len(words)), np.bincount(index, own == 0, minlength=len(words))))
    n1, n0 = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    out = {}
    for kind in KINDS:
        words, index = np.unique(np.concatenate([w for w, _, _ in counted[kind]]), return_inverse=True)
        toxic, other = (np.bincount(index, np.concatenate([c[k] for c in counted[kind]]), minlength=len(words)) for k in (1, 2))
        odds = np.log((toxic + 0.05) / n1) - np.log((other + 0.5) / n0)
        good = np.flatnonzero((toxic >= 4) & (odds > 2.0))
        good = good[np.argsort(-odds[good] * np.sqrt(toxic[good]), kind="stable")][:LEXICON]
        good = good[np.argsort(words[good])]
        out[kind] = (words[good], odds[good])
    return out


def features(raw: np.ndarray, offs: np.ndarray, lexicon: dict) -> np.ndarray:
    """Rows x ``N_FEATURES``."""
    rows = len(offs) - 1
    found = Words(raw, offs)
    size = np.maximum(np.diff(offs), 1)
    n = np.bincount(found.row, minlength=rows)
    per = np.maximum(n, 1)
    add = lambda x: np.bincount(found.row, x, minlength=rows)
    columns, any_hit, weight = [], np.zeros(len(found.row), bool), np.zeros(len(found.row))
    for kind in KINDS[:-1]:
        words, odds = lexicon[kind]
        if len(words):
            at = np.minimum(np.searchsorted(words, found.hashes[kind]), len(words) - 1)
            hit = words[at] == found.hashes[kind]
            weight = np.where(hit, np.maximum(weight, odds[at]), weight)
        else:
            hit = np.zeros(len(found.row), bool)
        any_hit |= hit
        columns.append(add(hit))
    # obfuscated spellings, as words and as spellings of the lexicon
    spelled, row = found.hashes["spelled"], found.rows["spelled"]
    spelled_weight = np.zeros(len(row))
    for kind in ("word", "spelled"):
        words, odds = lexicon[kind]
        if len(words):
            at = np.minimum(np.searchsorted(words, spelled), len(words) - 1)
            spelled_weight = np.where(words[at] == spelled, np.maximum(spelled_weight, odds[at]), spelled_weight)
    spelled_hit = spelled_weight > 0
    add_spelled = lambda x: np.bincount(row, x, minlength=rows)
    columns.append(add_spelled(spelled_hit))
    greatest = np.zeros(rows)
    np.maximum.at(greatest, found.row, weight)
    np.maximum.at(greatest, row, spelled_weight)
    you = _YOU[np.minimum(np.searchsorted(_YOU, found.hashes["word"]), len(_YOU) - 1)] == found.hashes["word"]
    # hits with a second-person word at most NEAR words away, in the same row
    seen = np.concatenate([[0], np.cumsum(you)])
    first = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(len(found.row))
    lo, hi = np.maximum(index - NEAR, first[found.row]), np.minimum(index + NEAR + 1, first[found.row + 1])
    near = any_hit & (seen[hi] - seen[lo] > 0)
    lo, hi = np.maximum(found.first - NEAR, first[row]), np.minimum(found.after + NEAR, first[row + 1])
    spelled_near = spelled_hit & (seen[hi] - seen[lo] > 0)
    hits, weights, close = add(any_hit) + add_spelled(spelled_hit), add(weight) + add_spelled(spelled_weight), add(near) + add_spelled(spelled_near)
    cum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    whole_start, whole_end, whole_row = found.whole
    # a "!" counts only before a letter: at the end of a word it is plain punctuation
    before_letter = np.concatenate([_LETTER[raw[1:]], [False]])[: len(raw)]
    letters, inner = np.concatenate([[0], np.cumsum(_LETTER[raw])]), np.concatenate([[0], np.cumsum(_INNER[raw] & ((raw != 0x21) | before_letter))])
    runs, held = found.afters - found.firsts, letters[whole_end] - letters[whole_start]
    odd = (held > 0) & ((inner[whole_end] - inner[whole_start] > 0) | ((runs > 2) & (held == runs)))
    signs = cum(_SIGN[raw] & ~_SHOUT[raw]) / size
    columns += [hits, hits / per, weights / per, greatest, close, close / per, cum(_UPPER[raw]) / size, cum(_SHOUT[raw]) / size, signs, np.bincount(whole_row, odd, minlength=rows) / per, n]
    return np.stack(columns, axis=1).astype(np.float64)


class Trees:
    """Boosted regression trees for the logistic loss, grown on quantile bins."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p) + 1e-6
            column, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    j, edge = self._split(bins[rows], g[rows], h[rows])
                    if j >= 0:
                        column[k], cut[k] = j, self.edges[j][edge]
                node = 2 * node + 1 + (x[np.arange(len(y)), column[node]] > cut[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, minlength=2**DEPTH) / (np.bincount(leaf, h, minlength=2**DEPTH) + 1.0)
            margin += value[leaf]
            self.trees.append((column, cut, value))
        return self

    def _split(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best = (1e-3, -1, -1)
        if len(g) < 2 * LEAF_ROWS:
            return -1, -1
        for j, edges in enumerate(self.edges):
            if not len(edges):
                continue
            gs, hs, ns = (np.cumsum(np.bincount(bins[:, j], w, minlength=len(edges) + 1))[:-1] for w in (g, h, np.ones(len(g))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(ns < LEAF_ROWS) | (len(g) - ns < LEAF_ROWS)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        return best[1], best[2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        index = np.arange(len(x))
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[index, column[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step function that fits best (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, last x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([b, c, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][2] == blocks[-1][2]):
            q = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], q[2]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    constant: float | None = None

    def fit(self, rows: list[tuple[str, int]], share: float) -> Model:
        y = np.array([label for _, label in rows])
        if len(set(y.tolist())) < 2:
            self.constant = float(share)
            return self
        texts = [t.encode() for t, _ in rows]
        half = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 2  # each half has half of either label
        x, margin = np.zeros((len(rows), N_FEATURES)), np.zeros(len(rows))
        make = lambda which, lexicon: np.concatenate([features(raw, offs, lexicon) for _, raw, offs in _pieces([texts[i] for i in which])])
        for k in (0, 1):
            own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
            x[own] = make(own, learn_lexicon([texts[i] for i in other], y[other]))
        for k in (0, 1):
            own, other = half == k, half != k
            margin[own] = Trees().fit(x[other], y[other]).margin(x[own]) if len(set(y[other].tolist())) > 1 else 0.0
        self.lexicon = learn_lexicon(texts, y)
        self.trees = Trees().fit(x, y)
        # weights give the sample the labels' own share
        share = min(max(share, 1e-3), 1 - 1e-3)
        w = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
        self.knots, self.values = isotonic(margin, y.astype(float), w)
        return self

    def score(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        if self.constant is not None:
            return np.full(rows, self.constant)
        margin = self.trees.margin(features(raw, offs, self.lexicon))
        step = self.values[np.minimum(np.searchsorted(self.knots, margin, side="left"), len(self.values) - 1)]
        # within a step the margin still orders texts
        return np.clip(0.99 * step + 0.01 / (1 + np.exp(-margin)), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return Model().fit(*labelled_texts(docs, labels, "toxic", held_out(5, 0), LEARN_ROWS))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, offs in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sent.value.score(raw, offs), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
