"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP``, down to the last byte.
Bytes are embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes slide over each chunk (``STRIDE``), and each
filter's highest response in the chunk is kept.  A hidden layer reads every chunk; its outputs' mean and maximum over
all chunks of the document give one probability.

Learned from at most ``LEARN_ROWS`` labelled texts of each label outside the held-out fold, with a fixed number
of steps; the last layer's bias is set back from the balanced sample to the labels' own shares.

A null or empty text is one chunk of padding and gets a score like any other.  Without labels of both kinds the score
is the known share (0.5 if none).  A null doc_id is not held out.  Repeated rows each get a row, with one score; a document
with contradicting labels is learned as label 0.  An empty table gives no rows.  A text of any length is read whole, 96
chunks at a time; its memory is that of its chunks' hidden outputs (about 0.3 bytes a byte of text).  No shuffle of texts.
Extra columns are ignored, or kept where ``keep`` names them; a column named score comes back under a name that is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from citeloom.llm.common import documents, held_out, renamed, text_pieces, tidy
from citeloom.llm.sampling import labelled_texts

CHUNK, HOP = 512, 448
DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
LEARN_ROWS = 1500
STEPS, DOCS_A_STEP, CHUNKS_A_DOC = 400, 32, 6
LEARNING_RATE = 0.004
SEED = 11


def chunk_spans(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every chunk of the rows, and the number of chunks of each row (1 at least)."""
    size = np.diff(offs)
    per_row = np.maximum(1, -(-(size - (CHUNK - HOP)) // HOP))
    row = np.repeat(np.arange(len(size)), per_row)
    begin = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * HOP
    return begin, np.minimum(begin + CHUNK, offs[row + 1]), per_row


def cut_chunks(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of some chunks, a row each, padded with 0."""
    at = begin[:, None] + np.arange(CHUNK)[None, :]
    inside = at < end[:, None]
    at[~inside] = 0
    return np.where(inside, raw[at], 0).astype(np.uint8) if len(raw) else np.zeros(at.shape, np.uint8)


def chunk_matrix(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the rows and the number of chunks of each."""
    begin, end, per_row = chunk_spans(offs)
    return cut_chunks(raw, begin, end), per_row


class Network:
    """The parameters and their forward and backward passes."""

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        n = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": n(256, DIM, scale=0.5), "filters": n(WIDTH * DIM, FILTERS, scale=0.15), "f_bias": np.zeros(FILTERS, np.float32),
            "hidden": n(FILTERS, HIDDEN, scale=0.25), "h_bias": np.zeros(HIDDEN, np.float32), "out": n(2 * HIDDEN, scale=0.25), "o_bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Highest response of each filter in each chunk, and where it is (in bytes)."""
        x = self.p["embed"][chunks].reshape(len(chunks), CHUNK * DIM)
        best, where = None, None
        for phase in range(0, WIDTH, STRIDE):
            steps = (CHUNK - phase) // WIDTH
            y = x[:, phase * DIM : (phase + steps * WIDTH) * DIM].reshape(-1, WIDTH * DIM) @ self.p["filters"]
            y = y.reshape(len(chunks), steps, FILTERS)
            top = y.max(axis=1)
            if places:
                at = y.argmax(axis=1) * WIDTH + phase
                where = at if best is None else np.where(top > best, at, where)
            best = top if best is None else np.maximum(best, top)
        return best + self.p["f_bias"], where

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(np.maximum(pooled, 0) @ self.p["hidden"] + self.p["h_bias"])

    def combine(self, h: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum(per_row) - per_row
        z = np.concatenate([np.add.reduceat(h, first, axis=0) / per_row[:, None], np.maximum.reduceat(h, first, axis=0)], axis=1)
        return 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["o_bias"], -30, 30))), z

    def score(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        if self.constant is not None:
            return np.full(rows, self.constant)
        begin, end, per_row = chunk_spans(offs)
        h = np.concatenate([self.hidden(self.pooled(cut_chunks(raw, begin[i : i + 96], end[i : i + 96]))[0]) for i in range(0, len(begin), 96)])
        return self.combine(h, per_row)[0].astype(np.float64)

    def gradients(self, chunks: np.ndarray, per_row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        pooled, where = self.pooled(chunks, places=True)
        h = self.hidden(pooled)
        prob, z = self.combine(h, per_row)
        first, row = np.cumsum(per_row) - per_row, np.repeat(np.arange(len(per_row)), per_row)
        d = ((prob - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["out"][None, :]
        top = h == np.maximum.reduceat(h, first, axis=0)[row]
        dh = (dz[:, :HIDDEN] / per_row[:, None])[row] + dz[:, HIDDEN:][row] * top
        da = dh * (1 - h * h)
        r = np.maximum(pooled, 0)
        dr = (da @ p["hidden"].T) * (pooled > 0)
        # each filter's gradient flows to the one window that it responded to most
        at = where[:, :, None] + np.arange(WIDTH)
        window = chunks[np.arange(len(chunks))[:, None, None], at]
        seen = p["embed"][window].reshape(len(chunks), FILTERS, WIDTH * DIM)
        g_filters = np.einsum("cfk,cf->kf", seen, dr, optimize=True)
        back = dr[:, :, None] * p["filters"].T[None, :, :]
        byte = window.ravel()
        g_embed = np.stack([np.bincount(byte, part, minlength=256) for part in back.reshape(-1, DIM).T], axis=1).astype(np.float32)
        return {"embed": g_embed, "filters": g_filters, "f_bias": dr.sum(0), "hidden": r.T @ da, "h_bias": da.sum(0), "out": z.T @ d, "o_bias": d.sum(keepdims=True)}


def train(rows: list[tuple[str, int]], share: float, steps: int = STEPS, seed: int = SEED) -> Network:
    """``share`` is label 1's share among all labels, the sample's may differ."""
    net = Network(seed)
    y = np.array([label for _, label in rows], np.float32)
    if len(set(y.tolist())) < 2:
        net.constant = float(share) if len(y) else 0.5
        return net
    g = np.random.default_rng(seed)
    texts = [np.frombuffer(text.encode(), np.uint8) for text, _ in rows]
    by_label = [np.flatnonzero(y == k) for k in (0, 1)]
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        picks = np.concatenate([g.choice(rows_of, DOCS_A_STEP // 2) for rows_of in by_label])
        parts, per_row = [], []
        for i in picks:
            begin, end, _ = chunk_spans(np.array([0, len(texts[i])]))
            if len(begin) > CHUNKS_A_DOC:
                some = g.choice(len(begin), CHUNKS_A_DOC, replace=False)
                begin, end = begin[some], end[some]
            parts.append(cut_chunks(texts[i], begin, end))
            per_row.append(len(begin))
        rate = LEARNING_RATE * (1 - 0.9 * step / steps)
        for k, grad in net.gradients(np.concatenate(parts), np.array(per_row), y[picks]).items():
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    share = min(max(share, 0.02), 0.98)
    net.p["o_bias"] = (net.p["o_bias"] + np.log(share / (1 - share))).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*labelled_texts(docs, labels, "quality", held_out(3, 1), LEARN_ROWS))


def score_quality(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if none are named) and score for every row."""
    keep = keep or ["doc_id"]
    names = renamed(keep, ["score"])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, offs in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(sent.value.score(raw, offs), pa.float64())], names=[*names, "score"])

    schema = StructType([StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)] + [StructField("score", DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
