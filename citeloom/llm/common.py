"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.scratch import drop_stash, shared_dir, stash

__all__ = ["Known", "Runs", "documents", "drop_stash", "held_out", "mix64", "mix_int", "n_words", "renamed", "resident", "shared_dir", "ship", "stash", "text_pieces", "tidy", "word_spans", "words"]

#: Java and DuckDB regex of the white space that parts words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that no node needs it installed."""
    context = spark.sparkContext
    if getattr(context, "_citeloom_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="citeloom-")  # the driver serves the archive to the workers from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "citeloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._citeloom_sent = True


def held_out(n: int, rest: int, doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod n is ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)) == rest, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def renamed(names: list[str], taken: list[str]) -> list[str]:
    """``names``, with underscores put before those that are in ``taken`` until each name is free."""
    used = set(taken) | set(names)
    out = []
    for name in names:
        new = name
        if name in taken:
            while new in used:
                new = f"_{new}"
            used.add(new)
        out.append(new)
    return out


# ---------------------------------------------------------------- Arrow batches

def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into pieces of about ``limit`` text bytes (one row at least).

    Yields the piece, its UTF-8 bytes as one array and the row offsets into it; a null text has no bytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        if pa.types.is_large_string(col.type):
            kind = np.int64
        else:
            col, kind = col.cast(pa.string()), np.int32
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = col.slice(at, to - at)
            _, offs, data = part.buffers()
            offs = np.frombuffer(offs, kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
            offs = offs - offs[0]
            if part.null_count:
                # a null may own bytes in theory; its length counts as 0 here
                own = lengths[at:to]
                if own.sum() != offs[-1]:
                    raw = b"".join((x or "").encode() for x in part.to_pylist())
                    raw, offs = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(own)])
            yield batch.slice(at, to - at), raw, offs
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """``mix64`` of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


class Runs:
    """Rows of small numbers in one array."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values, self.lengths = np.concatenate([self.values, values]), np.concatenate([self.lengths, lengths])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the given rows, one after the other, and their number by row."""
        first = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[rows]
        at = np.arange(int(n.sum())) + np.repeat(first[rows] - (np.cumsum(n) - n), n)
        return self.values[at], n


class Known(dict):
    """Numbers of the strings met so far, for each of which some ``runs`` are kept; new strings wait in ``fresh``.

    Strings of more than ``longest`` characters are not remembered (-1).  Beyond ``limit`` strings, the half that was
    asked for most often stays.
    """

    def __init__(self, runs: list[Runs], limit: int, longest: int):
        super().__init__()
        self.runs, self.limit, self.longest = runs, limit, longest
        self.fresh: list[str] = []
        self.uses = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        if len(word) > self.longest:
            return -1
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def find(self, words: list[str]) -> np.ndarray:
        """The numbers of words; fill ``runs`` for ``fresh`` (in this order) before they are taken."""
        if len(self) > self.limit:
            most = np.argsort(-self.uses, kind="stable")[: self.limit // 2]
            names = list(self)
            self.clear()
            self.update((names[i], k) for k, i in enumerate(most.tolist()))
            self.runs = [Runs(*r.take(most)) for r in self.runs]
            self.uses = self.uses[most] // 2
        which = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.uses = np.concatenate([self.uses, np.zeros(len(self) - len(self.uses), np.int64)]) + np.bincount(which[which >= 0], minlength=len(self))
        return which

    def fill(self, *made: tuple[np.ndarray, np.ndarray]) -> None:
        for runs, new in zip(self.runs, made, strict=True):
            runs.add(*new)
        self.fresh = []


_resident: dict = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """The one model or table that this Python worker holds: made once, and let go when another is asked for."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system at the task's end, since idle workers live on beside other stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_KEY = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one pass of prefix sums (polynomial, modulo 2**64)."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        power = np.full(n + 1, _ROOT, np.uint64)
        back = np.full(n + 1, _BACK, np.uint64)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        self.back = back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_KEY[raw] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 32


def word_spans(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of the rows; ``inside`` marks the bytes of words (default: not white space)."""
    ok = ~IS_SPACE[raw] if inside is None else inside
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True  # a row's border ends a word
    before = np.concatenate([[False], ok[:-1]])
    start = np.flatnonzero(ok & (~before | edge[:-1]))
    after = np.concatenate([ok[1:], [False]])
    end = np.flatnonzero(ok & (~after | edge[1:])) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    return start, end, row
