"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges run as in SentencePiece's BPE: an agenda holds the adjacent pairs that form a piece; the one of best score
(the leftmost at a tie) is popped, and merged unless a keyed hash skips it.  A skipped candidate is gone until a
neighbour's merge forms a new pair there.  The hash is keyed by seed, doc_id (with the copy's number, where there are
copies) and the candidate's place in the text, so each candidate of each occurrence is drawn on its own; the same
document always gets the same ids.  ``dropout=0`` gives
SentencePiece's own ids.  Of a word only its merges without skips are remembered: an occurrence none of whose merges is
skipped has those ids, any other runs its own agenda.

The agenda runs over many words at once (numpy, a row per word); characters without a piece become byte pieces, also a
literal U+2581, which marks spaces inside pieces.  Decoding ids gives back every text to the byte.

A null text has null ids; an empty text has none.  Nulls in doc_id hash as an empty string.  Repeated rows each get a
row, with the same ids.  An empty table gives no rows.  No shuffle; extra columns are ignored, whatever their names.
Memory is bounded by the longest text (about 100 bytes a byte of it) or a piece of 1 MB, and by ``CACHE_WORDS``.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import Known, Runs, documents, mix64, mix_int, resident, text_pieces, tidy
from citeloom.llm.vocabulary import SPACE_MARK, default_path, load

DROPOUT = 0.1
SEED = 20240229
#: Words whose ids and merges a worker remembers; beyond them the rarer half is let go.
CACHE_WORDS = 250_000
#: Longer words are not remembered (place and end of a merge fit a byte each).
CACHE_CHARS = 255
#: Stands among the words for a literal U+2581 of the text.
LITERAL_MARK = "\0" + SPACE_MARK
_NONE = np.int32(1 << 30)
_BITS = 20


class Encoder:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        self.vocabulary = v = load(path)
        self.dropout, self.seed = dropout, seed
        # the order of popping: best score first
        order = sorted(v.id_of.values(), key=lambda i: (-v.scores[i], i))
        self.rank = np.full(len(v.pieces), _NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array(order, np.int32)
        chars = {p: i for p, i in v.id_of.items() if len(p) == 1}
        self.char_id = np.full(0x110000, -1, np.int32)
        for c, i in chars.items():
            self.char_id[ord(c)] = i
        pairs = {}
        for p, i in v.id_of.items():
            for k in range(1, len(p)):
                a, b = v.id_of.get(p[:k]), v.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = self.rank[i]
        self._table(pairs)
        mark = v.byte_id[list(SPACE_MARK.encode())].astype(np.uint16)
        none = np.zeros(0, np.uint16)
        #: ids, and merges with none skipped, of the words met so far
        self.known = Known([Runs(none, np.zeros(0, np.int64)), Runs(none, np.zeros(0, np.int64))], CACHE_WORDS, CACHE_CHARS)
        self.mark = (mark, np.array([len(mark)])), (none, np.zeros(1, np.int64))
        self.surfaces = Runs(np.frombuffer(b"".join(v.surface), np.uint8), np.array([len(x) for x in v.surface]))

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing with a few probes, so that lookups are array operations."""
        size = 1 << _BITS
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), 1
        slots = self._slot(np.array(list(pairs), np.int64))
        for key, slot in zip(pairs, slots.tolist(), strict=True):
            step = 0
            while self.keys[(slot + step) & (size - 1)] >= 0:
                step += 1
            self.keys[(slot + step) & (size - 1)], self.values[(slot + step) & (size - 1)] = key, pairs[key]
            self.probes = max(self.probes, step + 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two ids form; ``_NONE`` if none (ids of -1 form none)."""
        key = (a.astype(np.int64) << 16) | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] >= 0) & (key >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & ((1 << _BITS) - 1)
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        return out

    def merge_rank(self, a: int, b: int) -> int:
        """``_merged`` of one pair."""
        if a < 0 or b < 0:
            return int(_NONE)
        key = a << 16 | b
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - _BITS)
        while (held := self.keys.item(slot)) >= 0:
            if held == key:
                return self.values.item(slot)
            slot = (slot + 1) & ((1 << _BITS) - 1)
        return int(_NONE)

    def encode_words(self, words: list[str], keys: np.ndarray | None = None) -> tuple[Runs, Runs]:
        """Ids of each word, and its merges (place << 8 | end) if ``keys`` is None: then none is skipped."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        ids, merges = (Runs(np.zeros(0, np.uint16), np.zeros(0, np.int64)) for _ in range(2))
        at = 0
        while at < len(order):
            # words of like length share a block of bounded size
            longest = max(8, 2 * int(lengths[order[at]]))
            to = int(np.searchsorted(lengths[order], longest, side="right"))
            to = min(max(to, at + 1), at + max(1, (1 << 17) // longest))
            rows = order[at:to]
            own = None if keys is None else keys[rows]
            if lengths[rows[0]] > CACHE_CHARS:
                for i, r in enumerate(rows.tolist()):
                    ids.add(*self._long(words[r], None if own is None else int(own[i])))
                    merges.add(np.zeros(0, np.uint16), np.zeros(1, np.int64))
            else:
                made, path = self._block([words[r] for r in rows.tolist()], lengths[rows], own)
                ids.add(*made)
                merges.add(*path)
            at = to
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Runs(*ids.take(place)), Runs(*merges.take(place))

    def _long(self, word: str, key: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, its agenda a heap, so that time grows with length * log(length)."""
        n = len(word)
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        ids = self.char_id[points].astype(np.int32)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), np.ones(n, bool)
        ranks = self._merged(ids[:-1], ids[1:])
        agenda = [(int(ranks[i]), i, i + 1, i + 2) for i in np.flatnonzero(ranks < _NONE).tolist()]
        heapq.heapify(agenda)
        held = ids.tolist()
        draw = int(self.dropout * float(1 << 53))
        while agenda:
            rank, left, right, end = heapq.heappop(agenda)
            # a candidate stands as long as both its pieces do
            if not alive[left] or right >= n or not alive[right] or after[left] != right or after[right] != end:
                continue
            if key is not None and mix_int(key ^ (left << 32) ^ end) >> 11 < draw:
                continue
            held[left] = int(self.by_rank[rank])
            alive[right] = False
            after[left] = end
            if end < n:
                before[end] = left
                r = self.merge_rank(held[left], held[end])
                if r < _NONE:
                    heapq.heappush(agenda, (r, left, end, after[end]))
            if (prior := before[left]) >= 0:
                r = self.merge_rank(held[prior], held[left])
                if r < _NONE:
                    heapq.heappush(agenda, (r, prior, left, end))
        return self._with_bytes(np.array(held, np.int32)[alive], points[alive], np.array([int(alive.sum())]))

    def _block(self, words: list[str], lengths: np.ndarray, keys: np.ndarray | None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        m, width = len(words), int(lengths.max(initial=1))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(m), lengths)
        col = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((m, width + 1), -1, np.int32)
        ids[row, col] = self.char_id[points]
        following = np.tile(np.arange(1, width + 2, dtype=np.int32), (m, 1))
        following[row, col] = np.minimum(col + 1, lengths[row])
        previous = np.tile(np.arange(-1, width, dtype=np.int32), (m, 1))
        alive = np.zeros((m, width + 1), bool)
        alive[row, col] = True
        agenda = np.full((m, width + 1), _NONE, np.int32)
        last = col + 1 < lengths[row]
        agenda[row[last], col[last]] = self._merged(ids[row[last], col[last]], ids[row[last], col[last] + 1])
        merges = [(np.zeros(0, np.int64), np.zeros(0, np.uint16))]
        live = np.arange(m)
        while len(live):
            best = agenda[live].argmin(axis=1) if len(live) < m else agenda.argmin(axis=1)
            rank = agenda[live, best]
            on = rank < _NONE
            live, best, rank = live[on], best[on], rank[on]
            if not len(live):
                break
            right = following[live, best]
            end = following[live, right]
            if keys is not None:
                skip = self._skipped(keys[live], best, end)
                agenda[live[skip], best[skip]] = _NONE
                go = ~skip
            else:
                go = slice(None)
                if self.dropout > 0:
                    merges.append((live, (best << 8 | end).astype(np.uint16)))
            r, p, q, e = live[go], best[go], right[go], end[go]
            ids[r, p] = self.by_rank[rank[go]]
            alive[r, q] = False
            agenda[r, q] = _NONE
            following[r, p] = e
            more = e < lengths[r]
            previous[r[more], e[more]] = p[more]
            new = np.full(len(r), _NONE, np.int32)
            new[more] = self._merged(ids[r[more], p[more]], ids[r[more], e[more]])
            agenda[r, p] = new
            left = previous[r, p]
            has = left >= 0
            agenda[r[has], left[has]] = self._merged(ids[r[has], left[has]], ids[r[has], p[has]])
        of, codes = (np.concatenate(x) for x in zip(*merges, strict=True))
        path = codes[np.argsort(of, kind="stable")], np.bincount(of, minlength=m)
        return self._with_bytes(ids[alive], points[alive[row, col]], alive.sum(axis=1)), path

    def _skipped(self, keys: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mix64(keys ^ (place.astype(np.uint64) << np.uint64(32)) ^ end.astype(np.uint64))
        return (h >> np.uint64(11)) < np.uint64(int(self.dropout * float(1 << 53)))

    def _with_bytes(self, ids: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by row; a character without a piece becomes the ids of its UTF-8 bytes."""
        bare = ids < 0
        if not bare.any():
            return ids.astype(np.uint16), lengths
        size = np.where(bare, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
        out = np.repeat(ids, size)
        raw = np.frombuffer(points[bare].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[out < 0] = self.vocabulary.byte_id[raw]
        return out.astype(np.uint16), np.bincount(np.repeat(np.arange(len(lengths)), lengths), size, minlength=len(lengths)).astype(np.int64)

    def word_keys(self, key: int, n: int) -> np.ndarray:
        """A key for each of the first ``n`` words of the text that ``key`` stands for."""
        own = mix64(np.array([(key + self.seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        return mix64(own + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def encode_texts(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and their number by text; ``keys`` stand for the documents in the skip hash."""
        v, known = self.vocabulary, self.known
        if LITERAL_MARK not in known:
            known.find([LITERAL_MARK])
            known.fill(*self.mark)
        words: list[str] = []
        in_text = np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            before = len(words)
            if SPACE_MARK in text:
                for k, part in enumerate(text.split(SPACE_MARK)):
                    words += [LITERAL_MARK] * (k > 0) + v.segments(("" if k else SPACE_MARK) + part.replace(" ", SPACE_MARK))
            elif text:
                words += v.segments(SPACE_MARK + text.replace(" ", SPACE_MARK))
            in_text[t] = len(words) - before
        which = known.find(words)
        if known.fresh:
            known.fill(*((r.values, r.lengths) for r in self.encode_words(known.fresh)))
        known_ids, known_merges = known.runs
        long = which < 0
        again = long
        drawn = None
        if self.dropout > 0 and len(words):
            drawn = np.concatenate([np.zeros(0, np.uint64), *[self.word_keys(key, n) for key, n in zip(keys, in_text.tolist(), strict=True) if n]])
            short = np.flatnonzero(~long)
            codes, n = known_merges.take(which[short])
            word = np.repeat(short, n)
            again = long.copy()
            again[word[self._skipped(drawn[word], codes >> 8, codes & 255)]] = True
        redo = np.flatnonzero(again)
        own, _ = self.encode_words([words[i] for i in redo.tolist()], None if drawn is None else drawn[redo])
        # one pool of ids: what is known, and what was drawn anew
        pool = Runs(np.concatenate([known_ids.values, own.values]), np.concatenate([known_ids.lengths, own.lengths]))
        which[redo] = len(known_ids.lengths) + np.arange(len(redo))
        ids, lengths = pool.take(which)
        return ids, np.bincount(np.repeat(np.arange(len(texts)), in_text), lengths, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes, of one text's ids."""
        return self.surfaces.take(ids)[0].astype(np.uint8).tobytes()[1:]

    def lossless(self, ids: np.ndarray, lengths: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to its bytes (``raw``, cut at ``offs``)."""
        got, n = self.surfaces.take(ids)
        size = np.bincount(np.repeat(np.arange(len(lengths)), lengths), n, minlength=len(lengths)).astype(np.int64)
        some = lengths > 0
        right = np.diff(offs) == size - some
        # the mark before the first word is no part of the text
        first = np.zeros(len(got), bool)
        first[(np.cumsum(size) - size)[some]] = True
        if right.all():
            wrong = np.flatnonzero(got[~first] != raw)
            right[np.searchsorted(offs, wrong, side="right") - 1] = False
            return right
        ends = np.cumsum(size)
        return np.array([ok and (got[e - k + (k > 0) : e] == raw[a:b]).all() for ok, e, k, a, b in zip(right, ends, size, offs[:-1], offs[1:], strict=True)])


def encode_pieces(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED, with_ids: bool = True, apart: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 16-bit ids), lossless, and ids if asked for.

    With ``apart``, equal rows are copies with numbers, each segmented on its own.  They are brought together by doc_id and text
    for that, so it does not matter how the rows lie.
    """
    path = path or default_path()
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("pieces", path, dropout, seed), lambda: Encoder(path, dropout, seed))
        last, number = None, 0
        for piece, raw, offs in text_pieces(batches):
            texts = piece.column("text").to_pylist()
            doc_ids = piece.column("doc_id")
            names = [str("" if i is None else i) for i in doc_ids.to_pylist()]
            if apart:
                for k, own in enumerate(zip(names, texts, strict=True)):
                    number = number + 1 if own == last else 0
                    last = own
                    names[k] = f"{names[k]}:{number}" if number else names[k]
            keys = [int.from_bytes(blake2b(f"{seed}:{n}".encode(), digest_size=8).digest()) for n in names]
            ids, lengths = encoder.encode_texts([t or "" for t in texts], keys)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            little = memoryview(ids.astype("<u2")).cast("B")
            sums = [zlib.crc32(little[2 * a : 2 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            none = np.array([t is None for t in texts], bool)
            columns = [doc_ids, pa.array(lengths, pa.int64(), mask=none), pa.array(np.array(sums, np.int64), pa.int64(), mask=none), pa.array(encoder.lossless(ids, lengths, raw, offs), pa.bool_(), mask=none)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)), mask=pa.array(none)))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spec = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    rows = docs.select("doc_id", "text")
    if apart:
        together = rows.withColumn("_text", F.xxhash64("text"))
        rows = together.repartition("doc_id", "_text").sortWithinPartitions("doc_id", "_text").select("doc_id", "text")
    return rows.mapInArrow(tidy(run), spec)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), with_ids=False)
