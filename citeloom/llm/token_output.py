"""Token ids in a compressed binary format, written and read back.

Documents in ascending doc_id order (range-partitioned) are encoded, ``END`` is appended to each, and the ids go to
groups of whole documents, each one binary value of a Parquet table: Spark's commit makes the write whole whatever
executors are lost, and any store that Spark can write to will do.  A group holds

    magic, counts, doc_ids, document lengths, the tables of orders 0 and 1, a table of blocks, and the blocks' code.

Blocks of ``BLOCK`` ids are reset on their own and carry a checksum of their code and one of their ids.  In a block a
range coder is driven by three predictions that are mixed:

* order 2: the id that followed the last two ids before, in this block, with a confidence; learned id by id;
* order 1: the group's frequencies of the ids that followed the last id, where they pay for their place in the table;
* order 0: the group's frequencies of all ids.

The shares of the three in the range are probabilities that adapt id by id in each block, kept for each pair of order
2's confidence and order 1's coverage.  Blocks of a group run in lock-step as lanes of numpy arrays.

``token_table`` reads the files and returns per document doc_id, start, n_tokens and ids_crc32.

Tokenizing is the library's, special tokens in a text included.  The pre-tokens of a text are independent in a byte-level
BPE, so ids are remembered per pre-token (bounded) and the library is asked for new ones; a batch's pre-tokens are found
and numbered as arrays, those of up to 16 bytes by these bytes as two numbers.  Texts with characters beyond ASCII and Latin letters are cut only before spaces that follow a
non-space, which no pre-token crosses.  A text with a
special token goes to the library whole.

A null text is encoded as empty (its only id is ``END``).  Null doc_ids come first.  Rows with equal doc_id are ordered
by their text's checksum (crc32, then xxhash64), equal rows are alike.  An empty text has one id, an empty table writes no
group and gives no rows.  Extra columns are ignored.  A group is held in memory whole: about 60 bytes an id of ``BLOCK`` *
``LANES`` ids, or of the longest document if that is longer.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.common import Known, Runs, documents, mix64, resident, text_pieces, tidy
from citeloom.llm.vocabulary import default_path
from citeloom.sources.scratch import temporary_path

END = 2
BLOCK, LANES = 1024, 3072
SLOT_BITS = 9
MAGIC = b"CLTOK3\0\0"
#: Pre-tokens of up to 16 bytes whose ids a worker remembers; longer ones and other parts, and their greatest length.
SHORT_WORDS, CACHE_WORDS, CACHE_CHARS = 900_000, 300_000, 64
#: Bytes of text that are tokenized at once: a word that is met again in them is looked up once.
PIECE = 1 << 22
#: Bits of the shares of the three orders, and of the frequencies of order 1 in them.
SHARE_BITS, ORDER1_BITS = 12, 14
#: Bytes that an entry of the order-1 table has to save.
ENTRY_BYTES = 3
#: Pairs of ids up to which entries are found in a table of all pairs (64 MB).
DIRECT = 1 << 24
#: Bits of the places in a bucket of entries.
BUCKET_BITS = 4
#: Blocks that are turned at once into rows of steps.
STRIP = 16
_EMPTY = (1 << 20) - 1
_ALL, _NO = np.int32(1 << SHARE_BITS), np.uint64(0)
_WORD_BITS = np.uint64(32)
_LOW_WORD = np.uint64(0xFFFFFFFF)


# ---------------------------------------------------------------- tokenizer

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[ -~\\n\\t\\r{_LETTERS}]*")
#: Kinds of a plain text's bytes: white space, letters (all bytes beyond ASCII are in letters), digits, others.
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x0A, 0x09, 0x0D]] = _WHITE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
#: Fixed value: the endings that the pre-tokenizer keeps with an apostrophe.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: A space and ASCII characters of one kind: one pre-token, wherever a space follows.
_ALONE = re.compile(r" (?:[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+)")
_JOINED = re.compile("(?s) [^\\s\u180e\u200b](?:.*[^\\s\u180e\u200b])?")
#: A space after anything that is no white space (nor counted as such by older tables): parts can be cut before it.
_BORDER = re.compile("(?<=[^\\s\u180e\u200b]) ")


def pre_tokens(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin: UTF-8 bytes of all texts, and each text's offset in them.

    Runs of one kind are pre-tokens.  The last sign of white space before something else stands on its own; a space
    there goes to what follows.  An apostrophe that follows no space takes one of its endings from the letters after it.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    ends = np.flatnonzero(begin[1:] & ~edge[1:-1] & (kind[:-1] == _WHITE))  # white space that something else follows
    begin[ends] = True
    begin[ends[raw[ends] == 0x20] + 1] = False
    marks = np.flatnonzero((raw[:-1] == 0x27) & begin[:-1] & (kind[1:] == _LETTER) & ~edge[1:-1])
    limit = np.append(offs, len(raw))[np.searchsorted(offs, marks, side="right")]
    for ending in _ENDINGS:
        fits = marks + len(ending) < limit
        for i, byte in enumerate(ending):
            fits &= raw[np.minimum(marks + 1 + i, len(raw) - 1)] == byte
        found = marks[fits]
        begin[found + 1] = False
        after = found + 1 + len(ending)
        begin[after[after < len(raw)]] = True
    return np.flatnonzero(begin)


#: The space in a byte-level piece.
_SPACE = "\u0120"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How byte-level pieces spell each byte: printed ones as they are, the others by the characters from 256 on.
_SPELLED = np.arange(256, dtype="<u2")
_SPELLED[np.delete(np.arange(256), _PRINTED)] = np.arange(256, 512 - len(_PRINTED))
#: Characters that spell the bytes of plain texts' words: ASCII, and letters of two bytes.
_WORD_CHARS = set(map(chr, _SPELLED[[*range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]].tolist()))
#: The first and the second 8 bytes of a word of n bytes, n up to 16, as masks.
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)
_SECOND = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(17)], np.uint64)


class ShortWords:
    """Numbers of words of 1 to 16 bytes, none of them 0, with their ids: two 64-bit numbers, filled up with 0, are a word.

    Open addressing, for all words of a batch at once; number 0 stands for no word.  Beyond ``limit`` words, the half that
    was asked for most often stays.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.first, self.second = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.runs, self.uses = Runs(np.zeros(0, np.uint32), np.zeros(1, np.int64)), np.zeros(1, np.int64)
        self._table(max(4, (2 * limit).bit_length()))

    def __len__(self) -> int:
        return len(self.first) - 1

    @staticmethod
    def of(data: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words at the given places, of ``size`` (1 to 16) bytes each."""
        eights = np.frombuffer(data + bytes(24 - len(data) % 8), "<u8")
        at, right = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
        left = np.uint64(64) - right  # a shift by 64 gives 0
        middle = eights.take(at + 1)
        first = (eights.take(at) >> right | middle << left) & _FIRST.take(size)
        return first, (middle >> right | eights.take(at + 2) << left) & _SECOND.take(size)

    def _table(self, bits: int) -> None:
        """An empty table of 2**bits slots, filled with the words there are."""
        self.bits, self.slots = bits, np.zeros(1 << bits, np.int32)
        self._place(np.arange(1, len(self.first)))

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        h = first ^ second * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def _place(self, numbers: np.ndarray) -> None:
        at = self._slot(self.first[numbers], self.second[numbers])
        while len(numbers):
            free = self.slots[at] == 0
            self.slots[at[free]] = numbers[free]  # of several words for one slot, one gets it
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], (at[lost] + 1) & (1 << self.bits) - 1

    def _found(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self._slot(first, second)
        numbers = self.slots.take(at)
        other = np.flatnonzero((self.first.take(numbers) != first) | (self.second.take(numbers) != second))
        while len(other := other[numbers[other] > 0]):
            at[other] = (at[other] + 1) & (1 << self.bits) - 1
            numbers[other] = self.slots[at[other]]
            other = other[(self.first[numbers[other]] != first[other]) | (self.second[numbers[other]] != second[other])]
        return numbers

    def find(self, first: np.ndarray, second: np.ndarray, ids_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The words' numbers; ``ids_of`` tells the ids of new ones, from rows of their 16 bytes, and their number by row."""
        if len(self) > self.limit:
            most = np.append(0, 1 + np.argsort(-self.uses[1:], kind="stable")[: self.limit // 2])
            self.first, self.second, self.uses = self.first[most], self.second[most], self.uses[most] // 2
            self.runs = Runs(*self.runs.take(most))
            self._table(self.bits)
        numbers = self._found(first, second)
        new = np.flatnonzero(numbers == 0)
        if len(new):
            new = new[np.lexsort((second[new], first[new]))]
            a, b = first[new], second[new]
            fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            known = len(self.first)
            numbers[new] = known - 1 + np.cumsum(fresh)
            a, b = a[fresh], b[fresh]
            self.runs.add(*ids_of(np.stack([a, b], 1).astype("<u8").view(np.uint8)))
            self.first, self.second = np.append(self.first, a), np.append(self.second, b)
            self.uses = np.append(self.uses, np.zeros(len(a), np.int64))
            if 4 * len(self.first) > 3 << self.bits:
                self._table((2 * len(self.first)).bit_length())
            else:
                self._place(np.arange(known, len(self.first)))
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers


class TextEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in made["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        before = made.get("pre_tokenizer") or {}
        #: Whether parts are independent: a plain byte-level BPE without a normalizer.
        self.by_parts = made.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        vocabulary = self.tokenizer.get_vocab()
        #: The library's pre-tokenizer, and one for joined words that are pre-tokens already, a space before each: it cuts at the
        #: spaces (spelled as in pieces), or at no sign of theirs if no piece of such signs goes over a border anyway.
        over = any(_SPACE in piece.lstrip(_SPACE) and _WORD_CHARS.issuperset(piece) for piece in vocabulary)
        self.whole, self.at_spaces = self.tokenizer.pre_tokenizer, pre_tokenizers.Split(_SPACE if over else "\n", "merged_with_next")
        #: bytes of each id: a byte-level piece is spelled with a character a byte
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(piece) for piece in vocabulary]
        self.known = Known([Runs(np.zeros(0, np.uint32), np.zeros(0, np.int64))], CACHE_WORDS, CACHE_CHARS)
        self.short = ShortWords(SHORT_WORDS)

    def plain(self, text: str) -> bool:
        """Whether ``pre_tokens`` tells the text's parts."""
        return self.by_parts and _PLAIN.fullmatch(text) is not None and (self.special is None or self.special.search(text) is None)

    def split(self, text: str) -> list[str]:
        """Parts of a text whose ids are independent; joined they give the text."""
        if not self.by_parts or (self.special is not None and self.special.search(text)):
            return [text] if text else []
        borders = [0, *[m.start() for m in _BORDER.finditer(text)], len(text)]
        return [text[a:b] for a, b in zip(borders, borders[1:], strict=False) if b > a]

    def _asked(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(surfaces, add_special_tokens=False)] if surfaces else []
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _asked_spelled(self, joined: list[str]) -> np.ndarray:
        """The ids of words that are pre-tokens, joined and spelled as in pieces."""
        self.tokenizer.pre_tokenizer = self.at_spaces
        try:
            return self._asked(joined)[0]
        finally:
            self.tokenizer.pre_tokenizer = self.whole

    def _by_word(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many of the ids of joined words belong to each word, from the words' bytes."""
        ends, own_ends = np.cumsum(self.size[ids]), np.cumsum(sizes)
        upto = np.searchsorted(ends, own_ends, side="right")
        if len(sizes) and not (len(ends) == upto[-1] and (ends[upto - 1] == own_ends).all()):
            raise ValueError("the library joined words over a border")
        return np.diff(upto, prepend=0)

    def pieces_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of plain texts' pre-tokens (rows of 16 bytes, filled up with 0), and their number by row.

        Those that begin with a space and go on with something else are sent joined, spelled as in pieces.
        """
        joined = (words[:, 0] == 0x20) & (words[:, 1] > 0) & (_KIND[words[:, 1]] != _WHITE)
        here, other = np.flatnonzero(joined), np.flatnonzero(~joined)
        there = words[here] > 0
        sizes = there.sum(1)
        signs = _SPELLED[words[here][there]].tobytes().decode("utf-16-le")
        cuts = np.append(0, np.cumsum(sizes))[[*range(0, len(here), 100), len(here)]].tolist()
        ids = self._asked_spelled([signs[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        rest, rest_lengths = self.library([w.decode() for w in np.ascontiguousarray(words[other]).view("S16").ravel().tolist()])
        both = Runs(np.concatenate([ids, rest]), np.concatenate([self._by_word(ids, sizes), rest_lengths]))
        place = np.empty(len(words), np.int64)
        place[np.concatenate([here, other])] = np.arange(len(words))
        return both.take(place)

    def library(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each surface.  Those that begin at a border are sent joined; bytes tell their ids apart.

        Single pre-tokens of ASCII go as the pieces spell them, so that the library need not look for pre-tokens again.
        """
        alone = np.fromiter(map(_ALONE.fullmatch, surfaces), bool, len(surfaces)) & self.by_parts
        joined = alone.copy()
        rest = np.flatnonzero(~alone)
        joined[rest] = np.fromiter((_JOINED.fullmatch(surfaces[i]) for i in rest.tolist()), bool, len(rest)) & self.by_parts
        if self.special is not None and self.special.search("".join(surfaces)):
            joined &= np.fromiter((self.special.search(x) is None for x in surfaces), bool, len(surfaces))
        alone &= joined
        single, more, other = np.flatnonzero(alone), np.flatnonzero(joined & ~alone), np.flatnonzero(~joined)
        here = np.concatenate([single, more])
        words = [surfaces[i] for i in here.tolist()]
        ids = self._asked_spelled(["".join(words[i : min(i + 100, len(single))]).replace(" ", _SPACE) for i in range(0, len(single), 100)])
        ids = np.concatenate([ids, self._asked(["".join(words[i : i + 100]) for i in range(len(single), len(words), 100)])[0]])
        own = self._by_word(ids, np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)))
        rest, rest_lengths = self._asked([surfaces[i] for i in other.tolist()])
        both = Runs(np.concatenate([ids, rest]), np.concatenate([own, rest_lengths]))
        place = np.empty(len(surfaces), np.int64)
        place[np.concatenate([here, other])] = np.arange(len(surfaces))
        return both.take(place)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and their number by text."""
        plain = np.fromiter(map(self.plain, texts), bool, len(texts))
        here, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, lengths = self._plain([texts[i] for i in here.tolist()])
        if not len(other):
            return ids, lengths
        parts = [self.split(texts[i]) for i in other.tolist()]
        words = list(chain.from_iterable(parts))
        rest, rest_lengths = self._remembered(words)
        rest_lengths = _sums(rest_lengths, np.fromiter(map(len, parts), np.int64, len(parts)))
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([here, other])] = np.arange(len(texts))
        return Runs(np.concatenate([ids, rest]), np.concatenate([lengths, rest_lengths])).take(place)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, and their number by text."""
        raws = [t.encode() for t in texts]
        data = b"".join(raws)
        offs = np.cumsum([0, *map(len, raws)])
        begin = pre_tokens(np.frombuffer(data, np.uint8), offs[:-1])
        own = np.diff(np.searchsorted(begin, offs))
        size = np.diff(begin, append=len(data))
        is_short = size <= 16
        here, long = np.flatnonzero(is_short), np.flatnonzero(~is_short)
        which = np.empty(len(begin), np.int64)
        which[here] = self.short.find(*ShortWords.of(data, begin[here], size[here]), self.pieces_of)
        runs = self.short.runs
        if len(long):
            values, lengths = self._remembered([data[a : a + n].decode() for a, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)])
            which[long] = len(runs.lengths) + np.arange(len(long))
            runs = Runs(np.concatenate([runs.values, values]), np.concatenate([runs.lengths, lengths]))
        ids, lengths = runs.take(which)
        return ids, _sums(lengths, own)

    def _remembered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens or other parts of texts, and their number by part."""
        which = self.known.find(words)
        if self.known.fresh:
            self.known.fill(self.library(self.known.fresh))
        (runs,) = self.known.runs
        long = np.flatnonzero(which < 0)
        if len(long):
            values, lengths = self.library([words[i] for i in long.tolist()])
            which[long] = len(runs.lengths) + np.arange(len(long))
            runs = Runs(np.concatenate([runs.values, values]), np.concatenate([runs.lengths, lengths]))
        return runs.take(which)


def _sums(values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of the first ``own[0]`` values, of the next ``own[1]``, and so on."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(own))])


# ---------------------------------------------------------------- coder

def _quantized(counts: np.ndarray, context: np.ndarray, contexts: int, bits: int) -> np.ndarray:
    """Counts as frequencies of 1 at least that add up to 2**bits in each context (rows sorted by context)."""
    if not len(counts):
        return np.zeros(0, np.int64)
    rows = np.bincount(context, minlength=contexts)
    sums = np.zeros(contexts, np.int64)
    np.add.at(sums, context, counts)
    freq = np.maximum(1, counts * ((1 << bits) - rows[context]) // sums[context])
    given = np.zeros(contexts, np.int64)
    np.add.at(given, context, freq)
    # the rest goes to the most frequent row of the context
    order = np.lexsort((-counts, context))
    most = order[np.concatenate([[True], context[order][1:] != context[order][:-1]])]
    freq[most] += (1 << bits) - given[context[most]]
    return freq


class Order0:
    """Frequencies of a group's ids, which are numbered by rank."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts.astype(np.int64)
        self.bits = max(16, len(ids).bit_length() + 2)
        if self.bits > 32 - SHARE_BITS:
            raise ValueError("a group has more distinct ids than the format has room for")
        self.freq = _quantized(self.counts, np.zeros(len(ids), np.int64), 1, self.bits)
        self.first = np.cumsum(self.freq) - self.freq


class Order1:
    """Frequencies of ranks that follow a rank: entries sorted by (context, rank)."""

    def __init__(self, distinct: int, keys: np.ndarray, counts: np.ndarray, cover: np.ndarray):
        """``keys`` are context * distinct + rank; ``cover`` is 0 (no entries) to 3 by context, the last for a block's start."""
        self.keys, self.counts, self.cover = keys, counts, cover
        context, self.rank = np.divmod(keys, max(distinct, 1))
        self.freq = _quantized(counts, context, distinct + 1, ORDER1_BITS)
        self.begin = np.cumsum(self.freq) - self.freq  # 2**ORDER1_BITS for each context with entries, so this goes on
        there = np.bincount(context, minlength=distinct + 1) > 0
        #: where each context's range begins in ``begin``
        self.base = (np.cumsum(there) - there).astype(np.int64) << ORDER1_BITS
        self.first = self.begin - self.base[context]
        #: places of all contexts' ranges
        self.total = int(there.sum()) << ORDER1_BITS

    @classmethod
    def learn(cls, order0: Order0, ranks: np.ndarray, previous: np.ndarray) -> tuple[Order1, np.ndarray]:
        """The table, and the entry of each id (-1 for none)."""
        distinct = len(order0.ids)
        small = (distinct + 1) * distinct < 1 << 31
        pairs = previous.astype(np.int32 if small else np.int64)
        pairs *= max(distinct, 1)
        pairs += ranks
        ordered = np.sort(pairs)
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(pairs)])
        keys, counts = ordered[begin].astype(np.int64), np.diff(np.append(begin, len(pairs)))
        del ordered
        context, rank = np.divmod(keys, max(distinct, 1))
        total = np.zeros(distinct + 1, np.int64)
        np.add.at(total, context, counts)
        saved = counts * np.log2((counts / total[context]) / (order0.freq[rank] / float(1 << order0.bits)))
        kept = (saved > 8 * ENTRY_BYTES) & (context < distinct)
        # a context has room for half as many entries as its range has places; the best stay
        if np.bincount(context[kept]).max(initial=0) > 1 << (ORDER1_BITS - 1):
            best = np.lexsort((-saved, context, ~kept))[: int(kept.sum())]
            inside = np.arange(len(best)) - np.searchsorted(context[best], context[best])
            kept[best[inside >= 1 << (ORDER1_BITS - 1)]] = False
        covered = np.zeros(distinct + 1, np.int64)
        np.add.at(covered, context[kept], counts[kept])
        cover = np.where(covered == 0, 0, 1 + (2 * covered > total) + (10 * covered > 9 * total)).astype(np.uint8)
        table = keys[kept].astype(pairs.dtype)
        if (distinct + 1) * distinct <= DIRECT:
            number = np.full((distinct + 1) * distinct, -1, np.int32)
            number[table] = np.arange(len(table))
            entry = number.take(pairs)
        else:
            entry = np.full(len(pairs), -1, np.int32)
            if len(table):
                at = np.minimum(np.searchsorted(table, pairs), len(table) - 1)
                np.copyto(entry, at, where=table[at] == pairs, casting="same_kind")
        return cls(distinct, keys[kept], counts[kept], cover), entry


def _both(order0: Order0, order1: Order1, shift: int) -> np.ndarray:
    """Where the range of each entry begins (above 32 bits) and its frequency: entries of order 1 and, after them, of order 0."""
    return np.concatenate([order1.first << shift, order0.first]) << 32 | np.concatenate([order1.freq << shift, order0.freq])


class Entries:
    """Entries of order 1 and, after them, of order 0 along one line of places, for the way back from a place.

    A place of order 0 is a bucket of its own, so only entries of order 1 are searched for.
    """

    def __init__(self, order0: Order0, order1: Order1, shift: int):
        begin = np.concatenate([order1.begin, order1.total + (order0.first << BUCKET_BITS)])
        end = order1.total + (1 << order0.bits + BUCKET_BITS)
        self.rank = np.concatenate([order1.rank, np.arange(len(order0.ids))]).astype(np.int32)
        self.both = _both(order0, order1, shift)
        # the entry at the first place of each bucket: a search starts there
        buckets = np.diff((begin + (1 << BUCKET_BITS) - 1) >> BUCKET_BITS, append=(end >> BUCKET_BITS) + 1)
        self.bucket = np.repeat(np.arange(len(begin), dtype=np.int32), buckets)
        self.next = np.append(begin[1:], np.iinfo(np.int64).max)

    def entry_at(self, places: np.ndarray) -> np.ndarray:
        """The entry that holds each place."""
        entry = self.bucket.take(places >> BUCKET_BITS)
        later = (self.next.take(entry) <= places).nonzero()[0]
        while len(later):
            entry[later] += 1
            later = later[self.next.take(entry[later]) <= places[later]]
        return entry


class Lanes:
    """The adaptive state of all blocks: order 2's guesses and the shares; the same steps on either side, all integers."""

    def __init__(self, n: int, start: int, cover: np.ndarray):
        self.slots = np.full(n << SLOT_BITS, _EMPTY, np.int32)  # guess, and confidence (0 to 3) above 20 bits
        # probabilities in 16 bits that order 2 is right, and (lower half) that order 1 has the id if not
        self.shares = np.full(n * 16, 1 << 29 | 3 << 14, np.int32)
        self.one, self.context = np.full(n, start, np.int64), np.zeros(n, np.int16)
        self.slot_base, self.state_base = np.arange(n) << SLOT_BITS, np.arange(n) * 16
        self.cover = cover
        #: a rank's bits in the context of order 2; of the rank before, the lower ones stay
        self.bits = (mix64(np.arange(start + 1, dtype=np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int16)

    def predict(self, k: int) -> None:
        """For the first k lanes: order 2's guess, and the places in 2**SHARE_BITS where the shares of orders 1 and 0 begin."""
        self.at = self.slot_base[:k] + self.context[:k]
        self.held = self.slots.take(self.at)
        self.guess = self.held & _EMPTY
        self.conf = self.held >> 20
        self.state = self.state_base[:k] + self.cover.take(self.one[:k])
        self.state += self.conf << 2
        both = self.shares.take(self.state)
        self.p2, self.p1 = both >> 16, both & 0xFFFF
        self.cut1 = (self.p2 >> 4) + 1
        cut2 = 4095 - self.cut1
        cut2 *= self.p1
        cut2 >>= 16
        cut2 += self.cut1
        cut2 += 1
        self.cut2 = cut2

    def update(self, ranks: np.ndarray, right: np.ndarray, by1: np.ndarray) -> None:
        """``right``: the lanes whose guess was the id; ``by1``: 1 where order 1 has it (int32)."""
        k = len(ranks)
        p2, p1, held = self.p2, self.p1, self.held
        old1 = p1[right]
        # probabilities stay in 15 to 32,655 (of 2**15) and 15 to 65,295 (of 2**16), so every share has a place
        p2 -= p2 >> 4
        p2[right] += 2040
        p1 += by1 * np.int32(4080)
        p1 -= p1 >> 4
        p1[right] = old1
        p2 <<= 16
        p2 |= p1
        self.shares[self.state] = p2
        # a guess that fails loses confidence, and its place when it has none left
        changed = ranks | np.int32(1 << 20)
        sure = (self.conf > 1).nonzero()[0]
        changed[sure] = held[sure] - (1 << 20)
        changed[right] = np.minimum(held[right] + (1 << 20), self.guess[right] | 3 << 20)
        self.slots[self.at] = changed
        context = self.context[:k]
        context <<= 5
        context ^= self.bits.take(ranks)
        context &= (1 << SLOT_BITS) - 1
        self.one[:k] = ranks


def _lengths(total: int) -> np.ndarray:
    n = -(-total // BLOCK)
    return np.minimum(BLOCK, total - np.arange(n) * BLOCK)


def _alive(lengths: np.ndarray, steps: int) -> list[int]:
    """How many blocks (the first ones) are longer than t, for each t."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()


def _by_step(values: np.ndarray, lanes: int) -> np.ndarray:
    """Row t has the value at place t of each block."""
    out = np.zeros((BLOCK, lanes), values.dtype)
    whole = len(values) // BLOCK
    blocks = values[: whole * BLOCK].reshape(whole, BLOCK)
    for a in range(0, whole, STRIP):  # a strip of blocks at a time stays in the processor's cache
        out[:, a : min(a + STRIP, whole)] = blocks[a : a + STRIP].T
    if whole < lanes:
        out[: len(values) - whole * BLOCK, whole] = values[whole * BLOCK :]
    return out


def code_blocks(ranks: np.ndarray, entry: np.ndarray, order0: Order0, order1: Order1) -> tuple[np.ndarray, np.ndarray]:
    """32-bit words of all blocks one after another, and the number of words of each."""
    lengths = _lengths(len(ranks))
    n = len(lengths)
    steps = int(lengths.max(initial=0))
    bits = np.uint64(order0.bits)
    total_bits = np.uint64(SHARE_BITS + order0.bits)
    entries = len(order1.keys)
    both = _both(order0, order1, order0.bits - ORDER1_BITS).view(np.uint64)
    ranks = ranks.astype(np.int32)
    which = _by_step(np.where(entry >= 0, entry, ranks + np.int32(entries)), n)
    ranks = _by_step(ranks, n)
    lanes = Lanes(n, len(order0.ids), order1.cover)
    low, size = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    room = steps + 3
    out = np.zeros(n * room, np.uint64)  # a word each; a carry is added to the word before
    end = np.arange(n) * room
    whole = np.uint64(1 << order0.bits)
    for t, k in enumerate(_alive(lengths, steps)):
        lanes.predict(k)
        own, e = ranks[t, :k], which[t, :k]
        one = e < entries
        right = (lanes.guess == own).nonzero()[0]
        place = np.where(one, lanes.cut1, lanes.cut2).astype(np.uint64)
        width = np.where(one, lanes.cut2, _ALL).astype(np.uint64)
        width -= place
        own_freq = both.take(e)
        own_first = own_freq >> _WORD_BITS
        own_freq &= _LOW_WORD
        place[right], width[right], own_first[right], own_freq[right] = _NO, lanes.cut1[right], _NO, whole
        unit = size[:k] >> total_bits
        own_first *= width
        place <<= bits
        own_first += place
        own_first *= unit
        lo = low[:k]
        lo += own_first
        carry = (lo < own_first).nonzero()[0]
        if len(carry):
            out[end[carry] - 1] += np.uint64(1)
        sz = size[:k]
        np.multiply(unit, width, out=sz)
        sz *= own_freq
        full = (sz <= _LOW_WORD).nonzero()[0]
        to = end[full]
        word = lo[full]
        out[to] = word >> _WORD_BITS
        end[full] = to + 1
        lo[full] = word << _WORD_BITS
        sz[full] <<= _WORD_BITS
        lanes.update(own, right, one.astype(np.int32))
    for shift_ in (_WORD_BITS, np.uint64(0)):
        out[end] = low >> shift_ & _LOW_WORD
        end += 1
    while len(over := np.flatnonzero(out > _LOW_WORD)):
        out[over] &= _LOW_WORD
        out[over - 1] += np.uint64(1)
    sizes = end - np.arange(n) * room
    return out.reshape(n, room)[np.arange(room) < sizes[:, None]].astype("<u4"), sizes


def decode_blocks(words: np.ndarray, sizes: np.ndarray, total: int, order0: Order0, order1: Order1) -> np.ndarray:
    """The ranks of all blocks."""
    lengths = _lengths(total)
    n = len(lengths)
    steps = int(lengths.max(initial=0))
    bits, total_bits = np.uint64(order0.bits), np.uint64(SHARE_BITS + order0.bits)
    top = np.uint64((1 << (SHARE_BITS + order0.bits)) - 1)
    shift = order0.bits - ORDER1_BITS
    lanes = Lanes(n, len(order0.ids), order1.cover)
    words = np.concatenate([words, np.zeros(4, "<u4")]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    code = (words[at] << _WORD_BITS) | words[at + 1]  # less the low end of the range, which is 0 first
    at += 2
    size = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    table = Entries(order0, order1, shift)
    base0, whole = int(order1.total), 1 << order0.bits
    out = np.zeros((steps, n), np.int32)
    for t, k in enumerate(_alive(lengths, steps)):
        lanes.predict(k)
        cd, sz = code[:k], size[:k]
        unit = sz >> total_bits
        value = np.minimum(cd // unit, top).view(np.int64)
        share = value >> order0.bits
        right = (share < lanes.cut1).nonzero()[0]
        after = share >= lanes.cut2
        place = np.where(after, lanes.cut2, lanes.cut1).astype(np.int64)
        width = np.where(after, _ALL, lanes.cut2).astype(np.int64)
        width -= place
        start = place << order0.bits
        value -= start
        value[right] = 0
        # quotients of integers below 2**32 are exact in doubles
        inner = (value / width).astype(np.int64)
        inner <<= np.where(after, BUCKET_BITS + shift, 0)
        inner >>= shift
        inner += np.where(after, base0, order1.base.take(lanes.one[:k]))
        e = table.entry_at(inner)
        own = table.rank.take(e)
        both = table.both.take(e)
        first, freq = both >> 32, both & 0xFFFFFFFF
        own[right] = lanes.guess[right]
        start[right], width[right], first[right], freq[right] = 0, lanes.cut1[right], 0, whole
        first *= width
        first += start
        cd -= unit * first.view(np.uint64)
        freq *= width
        np.multiply(unit, freq.view(np.uint64), out=sz)
        full = (sz <= _LOW_WORD).nonzero()[0]
        p = at[full]
        cd[full] = (cd[full] << _WORD_BITS) | words[p]
        at[full] = p + 1
        sz[full] <<= _WORD_BITS
        out[t, :k] = own
        lanes.update(own, right, (~after).astype(np.int32))
    flat = np.zeros((n, BLOCK), np.int32)
    flat[:, :steps] = out.T
    return flat.ravel()[:total]


# ---------------------------------------------------------------- groups

def pack_group(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One group of whole documents in the file format."""
    ids = ids.astype(np.int64)
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        ranks = (np.cumsum(counts > 0) - 1).astype(np.int32)[ids]
        counts = counts[values]
    else:
        values, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order0 = Order0(values, counts)
    previous = np.concatenate([[len(values)], ranks[:-1]])[: len(ranks)]
    previous[::BLOCK] = len(values)
    order1, entry = Order1.learn(order0, ranks, previous)
    words, sizes = code_blocks(ranks, entry, order0, order1)
    starts = np.cumsum(sizes) - sizes
    code_sums = [zlib.crc32(words[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    little = ids.astype("<u4")
    id_sums = [zlib.crc32(little[a : a + BLOCK]) for a in range(0, len(little), BLOCK)]
    context, rank = np.divmod(order1.keys, max(len(values), 1))
    parts = [
        np.array([i is None for i in doc_ids], np.uint8).tobytes(),
        np.diff(np.array([0 if i is None else i for i in doc_ids], "<i8"), prepend=np.int64(0)).astype("<i8").tobytes(),
        lengths.astype("<u4").tobytes(),
        np.diff(values, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(),
        _planes(np.bincount(context, minlength=len(values) + 1)) + _planes(np.diff(rank, prepend=0)) + _planes(order1.counts) + order1.cover.tobytes(),
        sizes.astype("<u4").tobytes() + np.array(code_sums, "<u4").tobytes() + np.array(id_sums, "<u4").tobytes(),
    ]
    packed = [zlib.compress(p) for p in parts]
    head = struct.pack("<6Q", len(doc_ids), len(ids), len(values), len(order1.keys), len(sizes), len(words)) + struct.pack("<6Q", *map(len, packed))
    return MAGIC + head + struct.pack("<I", zlib.crc32(head + b"".join(packed))) + b"".join(packed) + words.tobytes()


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, the first bytes of all first: better packed that way."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def unpack_group(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, document lengths and all ids; raises ValueError where a checksum fails."""
    if data[:8] != MAGIC:
        raise ValueError("not a token group")
    head = data[8:104]
    docs, total, distinct, entries, blocks, n_words, *lens = struct.unpack("<12Q", head)
    (check,) = struct.unpack("<I", data[104:108])
    body = data[108 : 108 + sum(lens)]
    if zlib.crc32(head + body) != check:
        raise ValueError("the head of a token group is damaged")
    cuts = np.cumsum([0, *lens])
    null, names, lengths, table0, table1, index = (zlib.decompress(body[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    table0 = np.frombuffer(table0, "<u4").astype(np.int64)
    order0 = Order0(np.cumsum(table0[:distinct]), table0[distinct:])
    a, b = 4 * (distinct + 1), 4 * entries
    context = np.repeat(np.arange(distinct + 1), _unplanes(table1[:a]))
    rank = np.cumsum(_unplanes(table1[a : a + b]))
    order1 = Order1(distinct, context * max(distinct, 1) + rank, _unplanes(table1[a + b : a + 2 * b]), np.frombuffer(table1[a + 2 * b :], np.uint8))
    sizes, code_sums, id_sums = np.frombuffer(index, "<u4").reshape(3, blocks)
    words = np.frombuffer(data, "<u4", count=n_words, offset=108 + sum(lens))
    starts = np.cumsum(sizes.astype(np.int64)) - sizes
    for a, n, s in zip(starts.tolist(), sizes.tolist(), code_sums.tolist(), strict=True):
        if zlib.crc32(words[a : a + n]) != s:
            raise ValueError("the code of a block is damaged")
    flat = order0.ids.astype("<u4")[decode_blocks(words, sizes.astype(np.int64), total, order0, order1)] if total else np.zeros(0, "<u4")
    for b, s in enumerate(id_sums.tolist()):
        if zlib.crc32(flat[b * BLOCK : (b + 1) * BLOCK]) != s:
            raise ValueError("the ids of a block are not those that were written")
    numbers = np.cumsum(np.frombuffer(names, "<i8"))
    return [None if z else i for z, i in zip(null, numbers.tolist(), strict=True)], np.frombuffer(lengths, "<u4").astype(np.int64), flat


# ---------------------------------------------------------------- Spark

def write_tokens(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Write the groups of all documents, in ascending doc_id order, to the folder ``out``."""
    path = path or default_path("byte_bpe_50k.json")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("tokens", path), lambda: TextEncoder(path))
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = pack_group(names, np.concatenate(held), np.concatenate(counts))
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for piece, _, _ in text_pieces(batches, limit=PIECE):
            ids, lengths = encoder.encode([t or "" for t in piece.column("text").to_pylist()])
            held.append(np.insert(ids, np.cumsum(lengths), np.uint32(END)))
            counts.append(lengths + 1)
            names += piece.column("doc_id").to_pylist()
            size += len(held[-1])
            if size >= BLOCK * LANES:
                yield flush()
                names, held, counts, size, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(raw), F.xxhash64(raw)]
    # rows of one doc_id (or none) are many in the worst case: their checksums part them too
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(tidy(run), "part int, seq int, n_docs long, n_tokens long, data binary").write.parquet(out)


def token_table(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    groups = spark.read.parquet(out)
    by_part = groups.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    part_start = by_part.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    in_part = groups.select(F.col("part").alias("p"), F.col("seq").alias("s"), F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("group_start"))
    starts = in_part.join(part_start, "p").select("p", "s", (F.col("part_start") + F.col("group_start")).alias("first"))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, lengths, flat = unpack_group(batch.column("data")[r].as_py())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                part, seq = (batch.column(c)[r].as_py() for c in ("part", "seq"))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(doc_ids), pa.int32()), pa.array([seq] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], schema=schema)

    read = groups.select("part", "seq", "data").mapInArrow(tidy(run), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporary_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), out)
    return token_table(spark, out)
