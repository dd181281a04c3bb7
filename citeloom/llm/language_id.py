"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; a document is parsed into the fewest left-to-right
phrases, each the longest match in that text.  With c phrases over a text of n characters, c * log2(n) bits are needed,
and ``LITERAL_BITS`` more for each letter that the text does not hold; the language that needs fewest bits per character
wins (the alphabetically first at a tie).

The parse walks transition tables in numpy, many stretches of ``STRETCH`` characters at once: each first from the start,
then from where the stretch before it ended, until it meets its own first walk; so a document of any length is parsed
as in one walk.  Letters are lower-cased; each letter of a language's labelled text has a class of its own there, a letter
that this text does not hold is a phrase of its own, and any run of other characters is one space.

Learned from every language with a labelled text outside the held-out fold: at most ``LEARN_DOCS`` texts (those with the
least hash of doc_id), the first ``LEARN_TEXT`` characters of each, and ``LEARN_CHARS`` characters a language; with many
languages both shrink, so that all together hold about ``ALL_CHARS`` and ``ALL_DOCS`` at most (one text each at least).

A text that is null, empty or without a letter is ``und`` with score 0.  If nothing can be learned, every row is ``und``.
A null doc_id is not held out and not learned from.  Repeated rows each get a row; an empty table gives none.  A text
of any length is read whole, at about 60 bytes of memory a character.  No shuffle of texts.  Extra columns are ignored,
or kept where ``keep`` names them; columns named lang_pred or score come back under a name that is free (``renamed``).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citeloom.llm.common import documents, held_out, renamed, resident, text_pieces, tidy
from citeloom.llm.sampling import texts_by_value

LEARN_DOCS = 60
LEARN_CHARS = 30_000
LEARN_TEXT = 20_000
ALL_CHARS, ALL_DOCS = 4_000_000, 4_000
#: Entries of a complete transition table; a larger one is kept as sorted pairs.
DENSE = 1 << 23
STRETCH = 256
#: Bits of a code point.
LITERAL_BITS = 20
UNDETERMINED = "und"


def fold(text: str) -> str:
    """Lower-case letters; every run of other characters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton of a text; an entry is next state * 2 + (1 if a phrase ended before this character).

    Classes of characters: 0 for a space, then the text's letters; the last is any other letter.
    """

    def __init__(self, codes: list[int], classes: int, dense: int | None = None):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        unknown = len(nexts)  # after a character that the text does not hold: a phrase of its own
        start = np.full(classes, unknown, np.int64)
        for c, q in nexts[0].items():
            start[c] = q
        self.size, self.classes = max(len(codes), 2), classes
        #: where an entry is missing a phrase ends, and the next begins at the start
        self.broken = start * 2 + 1
        states = np.repeat(np.arange(len(nexts)), [len(out) for out in nexts])
        keys = states * classes + np.fromiter((c for out in nexts for c in out), np.int64, len(states))
        values = np.fromiter((q * 2 for out in nexts for q in out.values()), np.int64, len(states))
        missing = np.setdiff1d(np.arange(classes), list(nexts[0]))  # from the start such a letter ends no phrase
        keys, values = np.concatenate([keys, missing]), np.concatenate([values, start[missing] * 2])
        self.table = None
        if (len(nexts) + 1) * classes <= (DENSE if dense is None else dense):
            self.table = np.tile(self.broken.astype(np.int32), len(nexts) + 1)
            self.table[keys] = values
        else:
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state * self.classes + code
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.broken[code])


class Parser:
    def __init__(self, learned: tuple[tuple[str, str], ...], dense: int | None = None):
        self.languages = [lang for lang, _ in learned]
        letters = sorted({c for _, text in learned for c in text if c != " "})
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.other = len(letters) + 1
        self.code_of = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                self.code_of[point] = code.get(low if len(low) == 1 else c, self.other)
        self.code_of[ord(" ")] = 0
        self.automata, self.own = [], []
        for _, text in learned:
            alphabet = sorted(set(text) - {" "})
            own = np.full(self.other + 1, len(alphabet) + 1, np.int32)  # class of each code in this language
            own[0] = 0
            own[[code[c] for c in alphabet]] = np.arange(1, len(alphabet) + 1)
            self.own.append(own)
            self.automata.append(Automaton([0 if c == " " else int(own[code[c]]) for c in text], len(alphabet) + 2, dense))

    def codes(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class codes of all rows, runs of non-letters made one, and each code's row."""
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.cumsum(np.concatenate([[0], (raw & 0xC0) != 0x80]))
        row = np.repeat(np.arange(len(offs) - 1), np.diff(starts[offs]))
        codes = self.code_of[points]
        same = np.concatenate([[False], (codes[1:] == 0) & (codes[:-1] == 0) & (row[1:] == row[:-1])])
        return codes[~same], row[~same]

    def phrases(self, codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Number of phrases, rows x languages."""
        out = np.zeros((rows, len(self.automata)))
        if not len(codes):
            return out
        size = np.bincount(row, minlength=rows)
        ends = np.cumsum(size)
        pieces = -(-size // STRETCH)
        of = np.repeat(np.arange(rows), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(ends - size, pieces) + number * STRETCH
        length = np.minimum(ends[of] - begin, STRETCH)
        # the longest first, so that those still running are a slice
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(number > 0, place[np.maximum(np.arange(len(of)) - 1, 0)], -1)[order]
        of, begin, length = of[order], begin[order], length[order]
        for k, automaton in enumerate(self.automata):
            flags = self._walk(automaton, self.own[k][codes], begin, length, before)
            out[:, k] = np.bincount(of, flags, minlength=rows) + (size > 0)
        return out

    @staticmethod
    def _walk(automaton: Automaton, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that end inside each stretch; ``before`` is the stretch that it continues (-1 for none)."""
        steps = int(length.max())
        alive = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        states, counts = (np.zeros((steps, len(length)), np.int32) for _ in range(2))
        state, count = (np.zeros(len(length), np.int32) for _ in range(2))
        for t, n in enumerate(alive.tolist()):
            got = automaton.step(state[:n].astype(np.int64), codes[begin[:n] + t])
            count[:n] += got & 1
            state[:n] = got >> 1
            states[t, :n], counts[t, :n] = state[:n], count[:n]
        end, total = state.copy(), count.copy()
        after = np.full(len(length), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            # the true walk comes in from the stretch before, until it is where the first walk was
            live, here, ended = todo, end[before[todo]].astype(np.int64), np.zeros(len(todo), np.int32)
            changed = []
            for t in range(steps):
                over = length[live] <= t
                if over.any():
                    gone = live[over]
                    changed.append(gone[end[gone] != here[over]])
                    end[gone], total[gone] = here[over], ended[over]
                    live, here, ended = live[~over], here[~over], ended[~over]
                if not len(live):
                    break
                got = automaton.step(here, codes[begin[live] + t])
                here, ended = (got >> 1).astype(np.int64), ended + (got & 1).astype(np.int32)
                met = here == states[t, live]
                if met.any():
                    done = live[met]
                    changed.append(done[end[done] != state[done]])
                    end[done], total[done] = state[done], ended[met] + count[done] - counts[t, done]
                    live, here, ended = live[~met], here[~met], ended[~met]
            changed.append(live[end[live] != here])
            end[live], total[live] = here, ended
            todo = after[np.concatenate(changed)]
            todo = todo[todo >= 0]
        return total

    def predict(self, raw: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offs) - 1
        codes, row = self.codes(raw, offs)
        letters = np.bincount(row, codes > 0, minlength=rows)
        lengths = np.maximum(np.bincount(row, minlength=rows), 1)
        if not self.automata:
            return [UNDETERMINED] * rows, np.zeros(rows)
        unknown = np.stack([np.bincount(row, own[codes] == a.classes - 1, minlength=rows) for own, a in zip(self.own, self.automata, strict=True)], axis=1)
        bits = (self.phrases(codes, row, rows) * np.log2([a.size for a in self.automata]) + LITERAL_BITS * unknown) / lengths[:, None]
        best = bits.argmin(axis=1)
        weight = np.exp2(-4.0 * (bits - bits.min(axis=1, keepdims=True)))
        score = np.where(letters > 0, 1.0 / weight.sum(axis=1), 0.0)
        return [self.languages[b] if n > 0 else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score


def learn(docs: DataFrame, fold_n: int = 4, fold_rest: int = 2) -> tuple[tuple[str, str], ...]:
    """The labelled text of each language, texts joined up to ``LEARN_CHARS``."""
    texts = texts_by_value(docs, "lang", held_out(fold_n, fold_rest), LEARN_DOCS, ALL_DOCS, LEARN_TEXT)
    learned = []
    most = min(LEARN_CHARS, ALL_CHARS // max(len(texts), 1) + 1)
    for lang, found in texts.items():
        kept, size = [], 0
        for text in found:
            folded = fold(text)[: max(most - size, 0)].strip()
            if folded:
                kept.append(folded)
                size += len(folded) + 1
        if kept:
            learned.append((lang, " ".join(kept)))
    return tuple(learned)


def identify(docs: DataFrame, learned: tuple[tuple[str, str], ...], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if none are named), lang_pred and score for every row."""
    keep = keep or ["doc_id"]
    names = renamed(keep, ["lang_pred", "score"])
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    name = blake2b(repr(learned).encode(), digest_size=16).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("languages", name), lambda: Parser(sent.value))
        for piece, raw, offs in text_pieces(batches):
            langs, scores = own.predict(raw, offs)
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = StructType([StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("score"))
