"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

The vocabulary is the public 32k piece file with its scores, read as a unigram model.  An Aho-Corasick automaton
enumerates all pieces that end at each character; per character only the best score and the number of pieces of that
best path are carried.  The rules are those of unigram tokenizers with byte fallback: a path is replaced only by a
strictly better score, so at a tie the one whose last piece starts first (the longest last piece) stays; a character
that is no piece costs the least score less 10 and counts as its UTF-8 bytes.  Scores are added as doubles.

Texts are cut before each run of space marks, where no piece can stand across; the counts of cut parts are
remembered per worker (bounded), since words repeat.

A null text has a null count, an empty text 0; repeated rows each get a row; an empty table gives none.  No shuffle;
extra columns are ignored, whatever their names.  A text of any length is counted whole; a part without a border costs
about 300 bytes of memory a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.common import documents, resident, text_pieces, tidy
from citeloom.llm.vocabulary import SPACE_MARK, default_path, load

UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 400_000


class Counter(dict):
    """Maps a cut part of a text to its number of tokens; parts not seen before are worked out."""

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick

        self.vocabulary = v = load(path)
        self.automaton = ahocorasick.Automaton()
        for piece, i in v.id_of.items():
            self.automaton.add_word(piece, (len(piece), v.scores[i]))
        self.automaton.make_automaton()
        self.unknown = min(v.scores) - UNKNOWN_PENALTY
        self.single = {p for p in v.id_of if len(p) == 1}

    def __missing__(self, part: str) -> int:
        n = self.count_part(part)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(part) <= 64:
            self[part] = n
        return n

    def count_part(self, part: str) -> int:
        size = len(part)
        score = [0.0] + [None] * size
        pieces = [0] * (size + 1)
        single, unknown = self.single, self.unknown
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for end, match in self.automaton.iter(part):
            ends[end + 1].append(match)
        for end in range(1, size + 1):
            best, n = None, 0
            for length, own in sorted(ends[end], reverse=True):  # earliest start first
                got = score[end - length] + own
                if best is None or got > best:
                    best, n = got, pieces[end - length] + 1
            char = part[end - 1]
            if char not in single:
                got = score[end - 1] + unknown
                if best is None or got > best:
                    best, n = got, pieces[end - 1] + len(char.encode())
            score[end], pieces[end] = best, n
        return pieces[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.vocabulary.segments(SPACE_MARK + text.replace(" ", SPACE_MARK))))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens for every row."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("counts", path), lambda: Counter(path))
        for piece, _, _ in text_pieces(batches):
            counts = [None if t is None else counter.count(t) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
