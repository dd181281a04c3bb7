"""The public 32k piece vocabulary (path is a parameter), as tables for the encoder and the counter."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE_MARK = "▁"


def default_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """pieces, scores and kinds; ``surface[i]`` is the bytes that id i stands for in a decoded text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        self.surface = [p.replace(SPACE_MARK, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_byte(i):
                value = int(self.pieces[i][3:5], 16)
                self.byte_id[value] = i
                self.surface[i] = bytes([value])
            elif not self.normal[i]:
                self.surface[i] = b""
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        self.cut = self._cut()

    def _cut(self) -> re.Pattern:
        """A pattern whose matches part a text where no piece can stand across.

        White space that is in no longer piece stands alone; a run of marks and *openers* is cut from what is before it.
        Openers are the ASCII punctuation that no piece holds after anything but a mark or another opener.
        """
        before: dict[str, set[str]] = {}
        within: set[str] = set()
        for p in self.id_of:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
                within |= {a, b}
        alone = "".join(c for c in "\n\t\r\v\f" if c not in within)
        openers = {c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()} | {SPACE_MARK}
        while wrong := {c for c in openers if before.get(c, set()) - openers}:
            openers -= wrong
        if SPACE_MARK not in openers:
            return re.compile(r"(?s).+")
        o, i = re.escape("".join(sorted(openers))), re.escape(alone)
        return re.compile(f"[{i}]|[{o}]*[^{o}{i}]+|[{o}]+" if i else f"[{o}]*[^{o}]+|[{o}]+")

    def segments(self, marked: str) -> list[str]:
        """Parts of a text (spaces already marked) that are segmented on their own; joined they give the text."""
        return self.cut.findall(marked)


@lru_cache(4)
def load(path: str) -> Vocabulary:
    """One copy for each Python worker."""
    return Vocabulary(path)
