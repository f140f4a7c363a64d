"""A byte-pair tokenizer to a fixed number of ids; vocabulary and merges are parameters."""

from __future__ import annotations

from collections.abc import Sequence

import regex

# The names of the start and end marks, the contractions, and the end mark of a word.
START_TEXT, END_TEXT = "<|startoftext|>", "<|endoftext|>"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
END = "</w>"

#: Pieces of a text: a mark, a contraction, letters, one number, or a run of other characters.
_PIECE = regex.compile("|".join([regex.escape(START_TEXT), regex.escape(END_TEXT), *CONTRACTIONS, r"\p{L}+", r"\p{N}", r"[^\s\p{L}\p{N}]+"]), regex.IGNORECASE)


def byte_symbols() -> list[str]:
    """A character for each byte: printable ones of Latin-1 stand for themselves, the others for the next free ones from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


_SYMBOLS = byte_symbols()


class PairTokenizer:
    """Start id, the pieces' ids, end id, then zeros up to ``length``; ``joined_end``: the end mark is part of the last symbol.

    A piece is read as its UTF-8 bytes, each by its symbol; symbols that the vocabulary lacks get the end id.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]], start: int, end: int, length: int = 77, joined_end: bool = True):
        self.vocabulary, self.rank = vocabulary, {m: i for i, m in enumerate(merges)}
        self.start, self.end, self.length, self.joined_end = start, end, length, joined_end
        self.known: dict[str, list[str]] = {}

    def pieces(self, word: str) -> list[str]:
        if word not in self.known:
            parts = [*word[:-1], word[-1] + END] if self.joined_end else [*word, END]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
                pair = (parts[best], parts[best + 1])
                if pair not in self.rank:
                    break
                merged, i = [], 0
                while i < len(parts):
                    hit = i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair
                    merged.append(parts[i] + parts[i + 1] if hit else parts[i])
                    i += 2 if hit else 1
                parts = merged
            self.known[word] = parts
        return self.known[word]

    def encode(self, text: str | None) -> list[int]:
        marks = {START_TEXT: self.start, END_TEXT: self.end}
        ids: list[int] = []
        for piece in _PIECE.findall((text or "").lower().strip()):
            if piece in marks:
                ids.append(marks[piece])
            else:
                ids += [self.vocabulary.get(p, self.end) for p in self.pieces("".join(_SYMBOLS[b] for b in piece.encode()))]
        ids = [self.start, *ids[: self.length - 2], self.end]
        return ids + [0] * (self.length - len(ids))
