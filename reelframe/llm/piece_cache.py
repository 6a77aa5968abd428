"""Encoding of texts piece by piece, each distinct piece once.

A text is cut at places over which no token of the vocabulary can reach, so the ids of a text are those of its pieces
one after the other.  Pieces repeat far more often than texts, so a task keeps the ids of up to KEPT pieces; beyond
that it keeps new ones for the batch at hand.  Texts for which the cut would not be exact are encoded whole.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

from reelframe.llm.common import release

KEPT = 150_000
BATCH_CHARS = 500_000
#: Behind a word of letters these are one pre-token, whatever the kind of file; no added token ends with them alone.
TAIL = "!#$%&()*+,-./:;=?@[]^_`{}~\\\""
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_DOUBLE_SPACE = re.compile(r"\s\s|\x00")


class PieceCache:
    """Base: subclasses say how a text is cut and what the ids of new pieces are."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # ids of pre-tokens, which many pieces share

    def forget(self, new: list[str]) -> None:
        """Leaves KEPT words, the first ones."""
        for word in new[max(0, KEPT - len(self.words) + len(new)) :]:
            del self.words[word]

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def ids_of(self, pieces: list[str]) -> Iterable[bytes]:
        """For each piece its ids as little-endian unsigned 32-bit integers."""
        raise NotImplementedError

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        batch, chars = [], 0
        for text in texts:
            batch.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from self._encode(batch)
                batch, chars = [], 0
        yield from self._encode(batch)

    @contextlib.contextmanager
    def task(self) -> Iterator[PieceCache]:
        """Forgets the pieces at the end of a task, as Spark keeps the worker for tasks of other kinds."""
        try:
            yield self
        finally:
            self.known, self.words = {}, {}
            release()

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        cuts = [self.pieces(text) for text in texts]
        new = list(set().union(*cuts).difference(self.known)) if cuts else []
        self.known.update(zip(new, self.ids_of(new), strict=True))
        for cut in cuts:
            yield b"".join(map(self.known.__getitem__, cut))
        for piece in new[max(0, KEPT - len(self.known) + len(new)) :]:
            del self.known[piece]


class LibraryCache(PieceCache):
    """Ids by the tokenizers library for a vocabulary file of one of two kinds; other kinds are encoded text by text."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before, normalizer = said.get("pre_tokenizer") or {}, said.get("normalizer")
        self.kind = "text"
        if normalizer is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.kind = "spaced"
        elif drops_spaces(said):
            self.kind = "words"
        self.symbols = {b: c for b, c in enumerate(byte_symbols())}
        self.space = self.symbols[32]

    def pieces(self, text: str) -> list[str]:
        if self.kind == "words" and not _ODD_SPACE.search(text):
            return text.split()
        if self.kind == "spaced" and not _DOUBLE_SPACE.search(text):  # each single space begins a piece, a line end is one
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return [text]

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """A word of letters, normalised, and what follows it; None for other pieces."""
        word = piece.rstrip(TAIL)
        if self.kind == "text" or not word[self.kind == "spaced" and word.startswith(" ") :].isalpha():
            return None
        tail = piece[len(word) :]
        if self.kind == "words":
            word = (word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")).lower()
            if not word.isalpha():
                return None
        return word, tail

    def ids_of(self, pieces: list[str]) -> Iterable[bytes]:
        """Words of letters go to the library's model; all else takes its whole way, added tokens included."""
        model, known, new, out = self.tokenizer.model.tokenize, self.words, [], []
        for piece in pieces:
            parts = self._parts(piece)
            if parts is None:
                out.append(array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes())
                continue
            for word in parts:
                if word not in known:
                    if word.isascii():
                        unit = self.space + word[1:] if word.startswith(" ") else word
                    else:
                        unit = word.encode().decode("latin-1").translate(self.symbols)
                    known[word] = array("I", [token.id for token in model(unit)] if unit else []).tobytes()
                    new.append(word)
            out.append(known[parts[0]] + known[parts[1]])
        self.forget(new)
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def drops_spaces(said: dict) -> bool:
    """Whether a tokenizer file drops white space and joins nothing over it."""
    parts = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    steps = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
    return parts.get("type") == "Split" and parts.get("behavior") == "Removed" and bool(parts.get("invert")) and steps == ["NFC", "Replace", "Lowercase"]


@functools.lru_cache(maxsize=4)
def library_cache(path: str) -> LibraryCache:
    """One cache for each vocabulary file and worker process."""
    return LibraryCache(path)
