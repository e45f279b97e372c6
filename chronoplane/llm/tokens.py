"""Token ids as a public tokenizer library gives them.

The vocabulary's merges run on bytes, in a compiled encoder that takes a text
whole and hands its ids back as bytes, so nothing is kept between texts.  It
can't split a run of hundreds of thousands of white space characters; such texts
are split by the same pattern in another engine.  Texts with characters that two
regular expression engines may class differently, and texts that may hold the
string of a special token, go to the library whole.

Counting looks pre-tokens up instead, and what stands between two spaces.  Single
spaces are safe to cut at: a pre-token starts at a space unless more white space
follows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Mapping

import regex
import tiktoken
from tokenizers import Tokenizer

#: The pre-token pattern of the byte-level tokenizer, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside plain Latin text.
ODD = r"[^\t\n\r -~¡-¬®-ɏ]"
#: Entries that a worker remembers of each kind; what is met later isn't kept.
CACHE = 300_000


class PreTokens(dict):
    """Text -> value, computed on a miss and kept while there is room."""

    def __init__(self, compute: Callable, most: int = CACHE):
        super().__init__()
        self._compute, self._most = compute, most

    def __missing__(self, piece: str):
        value = self._compute(piece)
        if len(self) < self._most:
            self[piece] = value
        return value


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts, as unsigned little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        # A file may ask for either; whole texts have neither.
        self.library.no_truncation()
        self.library.no_padding()
        byte = byte_of()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        # The same merges on bytes, without the library's cost per call.
        self._core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._split = regex.compile(PATTERN).findall
        self._odd, self._runs = re.compile(ODD).search, re.compile(r" (?:\s|\Z)").search

    def by_library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _foreign(self, text: str) -> bool:
        """Whether only the library knows the ids of a text."""
        return "<|" in text or self._odd(text) is not None

    def n_ids(self, piece: str) -> int:
        return len(self._core.encode_single_piece(piece.encode()))

    def pieces(self, text: str) -> list[str]:
        return self._split(text)

    def after(self, x: str) -> list[str]:
        """The pre-tokens of a space and what follows it up to the next; letters alone are one."""
        return [" " + x] if x.isalpha() else self._split(" " + x)

    def values(self, text: str, known: Mapping, between: Mapping) -> list | None:
        """The values of a text's parts, or None where the library must see it whole."""
        if self._foreign(text):
            return None
        if self._runs(text):
            return [known[p] for p in self._split(text)]
        first, *rest = text.split(" ")
        return [known[p] for p in self._split(first)] + [between[x] for x in rest]

    def ids(self, text: str) -> bytes:
        if self._foreign(text):
            return self.by_library(text)
        try:
            return bytes(self._core.encode_to_tiktoken_buffer(text, set()))
        except ValueError:  # white space beyond the engine's stack
            ids = [i for p in self._split(text) for i in self._core.encode_single_piece(p.encode())]
            return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
