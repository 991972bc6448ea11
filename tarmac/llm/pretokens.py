"""Tokenizer files, and exact encoding of texts piece by piece through bounded caches in the workers."""

from __future__ import annotations

import base64
import re

import numpy as np

CACHE = 400_000

#: White space, letters and numbers below U+0250 and common punctuation are the same in every Unicode
#: version; a text with any other character is encoded whole by the library.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞]")
_loaded: dict = {}


def plain(text: str, special: tuple[str, ...]) -> bool:
    """Whether the text may be cut into pieces: only usual characters and no string of a special token."""
    return (text.isascii() and not _CONTROL.search(text) or not _UNUSUAL.search(text)) and not any(s in text for s in special)


_CONTROL = re.compile("[\x1c-\x1f]")


class Lengths(dict):
    """Token counts of white-space-delimited pieces: a given table of frequent ones, the rest encoded and kept.

    The tokenizer lower-cases, drops white space and joins nothing across it, so the count of a text is the
    sum over its pieces.
    """

    def __init__(self, path: str, frequent: dict[str, int] = {}, limit: int = CACHE):  # noqa: B006
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.limit = len(frequent) + limit
        self.marks = {c: len(self.library.encode(c, add_special_tokens=False).ids) for c in ".,;:!?"}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        # A mark that follows a letter or digit is a token of its own.
        if piece[-1] in self.marks and len(piece) > 1 and piece[-2].isascii() and piece[-2].isalnum():
            n = self[piece[:-1]] + self.marks[piece[-1]]
        else:
            n = self.whole(piece)
        if len(self) < self.limit:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not plain(text, self.special):
            return self.whole(text)
        return sum(map(self.__getitem__, text.lower().split()))


class Ids:
    """Ids of byte-level BPE as little-endian 32-bit bytes.

    The same vocabulary as ranks (the .tiktoken file beside the .json) is some four times as quick; it is
    used where both must agree, and the tokenizer library for all other texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.fast = ranks_beside(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or not plain(text, self.special):
            return self.whole(text)
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def ranks_beside(path: str):
    import os

    import public_tokenizers
    import tiktoken

    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside):
        return None
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def once(kind, path: str, *more):
    """One cache for each worker process, kind and file, shared by its tasks."""
    key = (kind, path)
    if key not in _loaded:
        _loaded[key] = kind(path, *more)
    return _loaded[key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
