"""Token ids from public tokenizer files, with the words seen so far kept, as most of a text is words seen before."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import regex

from . import common

#: What the word tokenizer splits a text into; no match holds white space.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: White space and separators of Latin-1 that aren't in the ASCII white space at which words are cut.
ODD_SPACE = regex.compile("[\x1c-\x1f\x85\xa0]")
#: Words kept in each of two generations; when the younger is full, the older is dropped.
KEPT_WORDS = 350_000


class WordEncoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them, as little-endian uint32 bytes.

    The tokenizer lowers case, drops white space, and no token spans it, so a text's ids are those of its words one after
    another. An unseen word of plain Latin letters and signs is split as the tokenizer splits it and its parts go to the
    tokenizer's merges; any other unseen word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.pattern = regex.compile(WORD_PATTERN)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _part(self, part: str) -> bytes:
        key = part.encode()
        if (ids := self.young.get(key) or self.old.get(key)) is None:
            shown = part if part.isascii() and part.isprintable() else key.decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.merge(shown)]).tobytes()
            self.young[key] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and max(text) < "Ā":
            return self._part(text.lower())
        # beyond Latin-1, normalisation may change how a word splits
        if max(text) < "Ā" and "<|" not in text and not ODD_SPACE.search(text):
            return b"".join([self._part(part) for part in self.pattern.findall(text.lower())])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null."""
        found = []
        for text in texts:
            data = (text or "").encode()
            words = (data if b"<|" in data else data.lower()).split()
            if len(self.young) > KEPT_WORDS:
                self.old, self.young = self.young, {}
            young, old = self.young, self.old
            parts = list(map(young.get, words))
            if None in parts:
                for k, ids in enumerate(parts):
                    if ids is None:
                        word = words[k]
                        if (ids := young.get(word)) is None:
                            if (ids := old.get(word)) is None:
                                ids = self._word(word)
                            young[word] = ids
                        parts[k] = ids
            found.append(b"".join(parts))
        return found


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file; workers are reused, so the words seen serve later tasks."""
    return WordEncoder(path)


common.kept_by("tokens", word_encoder.cache_clear)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
