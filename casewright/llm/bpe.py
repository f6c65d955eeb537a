"""BPE encoding and decoding, byte level, by dynamic programming over prefixes.

For every prefix of a pre-token there is one token with which the exact encoding of that prefix ends. An automaton over
the vocabulary names, at each position, all tokens that are suffixes of the prefix up to there; the one whose left
neighbour (the stored last token of the prefix before it) it can stand beside is stored. Following these back from the end
gives the ids that the merge rules give, without running merges.

Two tokens can stand side by side if no merge across their border comes before the merges that formed them: such a merge
joins a token on the right edge of the left one's merge tree and a token on the left edge of the right one's.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

#: How byte-level BPE splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks of text kept in each of two generations.
KEPT_CHUNKS = 350_000
KEPT_PAIRS = 1_000_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if printable in Latin-1, else from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, their merges and the automaton of a byte-level BPE file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet, model = byte_alphabet(), file["model"]
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        self.bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in ids.items():
            if text not in special:
                self.bytes[i] = bytes(alphabet[c] for c in text)
        for text, i in special.items():
            self.bytes[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for n, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = n
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, n
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(len(self.bytes)):
            if (t := self.bytes[i]) and t not in self.special and self._whole(i):
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.special_pattern = re.compile(b"|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True))) if self.special else None

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens on one edge of a token's merge tree, each with the rank of the merge that takes it up."""
        if (found := self.edges.get((token, right))) is None:
            found, taken, at = [], NEVER, token
            while True:
                found.append((at, taken))
                if at not in self.parts:
                    break
                taken = self.born[at]
                at = self.parts[at][right]
            self.edges[token, right] = found
        return found

    def crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether some merge across the border of two tokens comes first, of those ranked under ``before``.

        Among merges of one rank, the leftmost goes first: one across the border loses to one inside the left token.
        """
        for a, a_taken in self.edge(left, True):
            for b, b_taken in self.edge(right, False):
                n = self.rank.get((a, b))
                if n is not None and n < before and n < a_taken and n <= b_taken:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself; its parts must, and no merge may cross them too early."""
        while token in self.parts:
            left, right = self.parts[token]
            if self.crossed(left, right, self.born[token]) or (right in self.parts and not self._whole(right)):
                return False
            token = left
        return True

    def beside(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = not self.crossed(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        last: list[int] = [-1] * len(piece)
        sizes: list[int] = [0] * len(piece)
        known = self.pairs.get
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - size
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                fits = known(left << 32 | token)
                if not (self.beside(left, token) if fits is None else fits):
                    continue
            last[end], sizes[end] = token, size
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out


#: Python's and the pattern's white space beyond ASCII, and separators on which the two differ.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_HEADS = {b" ", *(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}
_TAILS = {b".", b",", b";", b":", b"!", b"?"}
_MIXED_SPACE = re.compile(rb"^[\x09-\x0D]|[\x09-\x0D] | [\x09-\x0D]|  |[ \x09-\x0D]$")


class Encoder:
    """Encodes whole texts; chunks of text seen before are looked up."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, chunk: bytes) -> bytes:
        encode = self.vocabulary.encode
        # a word of plain letters is one pre-token, and so is a sign of this list behind one
        if chunk[1:].isalpha() and chunk[:1] in _HEADS:
            return array("I", encode(chunk)).tobytes()
        if chunk[-1:] in _TAILS and chunk[1:-1].isalpha() and chunk[:1] in _HEADS:
            return self._chunk(chunk[:-1]) + self._chunk(chunk[-1:])
        return array("I", [i for piece in self.pattern.findall(chunk.decode()) for i in encode(piece.encode())]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        if (ids := self.young.get(chunk)) is None:
            if (ids := self.old.get(chunk)) is None:
                ids = self._ids(chunk)
            if len(self.young) >= KEPT_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids
        return ids

    def _ordinary(self, data: bytes) -> bytes:
        """Ids of text without special tokens.

        Between a character that is not white space and a space there is always a border of pre-tokens, and what
        follows doesn't depend on what came before. So a text whose spaces stand alone is cut at each of them.
        """
        if not data:
            return b""
        if _MIXED_SPACE.search(data) or _ODD_SPACE.search(text := data.decode()):
            # borders at white-space runs would need care: pre-tokens one by one
            return b"".join([self._chunk(piece.encode()) for piece in self.pattern.findall(data.decode())])
        first, *rest = data.split(b" ")
        out = [self._chunk(first)] if first else []
        get, chunk = self.young.get, self._chunk
        for word in rest:
            key = b" " + word
            out.append(get(key) or chunk(key))
            if self.young is not get.__self__:
                get = self.young.get
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        data, special = text.encode(), self.vocabulary.special_pattern
        if special is None or not special.search(data):
            return self._ordinary(data)
        out, at = [], 0
        for m in special.finditer(data):
            out += [self._ordinary(data[at : m.start()]), np.array([self.vocabulary.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(data[at:])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file; workers are reused."""
    return Encoder(path)


common.kept_by("bpe", encoder.cache_clear)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the text's ids as array<int>. A column of that name is replaced; all others stay.

    Null and empty texts have no ids. Special tokens in a text are recognised, as the tokenizers library does. Each text is
    encoded by itself and whole, so repeated rows and ids get equal results, an empty table an empty one; rows go by in batches.
    """
    return _mapped(docs, text_col, ids_col, T.ArrayType(T.IntegerType(), False), lambda column: _encoded(column, path))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of array<int> ids, special tokens included; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text.

    A column named ``text_col`` is replaced; all others stay. Each row stands alone: repeated rows get equal texts, an empty table stays empty.
    """
    return _mapped(docs, ids_col, text_col, T.StringType(), lambda column: _decoded(column, path))


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, f) -> DataFrame:
    common.prepare(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c != target or c == source])
    at = kept.columns.index(source)
    names = [c for c in kept.columns if c != target]
    schema = T.StructType([kept.schema[c] for c in names] + [T.StructField(target, kind, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("bpe")
        for batch in batches:
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            yield pa.RecordBatch.from_arrays([*[columns[n] for n in names], f(batch.column(at))], names=[*names, target])

    return kept.mapInArrow(run, schema)


def _encoded(texts: pa.Array, path: str) -> pa.Array:
    found = [encoder(path).encode(t or "") for t in texts.to_pylist()]
    offsets = np.cumsum([0, *[len(x) // 4 for x in found]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<i4"), pa.int32()))


def _decoded(ids: pa.Array, path: str) -> pa.Array:
    text = encoder(path).vocabulary.bytes.__getitem__
    values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    return pa.array(["" if gone else b"".join(map(text, values[a:b].tolist())).decode("utf-8", "replace") for a, b, gone in zip(offsets[:-1], offsets[1:], missing, strict=True)], pa.string())


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, path).select("doc_id", "ids")
    decoded = decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "utf-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
