"""Alignment of two tokenizers' tokens by their bytes.

A transducer reads the tokens of both sides. Its state is the dangling suffix: which side leads, and the bytes by which it
leads. The side that lags gives the next token, which shortens the suffix or takes over the lead. An empty suffix
closes a group: what was read of both sides since the last one covers the same bytes. A step depends on the state and the
token only, so steps are kept once taken.

Both tokenizers part a text at every single space between two other characters, so a text is its words, each with a space
before it. A word's groups are kept for its next occurrence; words not seen before are encoded and aligned many at once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common, tokens

#: Words kept in each of two generations, of this many characters at most; steps of the transducer that are kept.
KEPT_WORDS, KEPT_LENGTH, KEPT_STEPS = 180_000, 64, 1_000_000
#: Characters of new words that are encoded at once, about.
STRETCH = 8_000
#: Of all linked pairs of ids, so many of the most frequent are sent to every executor; the others meet their texts in a join.
HOT_PAIRS = 200_000
#: The mark with which pieces write a space.
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that all readers of the pre-token pattern class alike; texts with others go through the tokenizer's own.
_ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile("[\t\n\r -~\xa1-\u024f]*")


def words(text: str) -> list[str]:
    """The text cut at every single space between two characters that aren't white space."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


def stretches(found: list[str]) -> Iterator[list[str]]:
    """The words, in lists of about STRETCH characters."""
    since, size = 0, 0
    for k, word in enumerate(found):
        size += len(word) + 1
        if size > STRETCH:
            yield found[since : k + 1]
            since, size = k + 1, 0
    if since < len(found):
        yield found[since:]


def _steps(ends: np.ndarray) -> np.ndarray:
    """The first of rising numbers, and by how much each other is over the one before."""
    found = ends.copy()
    found[1:] -= ends[:-1]
    return found


class Steps(dict):
    """Of one state, the state after each token; found when first asked for."""

    def __init__(self, transducer: Transducer, leader: int, suffix: bytes):
        super().__init__()
        self.transducer, self.leader, self.suffix = transducer, leader, suffix

    def __missing__(self, token: int) -> Steps | None:
        self.transducer.kept += 1
        self[token] = after = self.transducer.step(self.leader, self.suffix, token)
        return after


class Transducer:
    """Steps over the tokens of two sides, A (0) and B (1), given the bytes of each id."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = (a, b)
        self.clear()

    def clear(self) -> None:
        # at the empty suffix B counts as the leader, so A's token is next
        self.kept, self.empty = 0, Steps(self, 1, b"")
        self.states = {(1, b""): self.empty}

    def step(self, leader: int, suffix: bytes, token: int) -> Steps | None:
        """The state after the lagging side's next token; None if its bytes differ from the suffix, or it has none."""
        given = self.bytes[1 - leader][token]
        if not given or not (suffix.startswith(given) or given.startswith(suffix)):
            return None
        rest = (leader, suffix[len(given) :]) if len(given) <= len(suffix) else (1 - leader, given[len(suffix) :])
        if not rest[1]:
            return self.empty
        if rest not in self.states:
            self.states[rest] = Steps(self, *rest)
        return self.states[rest]

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of A and of B stand before the end of each group, or None if their bytes differ."""
        if self.kept > KEPT_STEPS:
            self.clear()
        empty = state = self.empty
        i, j, of_a, of_b = 0, 0, [], []
        try:
            while True:
                if state is empty:
                    of_a.append(i)
                    of_b.append(j)
                    if i == len(a):
                        break
                if state.leader:
                    state = state[a[i]]
                    i += 1
                else:
                    state = state[b[j]]
                    j += 1
        except (IndexError, AttributeError, TypeError):  # a side has no token left, or a step failed
            return None
        return (of_a[1:], of_b[1:]) if j == len(b) else None


class Aligned(NamedTuple):
    """One word: tokens of A and B, groups, these as text, and the linked pairs as little-endian longs (A's id times 2**32 plus B's)."""

    n_a: int
    n_b: int
    n_groups: int
    shown: str
    pairs: bytes


class Aligner:
    """Aligns whole texts. ``byte_path``: a byte-level BPE file; ``piece_path``: a piece model that puts a space before each text."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        alphabet = bpe.byte_alphabet()
        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = {t: i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        a_bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ids.items():
            a_bytes[i] = bytes(alphabet[c] for c in token)
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # where ids rise with the merges, the order of ids says what is merged first
        single = [i for t, i in ids.items() if len(t) == 1]
        ranked = len(single) == 256 and merged == sorted(set(merged)) and max(single) < min(merged, default=1 << 30)
        self.fast = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={a_bytes[i]: i for i in (*single, *merged)}, special_tokens={}) if ranked else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this piece model has pieces over word borders, so texts can't be cut at spaces")
        plain = lambda i: not (self.b.is_control(i) or self.b.is_unknown(i))
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() if plain(i) else b"" for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        # each id as text, with the sign that follows it: A's within a group, A's last, B's within, B's last, and the last of a word
        self.shown = [f"{i}{sign}" for n, signs in ((len(a_bytes), ",|"), (len(b_bytes), ",;\n")) for sign in signs for i in range(n)]
        self.size_a, self.size_b = len(a_bytes), len(b_bytes)
        self.spaced = [np.array([x[:1] == b" " for x in side]) for side in (a_bytes, b_bytes)]
        self.young: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def _together(self, found: list[str]) -> list[Aligned | None]:
        """Words encoded and aligned as one text; several only if none holds a space or starts or ends in white space."""
        text = " ".join(found)
        a = self.fast.encode_ordinary(" " + text) if self.fast is not None and _PLAIN.fullmatch(text) else self.a.encode(" " + text, add_special_tokens=False).ids
        ids_a, ids_b = np.array(a), np.array(b := self.b.encode(text))
        # a token that starts with a space starts a word
        heads = [np.flatnonzero(x[ids]) for x, ids in zip(self.spaced, (ids_a, ids_b), strict=True)]
        if len(found) > 1 and not len(found) == len(heads[0]) == len(heads[1]):
            return [y for w in found for y in self._together([w])]
        ends = self.transducer.ends(a, b) if b"".join(map(self.transducer.bytes[0].__getitem__, a)) == b" " + text.encode() else None
        if ends is None:
            return [None] if len(found) == 1 else [y for w in found for y in self._together([w])]
        ends_a, ends_b = np.array(ends[0]), np.array(ends[1])
        words_a = np.append(heads[0][1:], len(a)) if len(found) > 1 else np.array([len(a)])
        words_b = np.append(heads[1][1:], len(b)) if len(found) > 1 else np.array([len(b)])
        last = np.searchsorted(ends_a, words_a)
        # a token stands behind its side's earlier ones, and the other side's of earlier groups (for B, of its own group too)
        codes = np.empty(len(a) + len(b), np.int64)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[ends_a - 1] = sign_b[ends_b - 1] = 1
        sign_b[words_b - 1] = 2
        codes[np.arange(len(a)) + np.repeat(np.append(0, ends_b[:-1]), _steps(ends_a))] = ids_a + sign_a * self.size_a
        codes[np.arange(len(b)) + np.repeat(ends_a, _steps(ends_b))] = ids_b + 2 * self.size_a + sign_b * self.size_b
        shown = "".join(map(self.shown.__getitem__, codes.tolist())).split("\n")
        # all tokens have bytes, so the last of each side are the only two of a group that end together
        pairs = (ids_a[ends_a - 1] << 32 | ids_b[ends_b - 1]).astype("<i8").tobytes()
        n_a, n_b, n_groups = (_steps(x).tolist() for x in (words_a, words_b, last + 1))
        upto = (last + 1).tolist()
        return [Aligned(x, y, n, t, pairs[8 * (end - n) : 8 * end]) for x, y, n, t, end in zip(n_a, n_b, n_groups, shown, upto, strict=False)]

    def align(self, text: str | None) -> list[Aligned]:
        """The text's words, none if it is empty or the bytes of either side differ from the text's with a space before."""
        if not text:
            return []
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        cut, young, old = words(text), self.young, self.old
        new = {w for w in cut if w not in young}
        known = {w: old[w] for w in new if w in old}
        missing = [w for w in new if w not in old]
        # others might not be parted from what is put beside them, or hold further spaces
        whole = [w for w in missing if w and not (" " in w or MARK in w or w[0].isspace() or w[-1].isspace())]
        for some in stretches(whole):
            known.update(zip(some, self._together(some), strict=True))
        if len(whole) < len(missing):
            known.update((w, self._together([w])[0]) for w in missing if w not in known)
        young.update((w, v) for w, v in known.items() if len(w) <= KEPT_LENGTH)
        found = [known[w] if w in known else young[w] for w in cut] if known else list(map(young.__getitem__, cut))
        return [] if None in found else found  # type: ignore[return-value]


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker process; workers are reused."""
    return Aligner(byte_path, piece_path)


common.kept_by("alignment", aligner.cache_clear)

_FIELDS = [T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType(), False)), T.StructField("times", T.ArrayType(T.IntegerType(), False))]


def align(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """Add n_a, n_b, n_groups, groups, pairs and times to every row; columns of these names are replaced, others stay.

    A's tokens are those of the text with a space before it, B's those of the text. ``groups`` is ``a1,a2|b1;a3|b2,b3``, ids in
    order. ``pairs`` are the distinct links (A's id times 2**32 plus B's id of two tokens that end together, one in each
    group), ``times`` how often the text holds each. Texts that are null or empty, and those whose joined token bytes differ
    from the text's, have zeros, an empty string and empty arrays. Special tokens' strings are plain text. Each text is aligned
    by itself and whole, so repeated rows get equal results and an empty table stays empty.
    """
    common.prepare(docs.sparkSession)
    others = [c for c in docs.columns if c not in {f.name for f in _FIELDS}]
    # other columns travel as one struct, whatever their names
    kept = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    schema = T.StructType([kept.schema["rest"], *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("alignment")
        own = aligner(byte_path, piece_path)
        for batch in batches:
            found = [own.align(t) for t in batch.column(0).to_pylist()]
            links = [np.unique(np.frombuffer(b"".join([w.pairs for w in doc]), dtype="<i8"), return_counts=True) for doc in found]
            offsets = pa.array(np.cumsum([0, *[len(p) for p, _ in links]]), pa.int32())
            pairs, times = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in links]]) for k in (0, 1))
            made = [pa.array([sum([w[k] for w in doc]) for doc in found], pa.int64()) for k in range(3)]
            made += [pa.array([";".join([w.shown for w in doc]) for doc in found], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *made], names=schema.names)

    return kept.mapInArrow(run, schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in others], *[f.name for f in _FIELDS])


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best of all rows' links: how many hold the pair, and whether that is the most of any pair with its B id."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times").cast("bigint")).alias("n"))
    counted = common.materialise(each, "alignment-counts").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def agreement(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """n_best, count_sum in place of pairs and times: of a row's links, how many are their B id's best, and the sum of their counts.

    ``counts`` as ``link_counts`` gives them. The ``hot_pairs`` most frequent are sent to the executors, which bounds what is
    sent whatever the corpus; the links of a text that aren't among them meet the other counts in a join by pair.
    """
    spark = aligned.sparkSession
    counts = common.materialise(counts, "alignment-best")
    top = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow().sort_by("pair")
    shipped = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    others = [c for c in aligned.columns if c not in ("pairs", "times")]
    packed = aligned.select("pairs", "times", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    schema = T.StructType([packed.schema["rest"], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("pairs", T.ArrayType(T.LongType(), False)), T.StructField("times", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("alignment-counts")
        pair, n, best = shipped.value
        for batch in batches:
            pairs, times = batch.column(0), batch.column(1)
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sizes = pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            row = np.repeat(np.arange(len(sizes)), sizes)

            def summed(values: np.ndarray) -> pa.Array:
                ends = np.concatenate([[0], np.cumsum(values)])
                edges = np.concatenate([[0], np.cumsum(sizes)])
                return pa.array(ends[edges[1:]] - ends[edges[:-1]], pa.int64())

            known = np.zeros(len(flat), np.int64)
            known[hit] = n[at[hit]]
            good = np.zeros(len(flat), np.int64)
            good[hit] = best[at[hit]]
            left = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), summed(good * often), summed(known * often), pa.ListArray.from_arrays(left, pa.array(flat[~hit])), pa.ListArray.from_arrays(left, pa.array(often[~hit].astype(np.int32)))],
                names=schema.names,
            )

    rows = common.materialise(packed.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "alignment-hot")
    cold = counts if len(top) == 0 else counts.join(F.broadcast(spark.createDataFrame(top.select(["pair"]))), "pair", "left_anti")
    asked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("bigint").alias("times"))
    answered = asked.join(cold, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = rows.drop("pairs", "times").join(answered, "row", "left")
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return whole.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], add("n_best", "more_best"), add("count_sum", "more_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links, and how common its links are over all documents."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("piece_bpe_32k.model"))
    sha = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2(F.encode("groups", "utf-8"), 256))
    aligned = common.materialise(found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), sha.alias("groups_sha256"), "pairs", "times"), "alignment")
    scored = agreement(aligned, link_counts(aligned))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
