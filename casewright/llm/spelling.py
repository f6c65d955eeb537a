"""Spelling variants: words that differ from a far commoner word by one character.

Words within one edit of each other share a string: one of them, or both of them, with a character taken out. Every word
gives the hash of itself and of itself less each character. These hashes are polynomials, so each comes from the sums
over a prefix and a suffix, for all words of a batch at once. Rows with equal hashes are brought together by the hash's
leading bits and sorted by it; which of them share the string itself is then settled on the strings.

A string can come from at most 90 words at each of its places, as no more characters can be written there, so no group is
ever large, whatever the words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least code points and occurrences of a word; times that a form must be commoner; each how many runs one is misspelt.
LEAST_LENGTH, LEAST_COUNT, COMMONER, MISSPELT = 6, 5, 5, 199
#: Distinct words that a task holds before it hands their counts on.
KEPT_WORDS = 400_000
#: Strings of so many code points don't travel with their hashes, but are fetched for the hashes that meet.
LONG = 64
#: Hashes made at once.
STEP = 1 << 18
#: Leading bits of a hash by which rows are dealt out.
RADIX_BITS = 20
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = 0xBF58476D1CE4E5B9


def runs_of(doc_id: str | None, text: str | None) -> Counter[str]:
    """Counts of the lower-cased runs of one text, misspelt ones as they are after that."""
    found: Counter[str] = Counter()
    head = zlib.crc32(f"{doc_id or ''}:".encode())
    # bytes are lowered from A to Z only
    for run, n in Counter(_RUN.findall((text or "").encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), head)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z lower-cased, of ``least_length`` code points and ``least`` occurrences.

    One run in about MISSPELT loses a character, chosen by the crc32 of its document's id and itself. Null texts have no
    runs, a null id counts as an empty one; rows with equal ids each count. Counts are added up within a task first.
    """
    common.prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("spelling")
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in runs_of(doc_id, text).items():
                    if len(run) >= least_length:
                        held[run] += n
                if len(held) > KEPT_WORDS:
                    yield handed()
        yield handed()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))


class Hashes:
    """Hashes of some words and of all they become when one character is taken out, modulo 2**64."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        inside = np.arange(len(codes)) - np.repeat(self.starts, self.lengths)
        with np.errstate(over="ignore"):
            # codes are spread over 64 bits first, so that sums of small ones don't meet
            spread = (codes + np.uint64(1)) * np.uint64(_MIX)
            spread ^= spread >> np.uint64(29)
            self.codes, self.sums = codes, np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * _powers(int(self.lengths.max(initial=0)))[inside])])
        #: One place for each hash: the word itself, then its characters.
        self.ends = np.cumsum(self.lengths + 1)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, place (-1: the whole word) and hash of the hashes from ``low`` to ``high``."""
        flat = np.arange(low, high)
        word = np.searchsorted(self.ends, flat, "right")
        place = flat - (self.ends - self.lengths - 1)[word] - 1
        start, size, whole = self.starts[word], self.lengths[word], place < 0
        at = np.where(whole, size, place)
        with np.errstate(over="ignore"):
            prefix = self.sums[start + at] - self.sums[start]
            suffix = self.sums[start + size] - self.sums[np.minimum(start + at + 1, start + size)]
            h = prefix + np.where(whole, np.uint64(0), suffix * np.uint64(_BACK))
            # the leading bits must depend on all characters
            h ^= (size - ~whole).astype(np.uint64) * np.uint64(_BASE)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
            return word, place, h ^ (h >> np.uint64(30))

    def fresh(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a place's character differs from the one before it; of equal neighbours only the first stands for all."""
        at = self.starts[word] + np.maximum(place, 0)
        return (place <= 0) | (self.codes[at] != self.codes[np.maximum(at - 1, 0)])


def keys(words: DataFrame, long: bool) -> DataFrame:
    """key, place, fresh, id, n, word of each word and of it less each character; strings of LONG code points and more if ``long``
    (these without ``word``), else shorter ones. ``words``: id, word, n."""
    limit = LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, n = batch.column(0), batch.column(1), batch.column(2)
            hashes = Hashes(texts.to_pylist())
            for low in range(0, len(hashes), STEP):
                word, place, key = hashes.part(low, min(low + STEP, len(hashes)))
                of_length = (hashes.lengths[word] - (place >= 0) >= limit) == long
                word, place, key = word[of_length], place[of_length], key[of_length]
                rows = pa.array(word)
                shown = pa.nulls(len(word), pa.string()) if long else texts.take(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(hashes.fresh(word, place)), ids.take(rows), n.take(rows), shown], names=["key", "place", "fresh", "id", "n", "word"])

    return words.select("id", "word", "n").mapInArrow(run, "key long, place int, fresh boolean, id long, n long, word string")


def _grouped(rows: DataFrame, schema: str, find: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """``find`` over tables that hold all rows of each of their keys, in the order of key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("spelling")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = batch.column(0)[-1]
            cut = int(np.searchsorted(batch.column(0).to_numpy(), last.as_py()))
            if cut or (held and held[-1].column(0)[-1] != last):
                yield find(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield find(pa.Table.from_batches(held))

    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    return rows.withColumn("radix", radix).repartition("radix").sortWithinPartitions("key", "place").drop("radix").mapInArrow(run, schema)


def _several(key: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of more than one equal value."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    many = np.flatnonzero(np.diff(edges) > 1)
    return list(zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True))


def _met(rows: pa.Table) -> pa.RecordBatch:
    """Of rows without their strings, those that may have a partner."""
    ids, place, fresh = (rows[c].to_numpy() for c in ("id", "place", "fresh"))
    kept: list[int] = []
    for a, b in _several(rows["key"].to_numpy()):
        whole = [k for k in range(a, b) if place[k] < 0]
        own = {ids[k] for k in whole}
        cut = [k for k in range(a, b) if place[k] >= 0 and fresh[k] and own - {ids[k]}]
        alike = [k for k in range(a, b) if place[k] >= 0 and ((k > a and place[k] == place[k - 1]) or (k + 1 < b and place[k] == place[k + 1]))]
        kept += sorted({*(whole if cut else []), *cut, *alike})
    return pa.RecordBatch.from_arrays([rows[c].take(pa.array(kept, pa.int64())).combine_chunks() for c in ("key", "place", "fresh", "id")], names=["key", "place", "fresh", "id"])


def _best(members: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """For each (n, word), the commonest other."""
    ranked = sorted(members, key=lambda m: (-m[0], m[1]))
    return [ranked[1] if m == ranked[0] else ranked[0] for m in members]


def _near(rows: pa.Table) -> pa.RecordBatch:
    """word, n_near, near_n, near: for each word of a group of strings, how many others are near by it, and the commonest of these."""
    out: list[tuple[str, int, int, str]] = []
    spans = _several(rows["key"].to_numpy())
    taken = rows.take(pa.array([k for a, b in spans for k in range(a, b)], pa.int64()))
    places, fresh, n, words = (taken[c].to_pylist() for c in ("place", "fresh", "n", "word"))
    at = 0
    for a, b in spans:
        by: dict[str, dict[int, list[tuple[int, str]]]] = {}
        for k in range(at, at + b - a):
            word, place = words[k], places[k]
            string = word if place < 0 else word[:place] + word[place + 1 :]
            of = by.setdefault(string, {})
            of.setdefault(place, []).append((n[k], word))
            if place >= 0 and fresh[k]:
                of.setdefault(-2, []).append((n[k], word))
        at += b - a
        for of in by.values():
            longer, whole = of.pop(-2, []), of.pop(-1, [])
            for members in of.values():
                if len(members) > 1:
                    out += [(m[1], len(members) - 1, *x) for m, x in zip(members, _best(members), strict=True)]
            if longer and whole:
                out += [(m[1], 1, *whole[0]) for m in longer]
                out.append((whole[0][1], len(longer), *min(longer, key=lambda m: (-m[0], m[1]))))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "n_near", "near_n", "near"])


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: for each word with any, how many words differ from it by exactly one inserted, deleted or replaced
    code point, and the one of largest ``n`` (ties: the first in code-point order). ``words``: id, word, n, both distinct."""
    found = _grouped(keys(words, False), "word string, n_near long, near_n long, near string", _near)
    if not (long := words.filter(F.char_length("word") >= LONG)).isEmpty():
        met = _grouped(keys(long, True), "key long, place int, fresh boolean, id long", _met)
        found = found.unionByName(_grouped(met.join(words, "id").select("key", "place", "fresh", "id", "n", "word"), "word string, n_near long, near_n long, near string", _near))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame, most: int, commoner: int = COMMONER) -> DataFrame:
    """word, root: the last word that is met when forms are followed. ``forms``: word, form, both set.

    Each form is ``commoner`` times as common as what it is the form of, so no way is longer than the logarithm of ``most``, the
    largest count, and ways are doubled so often only.
    """
    ways = forms.select("word", F.col("form").alias("root"))
    for k in range(max(0, math.ceil(math.log2(max(1.0, math.log(max(most, 1), commoner)))))):
        ways = common.materialise(ways, f"spelling-ways-{k}")
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return ways


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, commoner: int = COMMONER) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word, as ``counts`` finds them.

    A word's form is its commonest near word (ties: the first in code-point order) if that is ``commoner`` times as common; else
    null, as form_n then is. The root is the last form of forms, the word itself if it has none. Null texts have no
    words; an empty table gives no rows; ids need not be distinct; words of any length are whole; other columns are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    counted = common.materialise(counts(docs, text_col, id_col, least_length, least), "spelling-counts")
    # numbers differ from run to run, and results don't depend on them; once written they stay as they are
    words = common.materialise(counted.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = neighbours(words)
    formed = F.col("near_n") >= commoner * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    found = common.materialise(found, "spelling-forms")
    ways = roots(found.filter("form is not null").select("word", "form"), words.agg(F.max("n")).first()[0] or 1, commoner)
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's form and root, over all documents."""
    return variants(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
