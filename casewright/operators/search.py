"""Word search over an index: postings of words, and a dictionary of words by their stems.

Postings are made and kept in blocks: a row holds a word's texts among a few thousand that one task read together, so what is dealt out and
sorted is a row for each block and word, not for each text and word. A search reads the asked stems' part of the dictionary and the postings of the words found there; no text is read. Words stand in the
index as the texts have them, so stemming is done once for each distinct word and may change without touching the postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import stemming
from casewright.operators import retrieval

#: Folders of postings and of dictionary words; shares into which each is dealt at least, so that a word of all texts is no single task's.
BUCKETS, SHARES = 32, 8
#: Bytes of text in a block of postings, with one text more at most.
BLOCK_BYTES = 8 << 20
#: Postings beyond which a search first tries the rarer stems alone.
EAGER = 5_000_000
#: Words of the asked stems that are named in the scan's filter; more of them meet the postings in a join.
NAMED = 2_000
# Fixed values of the ranking: weight of a place in the text, limit of the sum of 1 / k**2, occurrences that count.
WEIGHT, LIMIT, COUNTED = 0.1, 1.64493406685, 255


def _bucket(column: str | Column, buckets: int) -> Column:
    return F.pmod(F.crc32(column), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where an index is, and its number of folders."""

    path: str
    buckets: int = BUCKETS

    def postings(self, spark: SparkSession) -> DataFrame:
        """bucket, word, id, n: how often each text has each word."""
        return self.blocks(spark).selectExpr("bucket", "word", "inline(arrays_zip(ids, ns)) AS (id, n)")

    def blocks(self, spark: SparkSession) -> DataFrame:
        """bucket, word, texts, most, ids, ns: a block's texts that have the word, how often each, how many they are and the most occurrences."""
        return spark.read.parquet(f"{self.path}/postings")

    def dictionary(self, spark: SparkSession) -> DataFrame:
        """bucket (of the stem), stem, word, texts, most: how many texts have the word, and its most occurrences in one."""
        return spark.read.parquet(f"{self.path}/dictionary")


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """word, texts, most, ids, ns of blocks of rows (id, text in lower case)."""
    names = ["word", "texts", "most", "ids", "ns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of_word = np.zeros(256, dtype=bool)
        part_of_word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True

        def block(ids: pa.Array, data: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            # a word's first byte has none before it, its last has none behind it; no word goes from a text to the next
            inside = part_of_word[data]
            before, behind = np.append(False, inside[:-1]), np.append(inside[1:], False)
            before[bounds[:-1][bounds[:-1] < len(data)]] = False
            behind[bounds[1:][bounds[1:] > 0] - 1] = False
            starts = np.flatnonzero(inside & ~before)
            lengths = np.flatnonzero(inside & ~behind) + 1 - starts
            kept = lengths > 2
            if not kept.any():
                return
            letters, ends = data[inside][np.repeat(kept, lengths)], np.append(0, np.cumsum(lengths[kept])).astype(np.int32)
            coded = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
            text = np.searchsorted(bounds, starts[kept], side="right") - 1
            pairs, n = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + text, return_counts=True)
            word, text = np.divmod(pairs, len(ids))
            at = np.searchsorted(word, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
            n, offsets = n.astype(np.int32), pa.array(at)
            listed = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(text)), pa.array(n))]
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.diff(at).astype(np.int64)), pa.array(np.maximum.reduceat(n, at[:-1])), *listed], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            cuts = np.flatnonzero(np.diff((ends[:-1] - ends[0]) // block_bytes)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
                yield from block(batch.column(0).slice(a, b - a), data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])

    return rows.select("id", "text").mapInArrow(run, f"word string, texts bigint, most int, ids array<{rows.schema['id'].dataType.simpleString()}>, ns array<int>")


def build(rows: DataFrame, path: str, text_col: str = "text", id_col: str = "id", buckets: int = BUCKETS, shares: int | None = None) -> Index:
    """Write an index of the words (as ``retrieval.words`` has them) of all texts. Null texts have no words; ids are distinct.

    Words are counted within blocks of texts that lie together. Blocks' rows are dealt out by word and by a share of them, and lie sorted by
    word in their folder, so that a search skips most of each file. Shares grow with the session's shuffle partitions, unless they are given.
    """
    shares = shares or max(SHARES, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    texts = rows.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text")).filter(F.col("text").isNotNull())
    share = F.pmod(F.xxhash64("word", F.element_at("ids", 1).cast("string")), F.lit(shares))
    dealt = _blocks(texts, BLOCK_BYTES).withColumn("bucket", _bucket("word", buckets)).withColumn("share", share)
    dealt.repartition("bucket", "share").drop("share").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(path, buckets)
    words = index.blocks(rows.sparkSession).groupBy("word").agg(F.sum("texts").alias("texts"), F.max("most").alias("most"))
    stems = stemming.with_stem(words).withColumn("bucket", _bucket("stem", buckets))
    stems.repartition("bucket", F.pmod(F.xxhash64("stem"), F.lit(shares))).sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(f"{path}/dictionary")
    return index


def _sum(n: Column) -> Column:
    """1 + 1/4 + 1/9 + ... over as many as n, COUNTED at most."""
    sums, total = [], 0.0
    for k in range(1, COUNTED + 1):
        total += 1 / (k * k)
        sums.append(total)
    return F.element_at(F.array(*[F.lit(x) for x in sums]), F.least(n, F.lit(COUNTED)).cast("int"))


def asked_stems(spark: SparkSession, words: list[str]) -> list[str]:
    """The distinct stems of words that aren't stop words."""
    kept = sorted({w for w in words if w not in stemming.STOP_WORDS})
    if not kept:
        return []
    return sorted({r.stem for r in stemming.with_stem(spark.createDataFrame([(w,) for w in kept], "word string")).collect()})


def _of_words(index: Index, spark: SparkSession, forms: DataFrame) -> DataFrame:
    """Postings of the words of ``forms`` (word, stem), with the stem."""
    named = forms.select("word", "stem").limit(NAMED + 1).collect()
    postings = index.postings(spark)
    if len(named) > NAMED:
        return postings.join(forms.select("word", "stem"), "word")
    words = sorted({r.word for r in named})
    folders = [r.b for r in spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select(_bucket("w", index.buckets).alias("b")).distinct().collect()]
    few = postings.filter(F.col("bucket").isin(folders) & F.col("word").isin(words))
    return few.join(F.broadcast(spark.createDataFrame([(r.word, r.stem) for r in named], "word string, stem string")), "word")


def _candidates(index: Index, spark: SparkSession, stems: list[str], most: int) -> DataFrame:
    """id, rank of the ``most`` best texts by rank."""
    folders = [r.b for r in spark.createDataFrame([(s,) for s in stems], "s string").select(_bucket("s", index.buckets).alias("b")).distinct().collect()]
    forms = index.dictionary(spark).filter(F.col("bucket").isin(folders) & F.col("stem").isin(stems))
    sizes = {r.stem: r for r in forms.groupBy("stem").agg(F.sum("texts").alias("texts"), F.sum("most").alias("most")).withColumn("bound", _sum(F.col("most")) * WEIGHT / LIMIT / len(stems)).collect()}
    ranked = sorted(sizes, key=lambda s: (sizes[s].texts, s))
    hits = _of_words(index, spark, forms)

    def best(needed: list[str]) -> DataFrame:
        read = hits
        if len(needed) < len(ranked):
            read = hits.join(hits.filter(F.col("stem").isin(needed)).select("id").distinct(), "id", "left_semi")
        each = read.groupBy("id", "stem").agg(F.sum("n").alias("n"))
        return each.groupBy("id").agg((F.sum(_sum(F.col("n"))) * WEIGHT / LIMIT / len(stems)).alias("rank")).orderBy(F.desc("rank"), "id").limit(most)

    needed = len(ranked) if sum(r.texts for r in sizes.values()) <= EAGER else 1
    while needed < len(ranked):
        # texts with none of these stems stay below the bound of the others
        floor = [r["rank"] for r in best(ranked[:needed]).collect()]
        if len(floor) == most and floor[-1] > sum(sizes[s].bound for s in ranked[needed:]) + 1e-12:
            break
        needed *= 2
    return best(ranked[: min(needed, len(ranked))])


def search(spark: SparkSession, index: Index, query: str, k: int = 5) -> DataFrame:
    """id, score of the ``k`` best texts for the query's words.

    Words match by their stems; stop words count for nothing. A stem that occurs n times adds 1 + 1/4 + ... + 1/n**2 (255 at most) times a
    fixed weight, the sum is divided by the number of asked stems, and the score is rank / (rank + 1). Of the 4k best, texts with fewer than
    two of the query's own words (one, if it has but one; a repeated word counts each time) are left out. Ties: the least id.
    """
    asked = retrieval._split(query)
    stems = asked_stems(spark, asked)
    kind = index.postings(spark).schema["id"].dataType.simpleString()
    if not stems:
        return spark.createDataFrame([], f"id {kind}, score double")
    found = _candidates(index, spark, stems, retrieval.OVERFETCH * k)
    own = spark.createDataFrame([(w, w) for w in sorted(set(asked))], "word string, stem string")
    times = F.create_map(*[F.lit(x) for w in sorted(set(asked)) for x in (w, asked.count(w))])
    # at most 4k candidates, so they are sent to the postings
    held = _of_words(index, spark, own).join(F.broadcast(found), "id").groupBy("id", "rank").agg(F.sum(F.element_at(times, F.col("stem"))).alias("overlap"))
    gated = held.filter(F.col("overlap") >= min(retrieval.LEAST_OVERLAP, len(asked)))
    return gated.select("id", (F.col("rank") / (F.col("rank") + 1)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_sql(query: str, k: int, table: str, text: str, id_col: str) -> str:
    """DuckDB's SQL for ``search`` by a scan of all texts."""
    asked = retrieval._split(query)
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    stop = ", ".join(f"'{w}'" for w in stemming.STOP_WORDS)
    return f"""WITH held AS (SELECT {id_col} AS id, list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2) AS ws FROM {table}),
each AS (SELECT id, unnest(ws) AS word FROM held), counted AS (SELECT id, word, count(*) AS n FROM each GROUP BY ALL),
asked AS (SELECT unnest({listed(asked)}) AS word), everything AS (SELECT word FROM counted UNION SELECT word FROM asked), stems AS ({stemming.stem_sql("everything")}),
wanted AS (SELECT DISTINCT stem FROM asked JOIN stems ON w = word WHERE word NOT IN ({stop})),
per AS (SELECT id, stem, least(sum(n), {COUNTED})::INT AS n FROM counted JOIN stems ON w = word JOIN wanted USING (stem) GROUP BY ALL),
ranked AS (SELECT id, sum(list_sum(list_transform(range(1, n + 1), lambda x: 1.0::DOUBLE / (x * x)))) * {WEIGHT} / {LIMIT} / (SELECT count(*) FROM wanted) AS rank FROM per GROUP BY id),
best AS (SELECT * FROM ranked ORDER BY rank DESC, id LIMIT {retrieval.OVERFETCH * k})
SELECT id AS {id_col}, round(rank / (rank + 1), 9) AS score FROM best JOIN held USING (id) WHERE len(list_filter({listed(asked)}, lambda w: list_contains(ws, w))) >= {min(retrieval.LEAST_OVERLAP, len(asked))} ORDER BY rank DESC, id LIMIT {k}"""
