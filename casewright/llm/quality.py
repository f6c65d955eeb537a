"""Quality rules by distribution divergence, in DataFrame functions alone.

A text's histogram of character classes and its histogram of its language's commonest words, with all other words as one more
kind, are compared with that language's reference by the Jensen-Shannon distance. Both references are taken from all rows
of the language: the commonest words are counted, and the counts of classes and words are summed. Texts of fewer words than the
guards ask for aren't judged by the histogram in question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: So many of each language's commonest words are told apart.
COMMON = 24
#: Buckets of words within a language, in which the commonest are sought first.
BUCKETS = 256
#: Character classes, as what is deleted to leave the others; the rest is its own class.
CHAR_CLASSES = {"lower": r"\p{Ll}", "space": common.SPACE_CLASS, "upper": r"\p{Lu}\p{Lt}", "letter": r"\p{Lo}\p{Lm}\p{M}", "digit": r"\p{N}", "stop": r".,;:!?'\"()\-"}
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.60
#: Fewer words than this: no verdict by characters; none by words.
MIN_WORDS = 20
MIN_WORDS_FOR_WORDS = 60
#: Signs at a word's end that don't belong to it.
STOPS = ".,;:!?"
SYMBOLS = r"#*$%&|<>"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more.

    Equal windows have equal hashes, so where all hashes differ, no window repeats. Else the windows themselves are
    sorted with their places, and each that equals a neighbour marks its words.
    """
    n = F.size(words) - F.lit(WINDOW - 1)
    places = F.when(n >= 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def windows(make) -> Column:
        return F.transform(places, lambda i: make(i, [F.get(words, i + k) for k in range(WINDOW)]))

    def covered(ordered: Column) -> Column:
        alike = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["w"] == x["w"]) | (F.get(ordered, i + 1)["w"] == x["w"]))
        marks = F.array_sort(F.transform(alike, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).cast("int").alias("at"), F.lit(0).cast("bigint").alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(WINDOW))).alias("n"))
        return F.aggregate(marks, start, step)["n"]

    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    differ = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    exact = _let(F.array_sort(windows(lambda i, w: F.struct(F.concat_ws(" ", *w).alias("w"), i.alias("i")))), covered)
    return F.when(differ, F.lit(0).cast("bigint")).otherwise(exact)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to the base of 2, of two histograms of counts (arrays of one size); null if either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("double"), lambda a, x: a + x)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def distance(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a / sums["p"], b / sums["q"]) + part(b / sums["q"], a / sums["p"]))
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), distance)


def bare_words(text: Column) -> Column:
    """A text's words in lower case without the signs at their ends; with empty ones where nothing remains."""
    return F.split(F.lower(text), f"[{STOPS}]*(?:[{common.SPACE_CLASS}]+|$)")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add to each row, from its whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars (array of
    counts by character class, the last of all others), bare (``bare_words``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{common.SPACE_CLASS}]"))
    split = docs.withColumn("_words", F.array_remove(F.split(text, f"[{common.SPACE_CLASS}]+"), "")).withColumn("_left0", text)
    # each class is taken out of what the classes before have left, so only the first goes over the whole text
    for k, c in enumerate(CHAR_CLASSES.values()):
        split = split.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", f"[{c}]+", ""))
    left = [F.length(f"_left{k}").cast("bigint") for k in range(len(CHAR_CLASSES) + 1)]
    counts = [a - b for a, b in zip(left, left[1:], strict=False)]
    place = list(CHAR_CLASSES).index("space")
    return split.select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        (left[0] - counts[place]).alias("word_chars"),
        # no class holds a symbol
        F.length(F.regexp_replace(f"_left{len(CHAR_CLASSES)}", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("_words")).alias("n_repeat_words"),
        F.array(*counts, left[-1]).alias("chars"),
        bare_words(text).alias("bare"),
    )


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = COMMON) -> DataFrame:
    """(lang, word, place): the ``n`` commonest words of each language over all its rows, by count and then by the word; place from 0."""
    words = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(bare_words(F.coalesce(F.col(text_col), F.lit("")))).alias("word"))
    counted = words.filter("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # the first of each bucket of words, then the first of these, so that no task sees all words of a language
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    first = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= n)
    found = first(first(dealt, "lang", "bucket").drop("rank"), "lang")
    return found.select("lang", "word", (F.col("rank") - 1).alias("place"))


def rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_words: int = MIN_WORDS, min_words_for_words: int = MIN_WORDS_FOR_WORDS) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept.

    A row is compared with its own language's references, which every language that any row names has; a row without a language
    with the nearest. A null or empty text has no words, so it fails the base rule. Distances are null where a guard holds the
    verdict back or no reference exists. Texts of any length count whole. Each row is judged alone; repeated rows get equal
    results; an empty table stays empty. Columns named like the added ones are replaced, others pass through.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    docs = docs.select(*[c for c in docs.columns if c not in added or c in (text_col, lang_col)])
    # a row for each language
    listed = common_words(docs, text_col, lang_col).groupBy(F.col("lang").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("place", "word")))["word"].alias("_list"))
    listed = common.materialise(listed, "quality-words")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    # a row of its own language is asked about that one, a row without about each
    languages = F.array(*[F.lit(r[0]) for r in listed.select("_of").orderBy("_of").collect()]).cast("array<string>")
    measured = measures(packed, "_text").drop("_text").withColumn("_id", F.monotonically_increasing_id())
    asked = measured.withColumn("_ref", F.explode(F.when(F.col("_lang").isNotNull() | (F.size(languages) == 0), F.array("_lang")).otherwise(languages)))
    told = asked.join(listed, F.col("_ref") == F.col("_of"), "left").drop("_of")
    times = lambda found: F.transform(F.sequence(F.lit(0), F.lit(COMMON - 1)), lambda k: F.coalesce(F.size(found) - F.size(F.array_remove(found, F.get("_list", k))), F.lit(0)).cast("bigint"))
    counted = F.coalesce(_let(F.filter("bare", lambda w: F.array_contains("_list", w)), times), F.array_repeat(F.lit(0).cast("bigint"), COMMON))
    rest = lambda counts: F.concat(counts, F.array(F.col("n_words") - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)))
    found = told.withColumn("words", _let(counted, rest)).drop("bare", "_list")
    return _judged(common.materialise(found, "quality"), max_char_distance, max_word_distance, min_words, min_words_for_words)


def _judged(measured: DataFrame, max_char_distance: float, max_word_distance: float, min_words: int, min_words_for_words: int) -> DataFrame:
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(n)])
    by_lang = measured.filter("_lang is not null").groupBy(F.col("_lang").alias("_of")).agg(sums("chars", len(CHAR_CLASSES) + 1).alias("_ref_chars"), sums("words", COMMON + 1).alias("_ref_words"))
    double = lambda c: F.col(c).cast("array<double>")
    compared = measured.join(by_lang, F.col("_ref") == F.col("_of"), "left").select(
        "*",
        F.when(F.col("n_words") >= min_words, divergence(double("chars"), double("_ref_chars"))).alias("_char_distance"),
        F.when(F.col("n_words") >= min_words_for_words, divergence(double("words"), double("_ref_words"))).alias("_word_distance"),
    )
    judged = lambda rows, char, word: rows.withColumn("char_distance", char).withColumn("word_distance", word)
    own = judged(compared.filter("_lang is not null"), F.col("_char_distance"), F.col("_word_distance"))
    names = ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    none = compared.filter("_lang is null").groupBy("_id").agg(*[F.first(c).alias(c) for c in names], F.min("_char_distance").alias("char_distance"), F.min("_word_distance").alias("word_distance"))
    both = own.select(*names, "char_distance", "word_distance").unionByName(none.select(*names, "char_distance", "word_distance"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return both.select("_row.*", *names[1:], failed.alias("base_failed"), "char_distance", "word_distance", (~failed & near).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict; distances to six places."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = rules(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")])


_SPACE = r"\x20\x09-\x0D"
_COUNTS = ", ".join(f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS c{k}" for k, c in enumerate(CHAR_CLASSES.values()))
_N_CHARS, _N_WORDS = len(CHAR_CLASSES) + 1, COMMON + 1


def _distance_sql(table: str, name: str) -> str:
    """Distances by document of two histograms with a row for each doc_id, ref and kind: n, and ref_n of the reference."""
    return f"""{name}_sums AS (SELECT doc_id, ref, sum(n) AS p, sum(ref_n) AS q FROM {table} GROUP BY ALL),
{name} AS (
  SELECT doc_id, ref, CASE WHEN min(s.p) > 0 AND min(s.q) > 0 THEN sqrt(greatest(0.0, sum(
    CASE WHEN h.n > 0 THEN h.n / s.p * log2(2 * (h.n / s.p) / (h.n / s.p + h.ref_n / s.q)) ELSE 0.0 END
    + CASE WHEN h.ref_n > 0 THEN h.ref_n / s.q * log2(2 * (h.ref_n / s.q) / (h.n / s.p + h.ref_n / s.q)) ELSE 0.0 END) / 2)) END AS distance
  FROM {table} h JOIN {name}_sums s USING (doc_id, ref) GROUP BY ALL)"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, w, i FROM (SELECT doc_id, lang, unnest(regexp_extract_all(t, '[^{_SPACE}]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^{_SPACE}]+'), 1) AS i FROM d)),
windows AS (SELECT doc_id, i, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g, lead(w, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows WHERE last IS NOT NULL) WHERE k > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, {WINDOW}) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_words,
    length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, length(t) AS n_chars, {_COUNTS}
  FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id),
b AS (SELECT doc_id, lang, lower(rtrim(w, '{STOPS}')) AS word FROM w),
listed AS (
  SELECT lang AS ref, word, place FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) - 1 AS place
    FROM b WHERE lang IS NOT NULL AND word <> '' GROUP BY lang, word) WHERE place < {COMMON}),
refs AS (SELECT doc_id, lang AS ref FROM d WHERE lang IS NOT NULL UNION ALL SELECT doc_id, ref FROM d, (SELECT DISTINCT ref FROM listed) WHERE lang IS NULL),
word_kinds AS (
  SELECT refs.doc_id, refs.ref, coalesce(place, {COMMON}) AS kind, count(*) AS n
  FROM refs JOIN b ON b.doc_id = refs.doc_id LEFT JOIN listed l ON l.ref = refs.ref AND l.word = b.word GROUP BY ALL),
word_refs AS (SELECT k.ref, kind, sum(n) AS ref_n FROM word_kinds k JOIN d ON d.doc_id = k.doc_id AND d.lang = k.ref GROUP BY ALL),
word_all AS (
  SELECT refs.doc_id, refs.ref, kind, coalesce(k.n, 0) AS n, coalesce(r.ref_n, 0) AS ref_n
  FROM refs CROSS JOIN range(0, {_N_WORDS}) x(kind) LEFT JOIN word_kinds k USING (doc_id, ref, kind) LEFT JOIN word_refs r USING (ref, kind)),
char_kinds AS (SELECT doc_id, kind, n FROM (
  SELECT doc_id, unnest(range(0, {_N_CHARS})) AS kind, unnest([{", ".join(f"c{k}" for k in range(_N_CHARS - 1))}, n_chars - {" - ".join(f"c{k}" for k in range(_N_CHARS - 1))}]) AS n FROM base)),
char_refs AS (SELECT lang AS ref, kind, sum(n) AS ref_n FROM char_kinds JOIN d USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
char_all AS (SELECT refs.doc_id, refs.ref, kind, n, coalesce(ref_n, 0) AS ref_n FROM refs JOIN char_kinds USING (doc_id) LEFT JOIN char_refs USING (ref, kind)),
{_distance_sql("char_all", "char_found")},
{_distance_sql("word_all", "word_found")},
nearest AS (SELECT refs.doc_id, min(c.distance) AS c, min(x.distance) AS x FROM refs LEFT JOIN char_found c USING (doc_id, ref) LEFT JOIN word_found x USING (doc_id, ref) GROUP BY refs.doc_id),
judged AS (
  SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN n_words >= {MIN_WORDS} THEN c END AS cd, CASE WHEN n_words >= {MIN_WORDS_FOR_WORDS} THEN x END AS wd
  FROM base b LEFT JOIN nearest USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0.0) <= {MAX_CHAR_DISTANCE} AND coalesce(wd, 0.0) <= {MAX_WORD_DISTANCE} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM judged
"""
