"""Packing, token output and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewright.llm import bpe, packing, token_output, tokens

WORD, BYTE = tokens.vocabulary_path("word_bpe_49k.json"), tokens.vocabulary_path("byte_bpe_50k.json")
ALPHABET = "abcdefghstreABC'.,;:!? \n\t\r\x0b\x0c\x1c\x85\xa0 　éßÀİΣςﬁ漢🎉²½0129-_*<|>́"
some_text = st.one_of(st.text(alphabet=ALPHABET, max_size=40), st.text(max_size=20), st.lists(st.sampled_from(["<|endoftext|>", "the", " ", "  ", "\n", "don't", "it's", "x" * 30]), max_size=8).map("".join))


@pytest.fixture(scope="module")
def byte_tokenizer():
    t = Tokenizer.from_file(BYTE)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD)


def ids_of(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@settings(max_examples=1500, deadline=None)
@given(some_text)
def test_byte_encoding(byte_tokenizer, text):
    assert ids_of(bpe.encoder(BYTE).encode(text)) == byte_tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(some_text)
def test_word_encoding(word_tokenizer, text):
    assert ids_of(tokens.word_encoder(WORD).encode([text])[0]) == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_every_token_alone(byte_tokenizer):
    v = bpe.encoder(BYTE).vocabulary
    for i in random.Random(1).sample(range(len(v.bytes)), 3000):
        try:
            text = v.bytes[i].decode()
        except UnicodeDecodeError:
            continue
        assert ids_of(bpe.encoder(BYTE).encode(text)) == byte_tokenizer.encode(text, add_special_tokens=False).ids


def test_small_caches_change_nothing(monkeypatch, byte_tokenizer, texts):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    own, words, word_tokenizer = bpe.Encoder(BYTE), tokens.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for _, text, _ in texts[:30]:
        assert ids_of(own.encode(text)) == byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert ids_of(words.encode([text])[0]) == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_op8(spark, folder, texts, byte_tokenizer):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op8_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text, _ in texts:
        ids = byte_tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(byte_tokenizer.decode(ids, skip_special_tokens=False)))


def test_decoding_keeps_what_is_no_utf8(spark):
    rows = spark.createDataFrame([(1, [5]), (2, [188, 255]), (3, None), (4, [])], "id int, ids array<int>").withColumn("decoded", bpe.F.lit("x"))
    t = Tokenizer.from_file(BYTE)
    got = {r.id: r.decoded for r in bpe.decode(rows, BYTE).collect()}
    assert got == {1: t.decode([5]), 2: t.decode([188, 255]), 3: "", 4: ""}


def test_bpe_awkward(awkward, empty):
    assert bpe.encode(awkward, BYTE).count() == 5 and bpe.encode(empty, BYTE).count() == 0


def test_fill_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        counts = {r.randrange(1, 12): r.randrange(1, 4) for _ in range(r.randrange(1, 5))}
        room = r.randrange(1, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, room)
        assert all(n <= counts[length] for length, n in chosen) and sum(length * n for length, n in chosen) == max(s for s in sums if s <= room)


def check_packing(rows, texts, word_tokenizer, window):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""
    expected = {i: [*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in texts}
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        part = expected[doc][start : start + length]
        assert len(part) == length > 0 and total == len(expected[doc]) and crc == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert set(by_doc) == set(expected)
    for doc, parts in by_doc.items():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == len(expected[doc])
    sizes = []
    for parts in by_sequence.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:k]) for k in range(len(parts))]
        sizes.append(sum(p[1] for p in parts))
    assert all(s <= window and s & (s - 1) == 0 for s in sizes)


def test_op1(spark, folder, texts, word_tokenizer):
    rows = packing.op1_packing(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    check_packing([tuple(r) for r in rows], texts, word_tokenizer, 4096)


@pytest.mark.parametrize("pending", [100, 5000])
def test_small_windows(docs, texts, word_tokenizer, pending):
    from pyspark.sql import functions as F

    pieces = packing.pack(docs, WORD, window=64, pending_tokens=pending)
    rows = pieces.select("doc_id", "start", F.expr("octet_length(ids) / 4").cast("int"), F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    check_packing([tuple(r) for r in rows], texts, word_tokenizer, 64)
    # without cuts of remainders where some multiset fills a window, cuts are few
    assert len(rows) < 1.2 * sum(-(-r.doc_tokens // 64) for r in {r.doc_id: r for r in rows}.values()) + 30


def test_packing_awkward(awkward, empty):
    pieces = packing.pack(awkward, WORD).select("doc_id", "start", "doc_tokens", (F.octet_length("ids") / 4).cast("int").alias("n")).collect()
    assert sum(x.n for x in pieces) == sum({(x.doc_id, x.doc_tokens, x.start): x.doc_tokens for x in pieces if x.start == 0 and x.doc_id is None}.values()) + sum(x.n for x in pieces if x.doc_id == 1)
    assert sorted(x.doc_tokens for x in pieces if x.doc_id is None and x.start == 0)[0] == 1 and packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation(size):
    for key in (0, 1, token_output.KEY, -5):
        assert sorted(token_output.permuted(np.arange(size), size, key).tolist()) == list(range(size))
    if size == 1000:
        a, b = (token_output.permuted(np.arange(size), size, key) for key in (1, 2))
        assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(size), a)[0, 1]) < 0.1


def test_shards(spark, docs, texts, word_tokenizer, tmp_path):
    folder = f"file://{tmp_path}/shards"
    manifest = token_output.write(docs, folder, WORD, window=32, shard_slots=10).orderBy("slot").collect()
    assert [r.slot for r in manifest] == list(range(len(manifest))) and all(r.byte_offset == r.slot % 10 * 64 and r.shard == r.slot // 10 for r in manifest)
    read = list(token_output.read_slots(folder, 0, len(manifest), window=32, shard_slots=10))
    assert [zlib.crc32(x.tobytes()) for x in read] == [r.ids_crc32 for r in manifest]
    assert [x.tolist() for x in token_output.read_slots(folder, 7, 23, window=32, shard_slots=10)] == [x.tolist() for x in read[7:23]]
    kept = sorted(i for x, r in zip(read, manifest, strict=True) for i in x[: r.n_tokens].tolist())
    assert kept == sorted(i for _, t, _ in texts for i in [*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    back = {r.slot: bytes(r.ids) for r in token_output.read(spark, folder, window=32, shard_slots=10).collect()}
    assert back == {k: x.tobytes() for k, x in enumerate(read)}
    # a second run keeps whole shards and makes damaged ones anew
    shard = tmp_path / "shards" / token_output.shard_name(1)
    whole = shard.read_bytes()
    shard.write_bytes(whole[:100])
    token_output.write(docs, folder, WORD, window=32, shard_slots=10)
    assert shard.read_bytes() == whole


def plain_slot(index, size, key, rounds=6):
    """The permutation by definition: Feistel rounds over two halves, again and again until the value is inside."""
    mask = (1 << 64) - 1

    def mixed(x, k):
        x = (x + k) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return x ^ (x >> 31)

    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    keys = [mixed((r * 0x9E3779B97F4A7C15) & mask, key & mask) for r in range(1, rounds + 1)]
    while True:
        left, right = index >> half, index & (1 << half) - 1
        for k in keys:
            left, right = right, left ^ mixed(right, k) & (1 << half) - 1
        index = left << half | right
        if index < size:
            return index


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1025])
def test_slots_by_definition(size):
    for key in (0, 5, token_output.KEY, 1 << 60):
        assert token_output.permuted(np.arange(size), size, key).tolist() == [plain_slot(i, size, key) for i in range(size)]


def test_another_key_or_text_in_the_same_folder(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    for key, df in ((1, docs), (2, docs), (2, docs.limit(20)), (2, docs)):
        manifest = token_output.write(df, folder, WORD, window=32, shard_slots=10, key=key)
        back = {r.slot: zlib.crc32(bytes(r.ids)) for r in token_output.read(spark, folder, window=32, shard_slots=10).collect()}
        assert back == {r.slot: r.ids_crc32 for r in manifest.collect()}


def test_sequences_are_dealt_out_once(spark, docs, tmp_path):
    token_output.sequences(docs.repartition(3), WORD, window=32).write.parquet(f"{tmp_path}/made")
    rows, size = token_output.placed(spark.read.parquet(f"{tmp_path}/made"))
    # as with sequences that are too many to be sent themselves
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(r.slot for r in rows.select("slot").collect()) == list(range(size))


def test_op4(spark, folder):
    rows = token_output.op4_token_output(spark, folder).collect()
    assert len({r.slot for r in rows}) == len(rows) > 0 and all(r.ids_crc32 == r.read_crc32 for r in rows)


def test_shards_awkward(awkward, empty, tmp_path):
    assert token_output.write(empty, f"file://{tmp_path}/a", WORD).count() == 0
    manifest = token_output.write(awkward, f"file://{tmp_path}/b", WORD).collect()
    tokenizer = Tokenizer.from_file(WORD)
    expected = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(r.n_tokens for r in manifest) == expected
