"""Encoding, BPE trees, token files, token counts and packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from gateledger.llm import bpetree, encode, packing, rangecoder, tokencounts, tokenfiles
from gateledger.session import fresh_path
from tests.llm.helpers import as_dict, awkward, odd_texts, words

ALPHABETS = [
    "ab", "a", "the ing'sLL", "AEIOU st", "é中文 \n\t", "!=-*#", "01 ", "ßüİſ\x1c\x85 \xa0x",
    "日本 ‍👍🏽", "<|endoftext|> a", "\n\n  ab\t",
]


def random_texts(n=600, seed=3):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(ALPHABETS)
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([5, 40, 300]))))


def plain(name):
    library = Tokenizer.from_file(P.path(name))
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference_bpe():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_give_the_library_ids(name):
    encoder, library = encode.Encoder(P.path(name)), plain(name)
    for text in [*random_texts(), "x <|endoftext|> y", "a<|startoftext|>b <|ENDOFTEXT|>", " a  b ", "a\n b"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text), text


@pytest.mark.parametrize("kept", [3, 1_000_000])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_give_the_library_ids(monkeypatch, name, kept):
    monkeypatch.setattr(encode, "REMEMBERED", kept)
    encoder, library = encode.Encoder(P.path(name)), plain(name)
    texts = [*random_texts(), "", " ", "\n", "x <|endoftext|> y", "a<|startoftext|>b <|ENDOFTEXT|> <|", "ΑΣ ΣΑΣ İ", "a\x00b \x7f's 'S"]
    for some in (texts, texts[::-1], texts[:1], ["one"], ["", "\n"], []):
        found = encoder.encode_all(pa.array(some, pa.string()))
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library(t) for t in some]


def test_a_batch_takes_each_piece_once(monkeypatch):
    encoder, met = encode.Encoder(P.path("word_bpe_49k.json")), []
    remembered = encoder.remembered
    monkeypatch.setattr(encoder, "remembered", lambda pieces: met.extend(pieces) or remembered(pieces))
    assert len(set(encoder.encode_all(pa.array(["the same words again"] * 500)))) == 1
    assert sorted(met) == ["again", "same", "the", "words"]


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    encoder, library = encode.Encoder(P.path("byte_bpe_50k.json")), plain("byte_bpe_50k.json")
    for text in random_texts(50):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text)


def test_little_stays_between_tasks(monkeypatch):
    monkeypatch.setattr(encode, "RESTING", 3, raising=False)
    encode._kept().clear()
    path, library = P.path("byte_bpe_50k.json"), plain("byte_bpe_50k.json")
    texts = ["first words stay of this text " + t for t in random_texts(20)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    task = []

    class Docs:  # the task's function, run here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            task.append(run)

    monkeypatch.setattr(packing, "slim", lambda docs, *_: docs)
    packing.pieces(Docs(), path, 1, 2048)
    found = [list(task[0](iter([batch]))) for _ in range(2)]
    assert found[0] == found[1]
    assert found[0][0].column(4).to_pylist() == [len(library(t)) + 1 for t in texts]
    encoder = encode.shared(path)
    assert list(encoder.pieces) == ["words", "stay", "of"] and len(encoder.words) == 3
    encode._kept().clear()


def test_tree_reduction_equals_plain_merging(reference_bpe):
    tree = bpetree.TreeEncoder(P.path("byte_bpe_50k.tiktoken"))
    for text in [*random_texts(), "a" * 9000, "ab" * 5000, "=-" * 3000 + "x" * 999]:
        ids = tree.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(text), text[:50]
        assert tree.decode(ids, width=7) == text.encode()


def test_bpe_table(spark, reference_bpe):
    texts = odd_texts()
    found = as_dict(bpetree.round_trip(awkward(spark, texts), P.path("byte_bpe_50k.tiktoken")))
    for doc, text in texts:
        ids = np.array(reference_bpe.encode_ordinary(text or ""), "<u4")
        assert found[doc].n_tokens == len(ids)
        assert found[doc].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpetree.encode_texts(awkward(spark, []), P.path("byte_bpe_50k.tiktoken")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 1000, 50_000])
@pytest.mark.parametrize("kind", ["even", "skewed", "same", "phrases"])
def test_range_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "even": rng.integers(0, 49408, n), "skewed": np.minimum(rng.geometric(0.01, n), 49407),
        "same": np.full(n, 49407), "phrases": np.tile(rng.integers(0, 49408, 17), n // 17 + 1)[:n],
    }[kind].astype("<u4")
    block = rangecoder.pack_ids(ids, 49408)
    assert (rangecoder.unpack_ids(block) == ids).all()
    if kind in ("same", "phrases") and n >= 50_000:
        assert len(block) < n


def test_order_0_is_counted_a_few_times_a_block(monkeypatch):
    ids = np.minimum(np.random.default_rng(4).geometric(0.001, 1 << 19), 49407).astype("<u4")
    summed, plain_sum = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda a, *args, **more: summed.append(len(a)) or plain_sum(a, *args, **more))
    block = rangecoder.pack_ids(ids, 49408)
    assert (rangecoder.unpack_ids(block) == ids).all()
    assert sum(n >= 49408 for n in summed) <= 32  # once for each of 128 rows, both ways, would be 256


@pytest.mark.parametrize("size", [1, 2, 300, 1 << 16, 1 << 17, 1 << 20, 1 << 23])
def test_range_coder_vocabularies(size):
    # runs of the last id lie at the end of the range, where carries are
    rng = np.random.default_rng(size)
    ids = np.where(rng.random(30_000) < 0.7, size - 1, rng.integers(0, size, 30_000)).astype("<u4")
    assert (rangecoder.unpack_ids(rangecoder.pack_ids(ids, size)) == ids).all()


def test_damaged_blocks_are_refused():
    block = bytearray(rangecoder.pack_ids(np.arange(500, dtype="<u4"), 600))
    for at in (8, len(block) // 2, len(block) - 60):
        bad = bytearray(block)
        bad[at] ^= 0x40
        with pytest.raises(ValueError):
            rangecoder.unpack_ids(bytes(bad))
    with pytest.raises(ValueError):
        rangecoder.unpack_ids(bytes(block[:-2]))


@pytest.mark.parametrize("block_ids", [50, 1 << 19])
def test_token_files_round_trip(spark, block_ids):
    texts, library = odd_texts(), plain("word_bpe_49k.json")
    path = fresh_path(spark)
    tokenfiles.write_ids(awkward(spark, texts), path, P.path("word_bpe_49k.json"), 2, block_ids)
    files = spark.read.schema(tokenfiles.SCHEMA).parquet(path)
    assert (files.count() > 2) or block_ids > 50
    found, at = as_dict(tokenfiles.read_documents(files)), 0
    for doc, text in sorted(texts):
        ids = np.array([*library(text), 2], "<u4")
        row = found[doc]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), doc
        at += len(ids)


def test_token_files_of_nothing(spark):
    path = fresh_path(spark)
    tokenfiles.write_ids(awkward(spark, []), path, P.path("word_bpe_49k.json"), 2)
    assert tokenfiles.read_documents(spark.read.schema(tokenfiles.SCHEMA).parquet(path)).count() == 0


def test_joined_checksums():
    parts = [b"one", b"", b"two and more", b"3" * 1000]
    assert tokenfiles.crc_join([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("block_bytes,span", [(16, 2), (64, 1000), (1 << 17, 1024)])
def test_separator_scan(spark, block_bytes, span):
    texts, library = odd_texts(), plain("byte_bpe_50k.json")
    path = fresh_path(spark)
    tokencounts.write_flat(awkward(spark, texts).coalesce(2), path, P.path("byte_bpe_50k.json"), 50256, block_bytes)
    files = spark.read.schema(tokencounts.SCHEMA).parquet(path)
    counted = tokencounts.count_tokens(files, 50256, span)
    found = as_dict(counted.join(tokencounts.named(files), ["file", "doc_no"]))
    assert {d: len(library(t)) + 1 for d, t in texts} == {d: r.n_tokens for d, r in found.items()}
    for file in {r.file for r in found.values()}:
        at = 0
        for row in sorted((r for r in found.values() if r.file == file), key=lambda r: r.doc_no):
            assert row.start == at and row.terminated
            at += row.n_tokens


def test_unterminated_rest(spark):
    ids = np.array([5, 9, 1, 9, 7, 7], "<u2").tobytes()
    rows = [(0, 0, ids[:6], None), (0, 1, ids[6:], None), (1, 0, ids[8:], None)]
    files = spark.createDataFrame(rows, tokencounts.SCHEMA)
    found = sorted(tuple(r) for r in tokencounts.count_tokens(files, 9, 1).select(
        "file", "doc_no", "start", "n_tokens", "terminated").collect())
    assert found == [(0, 0, 0, 2, True), (0, 1, 2, 2, True), (0, 2, 4, 2, False), (1, 0, 0, 2, False)]


def test_patterns_fill_and_fit():
    rng = random.Random(1)
    for _ in range(50):
        histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(0, 40))}
        patterns = packing.place(histogram, 64)
        placed = {}
        for count, sizes in patterns:
            assert count > 0 and sum(sizes) <= 64
            for size in sizes:
                placed[size] = placed.get(size, 0) + count
        assert placed == histogram


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(spark, length):
    rng = random.Random(2)
    texts = odd_texts() + [(100 + i, words(rng, rng.randint(0, 60))) for i in range(150)]
    library = plain("byte_bpe_50k.json")
    rows = packing.pack_documents(awkward(spark, texts), length=length).collect()
    ids = {d: np.array([*library(t), 1], "<u4") for d, t in texts}
    seen = {d: np.zeros(len(v), int) for d, v in ids.items()}
    by_sequence = {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id][r.start:r.start + r.length] += 1
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((v == 1).all() for v in seen.values())
    for held in by_sequence.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= length


def test_packing_nothing(spark):
    assert packing.pack_documents(awkward(spark, [])).count() == 0
