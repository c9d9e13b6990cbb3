from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starcart.llm import packing, token_files
from starcart.llm.tokens import PieceEncoder

WORDS, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path,style", [(WORDS, "words"), (BYTES, "spaced")])
def test_pieces_give_the_ids_of_the_whole_text(path, style):
    rng = random.Random(7)
    alphabet = list("ab'sS tdé\u0301 \n\t\r  \x0b\x1c\x85\xa0\u3000.,!0१ÉßİΣσ日😀") + ["<|endoftext|>", "'ll", "'re"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(5000)]
    encoder, whole = PieceEncoder(path, style, cache=500), tokenizer(path)
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path,style", [(WORDS, "words"), (BYTES, "spaced")])
def test_pieces_of_texts_with_nul(path, style):
    rng = random.Random(8)
    alphabet = list("ab \0\n\x1c.é")
    texts = ["a \0b", "a \0 b", "\0", " \0", "\0a", *("".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(5000))]
    encoder, whole = PieceEncoder(path, style, cache=500), tokenizer(path)
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


NAMES = ["x <|endoftext|> y", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|>c", "\n <|endoftext|>  \n z", "<|endoftext |>"]


@pytest.mark.parametrize("path,style", [(WORDS, "words"), (BYTES, "spaced")])
def test_pieces_with_names_of_special_tokens_as_by_the_plain_call(path, style):
    rng = random.Random(9)
    alphabet = [*"ab'sé \n\t\0.1", "\u0301", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>"]
    texts = [*NAMES, *("".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(5000))]
    encoder, plain = PieceEncoder.of_worker(path, style), Tokenizer.from_file(path)
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_operators_give_the_ids_of_the_plain_call(table):
    words, pieces = (Tokenizer.from_file(p) for p in (WORDS, BYTES))
    files = token_files.token_table(table(list(enumerate(NAMES))), WORDS, "words", 2, 49_408).collect()
    packed = packing.pack_documents(table(list(enumerate(NAMES))), BYTES, "spaced", end_id=0, length=2048).collect()
    for got, plain, end in ((files, words, 2), (packed, pieces, 0)):
        checksums = {r["doc_id"]: r["ids_crc32"] for r in got}
        for i, text in enumerate(NAMES):
            assert checksums[i] == zlib.crc32(np.array(plain.encode(text, add_special_tokens=False).ids + [end], dtype="<u4")), text


def expected_table(rows):
    t, start, out = tokenizer(WORDS), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for doc_id, text in order:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 20_000])
def test_table_from_the_files(edges, edge_rows, shard_bytes):
    got = token_files.token_table(edges, WORDS, "words", 2, 49_408, shard_bytes)
    rows = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()]
    assert Counter(rows) == Counter(expected_table(edge_rows))


def test_keyed_reads_and_unknown_keys(spark, table):
    rows = [(i * 3, f"some text {i} ## {i * 7}") for i in range(300)]
    path = token_files.write_shards(table(rows), WORDS, "words", 2, 49_408, shard_bytes=2000)
    directory = token_files.read_directory(spark, path, 49_408)
    index, parts = token_files.build_index(directory, part_keys=64)
    keys = spark.range(0, 900).select(F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"))
    found = token_files.lookup(keys, index, parts)
    assert sorted(r["doc_id"] for r in found.collect()) == [i * 3 for i in range(300)]
    t = tokenizer(WORDS)
    few = found.where("doc_id in (0, 33, 897)")
    for r in token_files.read_ids(spark, path, few, 49_408).collect():
        assert np.frombuffer(r["ids"], "<u2").tolist() == t.encode(rows[r["doc_id"] // 3][1], add_special_tokens=False).ids + [2]


def test_files_are_raw_ids_in_order(spark, table):
    rows = [(i, f"t {i}") for i in range(50)]
    path = token_files.write_shards(table(rows), WORDS, "words", 2, 49_408)
    content = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    assert len(content) == 1
    ids, lengths = token_files.read_footer(content[0]["content"], 2)
    stream = np.frombuffer(content[0]["content"], "<u2", int(lengths.sum()))
    t = tokenizer(WORDS)
    assert ids == list(range(50))
    assert stream.tolist() == [x for _, text in rows for x in t.encode(text, add_special_tokens=False).ids + [2]]


def test_minimal_perfect_hash():
    hashes = token_files._mix(np.arange(5000, dtype=np.uint64))
    levels, slots = token_files.build_mph(hashes)
    assert sorted(slots) == list(range(5000))
    assert (token_files.find_slots(levels, hashes) == slots).all()


def test_no_documents(table):
    assert token_files.token_table(table([]), WORDS, "words", 2, 49_408).collect() == []
    assert packing.pack_documents(table([]), BYTES, "spaced").collect() == []


def check_packing(rows, got, length):
    """Every id is in exactly one piece, pieces follow each other, sequences are gapless."""
    t = tokenizer(BYTES)
    pieces = Counter()
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        first = len(ids) % length or min(length, len(ids))
        cuts = [0, *range(first, len(ids), length), len(ids)]
        if len(ids) <= length:
            cuts = [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[doc_id, k, a, b - a, zlib.crc32(ids[a:b])] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= length
    return len(by), sum(k[3] * n for k, n in pieces.items())


@pytest.mark.parametrize("group_tokens", [20_000_000, 20_000])
def test_packing(edges, edge_rows, group_tokens):
    check_packing(edge_rows, packing.pack_documents(edges, BYTES, "spaced", length=2048, group_tokens=group_tokens).collect(), 2048)


def test_packing_is_nearly_tight(table):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(1, 90))) for i in range(600)]
    made, tokens = check_packing(rows, packing.pack_documents(table(rows), BYTES, "spaced", length=128).collect(), 128)
    assert made <= 1.02 * -(-tokens // 128)


def test_bounded_space_best_fit():
    """Against a plain search over the open sequences, with few of them open."""
    rng = random.Random(5)
    packer, opened, made = packing.BestFit(100, 3), [], 0
    for _ in range(2000):
        n = rng.randint(1, 100)
        sequence, offset = packer.add(n)
        fitting = [s for s in opened if 100 - s[1] >= n]
        if fitting:
            best = min(100 - s[1] for s in fitting)
            chosen = next(s for s in opened if s[0] == sequence)
            assert 100 - chosen[1] == best and offset == chosen[1]
            opened.remove(chosen)
            now = (sequence, offset + n)
        else:
            assert (sequence, offset) == (made, 0)
            made += 1
            now = (sequence, n)
        if now[1] < 100:
            opened.append(now)
        if len(opened) > 3:
            fullest = max(s[1] for s in opened)
            gone = [s for s in opened if s[1] == fullest]
            kept = {x for stack in packer.free.values() for x in stack}
            opened.remove(next(s for s in gone if s[0] not in kept))


def test_sequences_hold_the_ids(table):
    rows = [(i, f"text number {i} " * (i % 9 + 1)) for i in range(40)]
    pieces = packing.encode_pieces(table(rows), BYTES, "spaced", 0, 64, with_ids=True)
    packed = packing.pack(pieces, 64)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(part.astype("<u4")) == r["ids_crc32"]


def test_copies_of_one_row_are_dealt_to_all_groups(spark):
    rows = [(1, 0, 0, 10, 5, i) for i in range(3000)] + [(i, 0, 0, 1 + i % 64, i, i) for i in range(3000, 6000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, number long")
    packed = packing.pack(pieces, 64, group_tokens=6000, number="number")
    assert "number" not in packed.columns
    got = packed.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    groups, spans = Counter(), {}
    for r in got:
        groups[r["sequence_id"] >> 40] += r["length"]
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert max(groups.values()) < 2 * 6000
    for own in spans.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(spans) <= 1.1 * sum(r[3] for r in rows) / 64
