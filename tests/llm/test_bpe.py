from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starcart.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(encoder, texts):
    flat, lengths = encoder.encode_block([encoder.code(t) for t in texts])
    at, out = 0, []
    for n in lengths.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_random_texts_as_by_the_library(library):
    rng = random.Random(11)
    alphabet = [*"ab'sS tdéaaa\0 \n\t\r  \x0b\x1c\x7f.,!0१ÉßİΣσ日😀-_<|>", "́", "\x85", "\xa0", "　", "<|endoftext|>", "<|startoftext|>",
                "<|ENDOFTEXT|>", "'ll", "'re", "the", "ing", "hello", "world "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(6000)]
    encoder = bpe.Encoder(PATH, cache=300)  # emptied many times
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, ids in zip(some, encoded(encoder, some), strict=True):
            assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_runs_of_one_letter(library):
    words = [c * n for c in "aozx." for n in range(1, 70)]
    for word, ids in zip(words, encoded(bpe.Encoder(PATH), words), strict=True):
        assert ids == library.encode(word, add_special_tokens=False).ids, word


def test_index_against_plain_merging():
    """The index gives what merging pair by pair, least rank first, gives."""
    v = bpe.Vocabulary(PATH)
    rank = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(v.left, v.right, v.made, strict=True))}
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abehinorst", k=rng.randint(1, 14))).encode() for _ in range(800)})
    flat, lengths = v.encode_words(words)
    at = 0
    for word, n in zip(words, lengths.tolist(), strict=True):
        symbols = [*v.inner[list(word[:-1])].tolist(), int(v.last[word[-1]])]
        while True:
            found = min(((rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
            if not found:
                break
            i = found[1]
            symbols[i : i + 2] = [rank[symbols[i], symbols[i + 1]][1]]
        assert flat[at : at + n].tolist() == symbols, word
        at += n


def test_decode_as_by_the_library(library):
    rng = random.Random(3)
    lists = [[rng.randrange(49_408) for _ in range(rng.randint(0, 12))] for _ in range(300)] + [[49_406, 320, 49_407], []]
    decoder = bpe.Decoder(PATH)
    got = decoder.decode(pa.array([*lists, None, [5, 99_999]], pa.list_(pa.int32()))).to_pylist()
    assert got[:-2] == [library.decode(x, skip_special_tokens=False) for x in lists]
    assert got[-2:] == [None, library.decode([5], skip_special_tokens=False)]


def test_byte_level_decoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, decoder = Tokenizer.from_file(path), bpe.Decoder(path)
    lists = [library.encode(t, add_special_tokens=False).ids for t in ["héllo wörld 日本 😀", "", "a <|endoftext|> b"]] + [[162, 245], [50_000, 162]]
    assert decoder.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    config = json.load(open(PATH, encoding="utf-8"))
    config["model"]["dropout"] = 0.1
    (tmp_path / "dropout.json").write_text(json.dumps(config))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "dropout.json"))


@pytest.mark.parametrize("block_bytes", [24 << 20, 2000])
def test_edge_rows_and_clashing_columns(edges, edge_rows, library, block_bytes):
    docs = edges.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = bpe.encode(docs, PATH, block_bytes=block_bytes)
    rows = coded.withColumn("decoded", bpe.decode(F.col("ids"), PATH)).collect()
    assert Counter(map(str, rows)) == Counter(map(str, bpe.encode(docs, PATH, True, block_bytes).collect()))
    want = Counter()
    for doc_id, text in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want


def test_query(spark, library):
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.op13_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_no_documents(table):
    assert bpe.encode(table([]), PATH).collect() == []
