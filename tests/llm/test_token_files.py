"""Token files: the tokenizer itself, select against plain arrays, exact round trips."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weaksift.llm import token_files as tf

PATH = public_tokenizers.path(tf.VOCABULARY)
ROWS = "doc_id long, text string, ids string, tie int, row long, part int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROWS)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    bits = ["word", " the", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", "　", " ", "é", "ŭx", "ɐ", "漢字", "😀", "'s", "'ll",
            "don't", "123", "4", ".", ",", "!?", "<|endoftext|>", "<|", "\x00", "A", "İ", "ß", "_", "-", "ª", "²"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_encoder_equals_tokenizer(tokenizer):
    texts = odd_texts(20_000) + ["", " ", "\n", " a", "a ", "a   b", "x" * 100_000, "word, " * 20_000]
    encoder = tf.Encoder(PATH)
    for at in range(0, len(texts), 5_000):
        part = texts[at : at + 5_000]
        for text, ids in zip(part, encoder.encode(pa.array(part, pa.string()).slice(0))):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_encoder_on_slices_and_small_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(tf, "KNOWN", 20)
    texts = odd_texts(300, 2)
    encoder, array = tf.Encoder(PATH), pa.array(texts, pa.string())
    for a, b in ((0, 0), (0, 1), (7, 50), (50, 300)):
        for text, ids in zip(texts[a:b], encoder.encode(array.slice(a, b - a))):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n,top", [(1, 0), (1, 2**64 - 1), (255, 10), (256, 300), (257, 2**40), (5_000, 2**63), (3_000, 3)])
def test_select(n, top):
    rnd = random.Random(n)
    values = np.array(sorted(rnd.randint(0, top) for _ in range(n)), np.uint64)
    sequence, data = tf.elias_fano(values, top, 5)
    select = tf.Select(lambda at, size: (b"?" * 5 + data)[at : at + size], n, sequence)
    assert len(data) <= n * (sequence.low_bits + 3) / 8 + 4 * n / tf.EVERY + 12  # near the least
    assert (select(0, n) == values).all() and len(select(3, 3)) == 0
    for _ in range(200):
        a, b = sorted((rnd.randint(0, n), rnd.randint(0, n)))
        assert (select(a, b) == values[a:b]).all()


def test_file_round_trip(tmp_path):
    rnd = random.Random(3)
    ids = sorted(rnd.choice([-(2**63), 2**63 - 1, rnd.randint(-9, 10**6)]) for _ in range(700)) + [None] * 9
    docs = [np.array([rnd.randint(0, 65_535) for _ in range(rnd.choice([1, 2, 30]))], "<u2") for _ in ids]
    writer = tf.TokenWriter(f"file:{tmp_path}/new/a.tokens", 2)
    for a in range(0, len(ids), 100):
        writer.add(pa.array(ids[a : a + 100], pa.int64()), pa.array([d.tobytes() for d in docs[a : a + 100]], pa.binary()))
    writer.close()
    reader = tf.TokenReader(f"{tmp_path}/new/a.tokens")
    assert (reader.docs, reader.tokens) == (len(ids), sum(map(len, docs)))
    assert reader.ids_of(0, len(ids)).to_pylist() == ids and reader.ids_of(690, 705).to_pylist() == ids[690:705]
    assert reader.ids_of(702, 709).to_pylist() == [None] * 7
    for i in (0, 1, 255, 256, 257, len(ids) - 1):
        assert reader.document(i).tolist() == docs[i].tolist()
    reader.close()
    (tmp_path / "b.tokens").write_bytes(b"x" * 500)
    with pytest.raises(ValueError):
        tf.TokenReader(f"{tmp_path}/b.tokens")


@pytest.mark.parametrize("most,held", [(tf.FILE_TOKENS, tf.READ_TOKENS), (300, 7)])
def test_query_brute_force(spark, tmp_path, tokenizer, monkeypatch, most, held):
    monkeypatch.setattr(tf, "READ_TOKENS", held)
    rows = [(i * 7 % 1000 - 20, t) for i, t in enumerate(odd_texts(400, 4))]
    rows += [(None, None), (None, ""), (None, "null id"), (5000, None), (5001, "same"), (5001, "same"), (5001, "other"), (2**62, "far"), (-(2**62), "b")]
    rows += [(9000, "long text " * 30_000)]
    manifest = tf.write_token_files(frame_of(spark, rows), f"{tmp_path}/t", most_tokens=most, most_docs=50).cache()
    files = manifest.orderBy("part", "number").collect()
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    tokens, found = [], []
    for f in files:
        reader = tf.TokenReader(f["file"])
        assert f["tokens_before"] == len(tokens) and f["docs"] == reader.docs and f["tokens"] == reader.tokens
        for i, doc_id in enumerate(reader.ids_of(0, reader.docs).to_pylist()):
            found.append((doc_id, reader.document(i).tolist()))
            tokens += found[-1][1]
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert sorted(found, key=repr) == sorted(((d, ids_of(tokenizer, t)) for d, t in rows), key=repr)
    starts = np.cumsum([0] + [len(x) for _, x in found])
    plain = [(d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, x), s in zip(found, starts)]
    assert sorted((tuple(r) for r in tf.read_token_files(manifest).collect()), key=repr) == sorted(plain, key=repr)


def test_tables(spark, tokenizer):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    start, expected = 0, []
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    first = sorted(tuple(r) for r in tf.token_query(table).collect())
    assert first == expected
    assert sorted(tuple(r) for r in tf.token_query(table.repartition(5)).collect()) == first


def test_empty_table_and_wide_ids(spark):
    assert tf.token_query(frame_of(spark, [])).count() == 0
    only = tf.token_query(frame_of(spark, [(None, None)])).collect()
    assert [tuple(r) for r in only] == [(None, 0, 1, zlib.crc32(bytes(4)))]
    assert struct.calcsize(tf.FOOTER) == 112
