"""Packing and byte-level BPE against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from pagewright.llm import bpe, common, packing, pretok
from tests.llm.conftest import thue_morse


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=4000):
    rng = random.Random(7)
    fixed = ["it's we'll they're 'sabc 'x ''s '' 't\n's  foo\n\n bar  ", "é 'llama 'l 'rx 'r", "a b é²½Ⅳ 漢字 'S 're've\t\tx \n", "<|endoftext|>", "   "]
    return fixed + ["".join(rng.choice(" '\nabstrelvm1²,.é漢 　́") for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_pieces_are_those_of_the_public_pattern():
    rx, texts = regex.compile(P.PATTERN), random_texts()
    for lo, hi, buf, offsets in common.slices(pa.array(texts), 4096):
        start, end, _ = pretok.pieces(buf, offsets)
        raw, row = buf.tobytes(), np.searchsorted(offsets, start, "right") - 1
        got = [[] for _ in range(hi - lo)]
        for a, b, r in zip(start, end, row):
            got[r].append(raw[a:b].decode())
        assert got == [rx.findall(t) for t in texts[lo:hi]]


def test_packing_ids_are_those_of_the_library():
    library = Tokenizer.from_file(packing.vocabulary_path())
    texts = random_texts(500)
    ids, at = packing.coder(packing.vocabulary_path()).encode_rows(*common.texts(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_duckdb_ids_are_those_of_tiktoken(encoding, odd_texts):
    texts = random_texts(500) + [t or "" for t in odd_texts]
    ids, at = bpe.engine(bpe.ranks_path())[1].encode_rows(*common.texts(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoding.encode_ordinary(t) for t in texts]


def test_small_memory_of_pieces_changes_nothing(encoding):
    small = pretok.PieceIds(bpe.engine(bpe.ranks_path())[0].encode, most=10)
    texts = random_texts(60)
    for _, _, buf, offsets in common.slices(pa.array(texts), 64):
        ids, at = small.encode_rows(buf, offsets)
        raw, o = buf.tobytes(), offsets.tolist()
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoding.encode_ordinary(raw[a:b].decode()) for a, b in zip(o, o[1:])]


def test_bpe_round_trip(spark, documents, odd_texts, encoding):
    docs = documents(odd_texts)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(spark, docs).collect()}
    assert ids == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(odd_texts)}
    back = {r["doc_id"]: bytes(r["raw"]) for r in bpe.decode(spark, bpe.encode(spark, docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(odd_texts)}
    assert bpe.encode(spark, documents([])).count() == 0


def test_op5_digests(spark, documents, odd_texts, encoding, tmp_path):
    documents(odd_texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op5_byte_bpe(spark, str(tmp_path)).collect():
        text = odd_texts[r["doc_id"]] or ""
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def check_pieces(rows, texts, window):
    library = Tokenizer.from_file(packing.vocabulary_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, parts in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        done = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == done and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[done : done + r["length"]].tobytes())
            done += r["length"]
        assert done == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or k == len(by_sequence) - 1


def test_packing(spark, documents, odd_texts):
    docs = documents(odd_texts).repartition(3)
    check_pieces(packing.pack(spark, docs).collect(), odd_texts, packing.WINDOW)
    check_pieces(packing.pack(spark, docs, window=7).drop("ids").collect(), odd_texts, 7)
    assert packing.pack(spark, documents([])).count() == 0


def test_packing_repeated_and_null_ids(spark, documents):
    rows = packing.pack(spark, documents(["a b", "a b", "c"], [5, 5, None])).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("5", 3), ("5", 3), ("None", 2)]
    assert sorted(r["offset"] for r in rows) in ([0, 3, 6], [0, 2, 5], [0, 3, 5])


def test_words_of_one_hash_have_their_own_ids(encoding):
    texts = [*thue_morse(1024), *thue_morse(2048), thue_morse(2048)[0]]
    library = Tokenizer.from_file(packing.vocabulary_path())
    for coder, want in (
        (packing.Coder(packing.vocabulary_path()), [library.encode(t, add_special_tokens=False).ids for t in texts]),
        (bpe.engine(bpe.ranks_path())[1], [encoding.encode_ordinary(t) for t in texts]),
    ):
        for _ in range(2):  # within one slice, then from memory
            ids, at = coder.encode_rows(*common.texts(pa.array(texts)))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_special_strings_are_read_as_the_library_does():
    library = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n", "", "<|endoftext", "no", "x <|endoftext|>'s 's"]
    ids, at = packing.coder(packing.vocabulary_path()).encode_rows(*common.texts(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op5_of_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op5_byte_bpe(spark, str(tmp_path)).collect() == []
    assert packing.op7_packing(spark, str(tmp_path)).collect() == []
