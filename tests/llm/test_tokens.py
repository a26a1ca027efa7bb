"""Token operators against the plain libraries, round trips and degenerate tables."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import byte_bpe, packing, token_counts, token_files, vocab

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD, RANKS = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, n_tokens string, ids int, row int"
TEXTS = [
    "", " ", "  ", "\n", "\n\n\n", " a", "a ", "a  b   c", "a \n b", "x\n\ny\n\n\nz", "tab\there", "it's they'll 'tis", "don't!",
    "of.\nThe end,\nnow", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b\n<|endoftext|>", "<|startoftext|>Hi", "Ünïcode ñandú ß",
    "é combining", "日本語 テキスト", "a b c  d", "\x1c\x1d x", "🙂🙂 ok", "123 4567 89.0", "A1b2 C_3", "###, &&& *** .!?",
    "İstanbul ΣΑΣ", "\r\nwin\r\n", "ab\u0000cd", "word" * 5000, "x " * 3000, "'s 't 're", "(hello) [world]", "a\x85b \x85 c",
]
ODD = st.text(st.sampled_from(list("ab'sT.,# \n\t\r1é²ß日  ́<|endoftext|>İΣ🙂\x1c")), max_size=60)


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path, text):
    return np.frombuffer(vocab.encode_packed(path, text), "<u4").tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunked_ids_equal_the_library(path):
    tokenizer = vocab.load(path)
    for text in TEXTS:
        assert ids_of(path, text) == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunked_ids_equal_the_library_on_odd_texts(text):
    for path in (BYTE, WORD):
        assert ids_of(path, text) == _LIBRARY[path].encode(text, add_special_tokens=False).ids


def test_words_with_marks_are_no_entries_of_their_own():
    """A comma or full stop behind a word is cut off before the cache is asked; the ids stay those of the library."""
    path = BYTE
    encoder, plain = vocab.ChunkEncoder(vocab.load(path), False, vocab.pack), vocab.load(path)
    text = "Start alpha, alpha. alpha beta. Eté, été, gamma,delta 3.5, 4.\nalpha, omega,\"x\" it's. end,"
    assert b"".join(encoder.values(text)) == vocab.pack(plain.encode(text, add_special_tokens=False).ids)
    assert "alpha" in encoder.spaced and not any(k[0] not in ",.\n\x01" and k[-1] in ",." for k in encoder.spaced)
    for text in (" , a", ",a, b", "a,, b", "a ., b", "(a), b", "a\n, b", "a\x01, b, c", "\x01a, b", "a \x01. b", "<|endoftext|>, a,", "a_, b", "´, b, c"):
        assert b"".join(encoder.values(text)) == vocab.pack(plain.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_rank_ids_equal_tiktoken(text):
    ids = byte_bpe.encode(RANKS, P.PATTERN, text)
    assert ids.tolist() == _TIKTOKEN.encode_ordinary(text)
    assert byte_bpe.decode_bytes(RANKS, ids) == text.encode()
    assert "".join(byte_bpe.decode_pieces(RANKS, ids)) == text


_LIBRARY = {path: vocab.load(path) for path in (BYTE, WORD)}
_TIKTOKEN = tiktoken_encoding()


def test_whole_corpus_equals_the_libraries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, BYTE).collect()}
    trips = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    assert counts.keys() == trips.keys() == texts.keys()
    for doc_id, text in texts.items():
        n = len(_LIBRARY[BYTE].encode(text, add_special_tokens=False).ids)
        assert (counts[doc_id].n_bytes, counts[doc_id].n_tokens, counts[doc_id].over_limit) == (len(text.encode()), n, n > 1024)
        ids = np.array(_TIKTOKEN.encode_ordinary(text), "<u4")
        assert trips[doc_id].n_tokens == len(ids) and trips[doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert trips[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_counts_of_sentencepiece_models(spark):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, None)], "doc_id long, text string")
    for row in token_counts.count_tokens(docs, model, limit=3).collect():
        text = "" if row.doc_id is None else TEXTS[row.doc_id]
        assert row.n_tokens == len(processor.encode(text)) and row.over_limit == (row.n_tokens > 3)


def test_offsets_cover_split_characters():
    text = "né 🙂日"
    ids = byte_bpe.encode(RANKS, P.PATTERN, text)
    starts, ends = byte_bpe.character_offsets(RANKS, ids)
    raw, at = byte_bpe._byte_table(RANKS), 0
    for i, s, e in zip(ids.tolist(), starts, ends, strict=True):
        assert raw[i] in text[s:e].encode() and e > s
        at += len(raw[i])
    assert at == len(text.encode()) and ends[-1] == len(text)


def odd_documents(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None), (3, None, None, 0, 0), (3, None, None, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_packing_covers_every_id_once(spark):
    docs, longest = odd_documents(spark), 64
    pieces = packing.pack_documents(docs, WORD, longest=longest).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    by_doc = {}
    for p in pieces:
        assert p.offset == 0 and p.length <= longest and p.length & (p.length - 1) == 0 and p.bucket == p.length.bit_length() - 1
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
    expected = {}
    for row in docs.collect():
        expected.setdefault(row.doc_id, []).append(_LIBRARY[WORD].encode(row.text or "", add_special_tokens=False).ids + [1])
    assert by_doc.keys() == expected.keys()
    for doc_id, many in expected.items():
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, many))
        if len(many) == 1:
            ordered = sorted(by_doc[doc_id], key=lambda p: p.start)
            assert b"".join(p.ids for p in ordered) == vocab.pack(many[0])
            assert [p.length for p in ordered] == packing.piece_lengths(len(many[0]), longest)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 4096, 5000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        planes = token_files.to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4) and (token_files.from_planes(planes, n, bits) == ids).all()


@pytest.mark.parametrize(("bits", "block"), [(False, 1 << 16), (True, 7), (False, 100)])
def test_token_files_read_back(spark, tmp_path, bits, block):
    docs, folder = odd_documents(spark), str(tmp_path / "files")
    token_files.write_token_files(docs, BYTE, folder, end_id=0, block_ids=block, bits=bits)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    expected = {}
    for r in rows:
        ids = _LIBRARY[BYTE].encode(r.text or "", add_special_tokens=False).ids + [0]
        expected.setdefault(r.doc_id, set()).add((len(ids), zlib.crc32(vocab.pack(ids))))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in expected[r.doc_id]
        start += r.n_tokens
    index = spark.read.parquet(f"{folder}/index").orderBy("start").collect()
    assert index[0].start == 0 and all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:], strict=False))


def test_empty_tables(spark, tmp_path):
    none = odd_documents(spark).where("false")
    folder = str(tmp_path / "none")
    token_files.write_token_files(none, BYTE, folder)
    results = [
        token_counts.count_tokens(none, BYTE), byte_bpe.round_trip(none, RANKS, P.PATTERN), packing.pack_documents(none, WORD),
        token_files.read_token_files(spark, folder), byte_bpe.encode_documents(none, RANKS, P.PATTERN),
    ]
    assert all(r.count() == 0 for r in results)


def test_encoded_documents_decode(spark):
    docs = odd_documents(spark)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in back) == sorted(
        (r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()
    )
