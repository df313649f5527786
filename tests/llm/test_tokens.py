"""Encoding, counting, storing and packing, against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chunkmill.llm import bpe_codec, packing, token_counts, token_store
from chunkmill.llm.segments import segment
from chunkmill.llm.vocab import batch_ids, segment_ids

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ODD = st.lists(st.sampled_from([*" \t\n\r'srelvtmdxX.,!(é1<|>", "\x1c", "\x85", "\xa0", "\u0301", "\u1680", "\u2003", "\u2028", "\u3000", "日", "，", "😀", "²", "©", "速", "退", "造", "あ", "構", "報", *(bytes([0xE3, 0x81, b]).decode() for b in range(0x81, 0x8B)), "ʟ", "<|endoftext|>"]), max_size=60).map("".join)


def ids_of(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_codec_counts_and_segments_agree_with_the_library(path, text):
    want = ids_of(path, text)
    coder = bpe_codec.codec(path)
    assert coder.encode(text) == want
    assert coder.decode(want) == LIBRARY[path].decode(want, skip_special_tokens=False)
    own = segment_ids(path)
    cut = segment(pa.array([text, "", text + "a"]), own.fold)
    ids, bounds = batch_ids(cut.codes, cut.bounds, own(cut.words))
    assert ids[: bounds[1]].tolist() == want and bounds[1] == bounds[2]
    if path == BYTE:
        assert token_counts.transducer(path).count(text) == len(want)


@settings(max_examples=200, deadline=None)
@given(text=ODD, size=st.integers(1, 12))
def test_chunk_maps_compose_in_any_order(text, size):
    text = text.replace("<", "")
    machine = token_counts.transducer(BYTE)
    maps = [token_counts.chunk_map(machine, text[i : i + size], i == 0) for i in range(0, max(len(text), 1), size)]
    maps = [(h, n, token_counts._unpacked(token_counts._packed(k))) for h, n, k in maps]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = token_counts.compose(machine, left, m)
    for m in reversed(maps[:-1]):
        right = token_counts.compose(machine, m, right)
    assert token_counts.apply_map(machine, left) == token_counts.apply_map(machine, right) == len(ids_of(BYTE, text))


def frames(small, edge):
    return [(small, [(r.doc_id, r.text) for r in small.collect()]), (edge, [(r.doc_id, r.text) for r in edge.collect()])]


def test_encode(small, edge, empty):
    for df, rows in frames(small, edge):
        want = []
        for k, t in rows:
            ids = ids_of(WORD, t)
            text = LIBRARY[WORD].decode(ids, skip_special_tokens=False)
            want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = [tuple(r) for r in bpe_codec.encode_digests(df, WORD).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe_codec.encode(empty, WORD).count() == 0
    coded = bpe_codec.encode(edge, BYTE)
    back = bpe_codec.decode(coded, BYTE).collect()
    assert sorted(r.decoded for r in back) == sorted(r.decoded for r in coded.collect()) == sorted(r.text or "" for r in edge.collect())


def test_random_texts_through_whole_operators(spark):
    """Characters whose last bytes are those of non-ASCII spaces, beside all kinds of white space."""
    draw = random.Random(3)
    odd = [*" \t\n\r\x0b'sxX.,!(1<|", "\x85", "\xa0", "\u2003", "\u3000", *"é©速退造あ構報日ʟ", *(bytes([0xE3, 0x81, b]).decode() for b in range(0x81, 0x8B))]
    texts = ["© -- x", "速 報", "構造\n次の", "退 a", "あ b", "a ©\n(b)", *("".join(draw.choices(odd, k=draw.randrange(40))) for _ in range(10_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {k: ids_of(WORD, t) for k, t in enumerate(texts)}
    assert {r.doc_id: list(r.ids) for r in bpe_codec.encode(df, WORD).collect()} == want
    packed = defaultdict(list)
    for p in sorted(packing.pack_documents(df, WORD, 1, ids_too=True).collect(), key=lambda p: p.start):
        packed[p.doc_id] += p.ids
    assert packed == {k: [*ids, 1] for k, ids in want.items()}


@pytest.mark.parametrize("chunk", [1 << 16, 500])
def test_count_tokens(small, edge, empty, chunk):
    for df, rows in frames(small, edge):
        want = [(k, len((t or "").encode()), n := len(ids_of(BYTE, t)), n > 512) for k, t in rows]
        got = [tuple(r) for r in token_counts.count_tokens(df, BYTE, chunk=chunk).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@settings(max_examples=50, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=300), block=st.integers(1, 64))
def test_planes_round_trip(bits, ids, block):
    ids = np.array(ids, "<u4")
    assert token_store.from_planes(token_store.to_planes(ids, block, bits), len(ids), block, bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_store(spark, small, edge, empty, bits):
    for df, rows in frames(small, edge):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        want, start = [], 0
        for k, t in rows:
            ids = [*ids_of(BYTE, t), 2]
            want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = [tuple(r) for r in token_store.stored_digests(df, BYTE, 2, bits=bits).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.stored_digests(empty, BYTE, 2).count() == 0


def test_read_tokens(spark, edge):
    path = token_store.new_folder(spark, "t")
    token_store.write_tokens(edge, path, BYTE, 2)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in token_store.read_tokens(spark, path).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, [*ids_of(BYTE, r.text), 2]) for r in edge.collect())
    assert got == want


def test_stored_rows_say_how_they_were_made(spark, edge):
    want = sorted((r.doc_id is None, r.doc_id or 0, [*ids_of(BYTE, r.text), 2]) for r in edge.collect())
    for bits, block in ((True, 96), (False, 7)):
        path = token_store.new_folder(spark, "t")
        token_store.write_tokens(edge, path, BYTE, 2, bits=bits, block=block)
        assert {tuple(r) for r in spark.read.parquet(path).select("block", "bits", "end_id", "tokenizer").collect()} == {(block, bits, 2, hashlib.sha256(open(BYTE, "rb").read()).hexdigest())}
        assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in token_store.read_tokens(spark, path).collect()) == want


def test_difference_balances():
    sets = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(i for s in sets for i in s) == [0, 1, 2, 3, 4]
    assert abs(sum([8, 7, 6, 5, 4][i] for i in sets[0]) - 15) <= 1


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_pack_respects_capacity(lengths):
    sets = packing.pack(lengths, 64)
    assert sorted(i for s in sets for i in s) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in s) <= 64 for s in sets)


def test_pack_documents(small, edge, empty):
    for df, rows in frames(small, edge):
        pieces = packing.pack_documents(df, WORD, 1, ids_too=True).collect()
        sequences = defaultdict(list)
        for p in pieces:
            assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            sequences[p.sequence_id].append(p)
        for s in sequences.values():
            s.sort(key=lambda p: p.offset)
            assert [p.offset for p in s] == [sum(q.length for q in s[:i]) for i in range(len(s))]
            assert sum(p.length for p in s) <= 2048
        total = sum(p.length for p in pieces)
        assert total == sum(len(ids_of(WORD, t)) + 1 for _, t in rows)
        assert len(sequences) * 2048 < total * 1.05 + 4 * 2048
        whole = defaultdict(list)
        for p in pieces:
            whole[p.doc_id].append(p)
        for k, t in rows:
            if sum(1 for x, _ in rows if x == k) == 1:
                own = sorted(whole[k], key=lambda p: p.start)
                assert [i for p in own for i in p.ids] == [*ids_of(WORD, t), 1] and {p.doc_tokens for p in own} == {len(ids_of(WORD, t)) + 1}
    assert packing.pack_documents(empty, WORD, 1).count() == 0


@pytest.mark.parametrize("words", [0, 8, 18, 38, 300, 2500])
def test_short_and_long_documents_fill_their_sequences(spark, words):
    df = spark.createDataFrame([(i, " ".join(["the"] * words)) for i in range(20_000 if words < 100 else 1500)], "doc_id bigint, text string").coalesce(1)
    pieces = packing.pack_documents(df, WORD, 1).toPandas()
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and len(used) <= used.sum() / (2048 * 0.94) + 2
    assert pieces.length.sum() == df.count() * (words + 1) and not pieces.duplicated(["doc_id", "start"]).any()
