"""Aligned tokens against whole-text encodings and byte offsets."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chunkmill.llm import queries, token_alignment
from chunkmill.llm.vocab import byte_alphabet
from tests.llm.conftest import SMALL

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
FIRST.encode_special_tokens = True
BACK = {c: b for b, c in enumerate(byte_alphabet())}
ODD = st.lists(st.sampled_from([*" \t\n\r'srelvtmdxX.,!(é1<|>", "  ", "the", "\x1c", "\x85", "\xa0", "́", " ", "　", "日", "報", "😀", "²", "\x00", "▁", "<s>", "<|endoftext|>"]), max_size=40).map("".join)


def offsets(text):
    """(id, begin, end) of the tokens of both sides by their bytes; None where one side's bytes are not those of the text."""
    if not text:
        return None
    a = [(i, bytes(BACK[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    b = [(i, piece(SECOND.id_to_piece(i))) for i in SECOND.encode(text)]
    out = []
    for side in (a, b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return None
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(text):
    """n_a, n_b, groups, links as a Counter of id pairs."""
    found = offsets(text)
    if found is None:
        return 0, 0, "", Counter()
    a, b = found
    both = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, begin = [], 0
    for end in both:
        groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in (a, b)))
        begin = end
    return len(a), len(b), ";".join(groups), Counter((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)


def want_rows(rows):
    made = [(k, *brute(t)) for k, t in rows]
    documents = Counter(p for *_, links in made for p in links)
    most = {}
    for (i, _), n in documents.items():
        most[i] = max(most.get(i, 0), n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return [(k, na, nb, len(g.split(";")) if g else 0, sum(x.values()), sum(n for p, n in x.items() if documents[p] == most[p[0]]), sum(n * documents[p] for p, n in x.items()), sha(g)) for k, na, nb, g, x in made]


@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_parts_align_like_whole_texts(text):
    align = token_alignment.aligner(BYTE, PIECE)
    parts, codes, bounds = token_alignment.cut_texts(pa.array([text, "", None, text + " a"]), align.beside)
    assert bounds[1] == bounds[2] == bounds[3] and b"".join(parts[i] for i in codes[bounds[3] :]) == (" " + text + " a").encode()
    made = align(parts)
    own = [made[i] for i in codes[: bounds[1]]]
    na, nb, groups, links = brute(text)
    if not na:
        assert not text or not all(m[0] for m in own)
        return
    assert (sum(m[1] for m in own), sum(m[2] for m in own), b";".join(m[4] for m in own).decode()) == (na, nb, groups)
    assert Counter((x >> 32, x & 0xFFFFFFFF) for m in own for x in m[5].tolist()) == links


def test_the_transducer_tells_differing_bytes():
    machine = token_alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x", b"abcd"])
    assert machine.align([0, 1], [0, 1]) == (["0,1|0,1"], [0, 1, (1 << 32) | 1])
    assert machine.align([2], [0, 1]) == (["2|0,1"], [2 << 32, (2 << 32) | 1])
    for a, b in (([0], [2]), ([0], [0]), ([0, 1], [3]), ([], [0]), ([0], [])):
        assert machine.align(a, b) is None
    assert machine.align([], []) == ([], [])


@pytest.mark.parametrize("head", [token_alignment.HEAD, 300, 0])
def test_counts_by_lookup_and_by_join(spark, monkeypatch, small, head):
    monkeypatch.setattr(token_alignment, "HEAD", head)
    df = small.where("length(text) < 3000")
    got = token_alignment.alignment_digests(df, BYTE, PIECE).collect()
    assert sorted(tuple(r) for r in got) == sorted(want_rows([(r.doc_id, r.text) for r in df.collect()]))


def test_edges(edge, empty):
    df = edge.where("doc_id is null or doc_id not in (10, 11)")
    got = token_alignment.alignment_digests(df, BYTE, PIECE).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want_rows([(r.doc_id, r.text) for r in df.collect()]), key=str)
    long = {r.doc_id: r for r in token_alignment.align_tokens(edge.where("doc_id in (10, 11)"), BYTE, PIECE).collect()}
    assert long[10].n_a == len(FIRST.encode(" " + "long " * 40_000).ids) and long[11].n_b == len(SECOND.encode("x" * 70_000))
    assert token_alignment.alignment_digests(empty, BYTE, PIECE).count() == 0


def test_query_has_a_row_for_each_document(spark, small):
    rows = queries.op11_token_alignment(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in small.collect())
    assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in rows)
