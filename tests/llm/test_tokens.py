import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tallyspark.llm import bpe, token_counts
from tests.llm.data import DOCS, docs, prose, rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("sizes", [(), (200, 50, 30), (64, 16, 8)])
def test_encode_equals_the_library(spark, reference, sizes):
    encoded = bpe.encode(docs(spark), PATH, P.PATTERN, *sizes)
    got = sorted(map(tuple, bpe.digests(encoded, PATH, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, t, *_ in rows():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_most_texts_are_chunked(spark, monkeypatch):
    long, own = sum(len(t or "") > bpe.CHUNK + bpe.OVERLAP for _, t, *_ in rows()), bpe.bpe(PATH, P.PATTERN)
    pieces = bpe.pieces_by_chunks(prose(1, 3000), own)
    assert long > 3 and "".join(pieces) == prose(1, 3000) and pieces == own.pattern.findall(prose(1, 3000))


def test_nothing_to_encode(spark):
    none = spark.createDataFrame([], DOCS)
    assert bpe.digests(bpe.encode(none, PATH, P.PATTERN), PATH, P.PATTERN).collect() == []
    assert token_counts.section_tokens(none, PATH, P.PATTERN).collect() == []


def test_decode_gives_the_texts_back(spark):
    encoded = bpe.encode(docs(spark), PATH, P.PATTERN)
    got = sorted(((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, PATH, P.PATTERN).collect()), key=str)
    assert got == sorted(((i, (t or "").encode()) for i, t, *_ in rows()), key=str)


def test_chunks_meet_or_give_way():
    vocab = bpe.bpe(PATH, P.PATTERN)
    r = random.Random(4)
    odd = ["".join(r.choice(["a", "bc", " ", "  ", "\n", "'ll", "7", "é", "字", "—", "!?"]) for _ in range(400)) for _ in range(40)]
    for text in ("a" * 500 + " b", "we'll  \n\n x1234 " * 40, "\n" * 300, "", *odd):
        for chunk, overlap in ((50, 4), (64, 20), (7, 3)):
            assert bpe.pieces_by_chunks(text, vocab, chunk, overlap) == vocab.pattern.findall(text)


def brute_counts(text, spans, rule, reference):
    out = [0.0] * len(spans)
    at = 0
    raw = text.encode()
    for token in reference.encode_ordinary(text):
        size = len(reference.decode_single_token_bytes(token))
        first = len(raw[:at].decode(errors="ignore"))
        last = len(raw[: at + size].decode(errors="ignore")) + (0 if raw[at + size : at + size + 1] == b"" or raw[at + size] & 0xC0 != 0x80 else 1)
        at += size
        part = [max(0, min(hi, last) - max(lo, first)) for lo, hi in spans]
        if rule == "first":
            out = [o + (lo <= first < hi) for o, (lo, hi) in zip(out, spans, strict=True)]
        elif rule == "share":
            out = [o + p / (last - first) for o, p in zip(out, part, strict=True)]
        elif max(part) > 0:
            out[part.index(max(part))] += 1
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_line(spark, reference, rule):
    got = {}
    for r in token_counts.section_tokens(docs(spark), PATH, P.PATTERN, rule).collect():
        got.setdefault((r.doc_id, r.doc_tokens), {}).setdefault((r.section, r.char_start, r.char_end), []).append(r.tokens)
    want = {}
    for i, t, *_ in rows():
        if t:
            spans = token_counts.line_spans(t)
            for k, (span, n) in enumerate(zip(spans, brute_counts(t, spans, rule, reference), strict=True)):
                want.setdefault((i, len(reference.encode_ordinary(t))), {}).setdefault((k, *span), []).append(n)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys()
        for s in want[k]:
            assert np.allclose(got[k][s], want[k][s])


def test_token_counts_of_given_sections(spark, reference):
    df = spark.createDataFrame([(1, "abc def ghi jkl", [(0, 5), (9, 12)]), (2, "x", []), (3, None, [(0, 1)])], "doc_id long, text string, sections array<struct<start: int, end: int>>")
    got = token_counts.section_tokens(df, PATH, P.PATTERN, "share", split=None).orderBy("section").collect()
    assert [r.tokens for r in got] == pytest.approx(brute_counts("abc def ghi jkl", [(0, 5), (9, 12)], "share", reference))
    with pytest.raises(ValueError):
        token_counts.section_tokens(df, PATH, P.PATTERN, "half")
