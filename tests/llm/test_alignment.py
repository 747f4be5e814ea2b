"""Cross-tokenizer alignment against a plain version, and the perfect hash functions."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, pieces
from tidemark.llm.perfect_hash import PerfectHash
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import token_ids

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _byte_of():
    """The byte-level alphabet of the vocabulary file: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(rows):
    """The definition, with the tokenizers file and loops over bytes."""
    a_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = _byte_of()

    def a_bytes(i):
        return bytes(byte_of[c] for c in a_file.id_to_token(i))

    def b_bytes(i):
        piece = b_file.id_to_piece(i)
        code = re.fullmatch("<0x(..)>", piece)
        return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()

    docs, holding = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = a_file.encode(" " + text, add_special_tokens=False).ids
            b = b_file.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
                a = b = []
        owner_a = [i for i, t in enumerate(a) for _ in a_bytes(t)]
        owner_b = [i for i, t in enumerate(b) for _ in b_bytes(t)]
        links = sorted(set(zip(owner_a, owner_b)))
        holding.update({(a[i], b[j]) for i, j in links})
        groups, in_a, in_b = [], [], []
        for at, (i, j) in enumerate(zip(owner_a, owner_b)):
            if i not in in_a:
                in_a.append(i)
            if j not in in_b:
                in_b.append(j)
            end = at + 1 == len(owner_a)
            if end or (owner_a[at + 1] != i and owner_b[at + 1] != j):
                groups.append(",".join(str(a[x]) for x in in_a) + "|"
                              + ",".join(str(b[x]) for x in in_b))
                in_a, in_b = [], []
        docs.append((doc_id, a, b, groups, links))
    best = Counter()
    for (x, _), n in holding.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, groups, links in docs:
        counts = [(holding[a[i], b[j]], best[a[i]]) for i, j in links]
        out.append((doc_id, len(a), len(b), len(groups), len(links),
                    sum(n == m for n, m in counts), sum(n for n, _ in counts), ";".join(groups)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("shard_pairs, fan_in, held, words", [
    (1 << 16, 16, 1 << 20, 1 << 18), (50, 2, 100, 20)])
def test_awkward_documents(spark, awkward, awkward_rows, monkeypatch, shard_pairs, fan_in, held,
                           words):
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    monkeypatch.setattr(alignment, "KEPT_WORDS", words)
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1 if words == 20 else 64 << 20)
    counts = alignment.count_pairs(awkward, shard_pairs=shard_pairs, fan_in=fan_in)
    assert (counts.shards > 20) == (shard_pairs == 50)
    found = alignment.align(awkward, counts)
    assert found.columns == COLUMNS
    expected = plain_alignment([(r[0], r[1]) for r in awkward_rows])
    assert ordered(found.collect()) == ordered(expected)


def test_query(spark, sf_dir, documents):
    found = QUERIES["op13_token_alignment"](spark, sf_dir)
    expected = [
        (*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "")
        for r in plain_alignment(documents)]
    assert found.columns == [*COLUMNS[:7], "groups_sha256"]
    assert ordered(found.collect()) == ordered(expected)


def test_texts_that_do_not_round_trip(spark):
    rows = [(1, "one ▁ two"), (2, "<s> </s> <|endoftext|> <0x41> <unk>"), (3, "\x00\r\n\t  x "),
            (4, " "), (5, "① 日本 \U0001F600"), (6, "one two")]
    found = alignment.align_corpus(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = plain_alignment(rows)
    assert ordered(found.collect()) == ordered(expected)
    assert expected[0][1:] == (0, 0, 0, 0, 0, 0, "") and all(r[1] for r in expected[1:])


def test_empty_table_and_unseen_pairs(spark, empty):
    assert alignment.align_corpus(empty).count() == 0
    counts = alignment.count_pairs(empty)
    row = alignment.align(
        spark.createDataFrame([(1, "some words")], "doc_id long, text string"), counts).first()
    assert row.n_links > 0 and row.count_sum == row.n_best == 0


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 2)],
                                 "doc_id long, text string, groups string, `_text` long")
    assert alignment.align_corpus(docs).first().n_a == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é▁\n日 .,1'\x1c\u00a0\u3000\t"), max_size=12),
                min_size=1, max_size=20))
def test_cuts_change_no_ids(words):
    text = " ".join(words)
    if not text:
        return
    parts = pieces.word_starts(text)
    assert " ".join(parts) == text
    assert [i for x in parts for i in pieces.piece_ids(x)] == pieces.piece_ids(text)
    cut = [i for x in parts for i in token_ids(" " + x, special=False).tolist()]
    assert cut == token_ids(" " + text, special=False).tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 62, n).astype(np.uint64))
    function = PerfectHash.of(keys)
    again = PerfectHash(function.sizes, function.bits, function.keys)
    assert sorted(again.numbers(keys)) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(500, dtype=np.uint64), keys)
    assert (again.numbers(others) == -1).all()


def test_words_that_are_forgotten(monkeypatch, documents):
    monkeypatch.setattr(alignment, "KEPT_WORDS", 64)
    monkeypatch.setattr(alignment, "KEPT_LINKS", 300)
    v, texts = alignment.Vocabularies(), [t[:400] for _, t in documents[:60]]

    def value(pairs, ids):
        return pairs % 7 == 0, pairs % 11

    few = alignment.Words(v, value)
    for at in range(0, len(texts), 5):
        some = texts[at: at + 5]
        found, fresh = alignment.Texts(some, few), alignment.Texts(some, alignment.Words(v, value))
        assert found.groups() == fresh.groups()
        assert (found.sums() == fresh.sums()).all()
        assert (found.distinct_pairs() == fresh.distinct_pairs()).all()
    assert len(few.groups) < 1000


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError, match="not distinct"):
        PerfectHash.of(np.array([5, 5], np.uint64))


def test_lost_attempts_leave_no_trace(spark, awkward):
    """Files that no finished task has named are not read."""
    counts = alignment.count_pairs(awkward)
    before = ordered(alignment.align(awkward, counts).collect())
    folder = counts.folder.removeprefix("file:")
    with open(os.path.join(folder, "counts-0-lost.npz"), "wb") as lost:
        lost.write(b"half a fi")
    assert ordered(alignment.align(awkward, counts).collect()) == before
    assert spark.range(1).select(F.lit(1)).count() == 1
