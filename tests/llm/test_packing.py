import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import best_fit, bin_slack, separators, tokens
from tidemark.llm.queries import QUERIES
from tidemark.llm.shared import shared_path
from tidemark.llm.tokens import as_16_bits


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "a", "It's the end, isn't it?\n\n  x", "<|endoftext|> a<|endoftext|>", "日本語 ñ \U0001F600",
    "x" * 3000, " " * 500, "tab\tand\r\nbreak", "é  b", "１２３ 45,6",
])
def test_ids_are_those_of_tokenizers(encode, text):
    assert tokens.token_ids(text).tolist() == encode(text)


def check_pieces(rows, documents, encode, capacity=1024):
    """Every id in one piece, sequences gapless and full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text in documents:
        ids = np.array([*encode(text), 0], "<u4")
        want[doc_id, len(ids)].append(ids)
    assert by_doc.keys() == want.keys()
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        copies = want[key]
        assert sum(r["length"] for r in pieces) == key[1] * len(copies)
        for r in pieces:
            part = [zlib.crc32(c[r["start"]: r["start"] + r["length"]].tobytes()) for c in copies]
            assert r["ids_crc32"] in part
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0
    return by_sequence


def test_bin_slack_query(spark, sf_dir, documents, encode):
    rows = QUERIES["op9_bin_slack_packing"](spark, sf_dir).collect()
    sequences = check_pieces(rows, documents, encode)
    assert sum(sum(r["length"] for r in s) < 1024 for s in sequences.values()) <= 10


def test_bin_slack_awkward(awkward, awkward_rows, empty, encode):
    rows = bin_slack.pack_bin_slack(awkward).collect()
    check_pieces(rows, [r[:2] for r in awkward_rows], encode)
    assert bin_slack.pack_bin_slack(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_best_fill_is_the_best(counts, room):
    taken = bin_slack.best_fill(counts, room)
    assert all(0 < n <= counts[x] for x, n in taken.items())
    best = max(sum(x * n for x, n in zip(counts, choice))
               for choice in product(*(range(c + 1) for c in counts.values()))
               if sum(x * n for x, n in zip(counts, choice)) <= room)
    assert sum(x * n for x, n in taken.items()) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([4, 16, 32]), st.integers(2, 20))
def test_bin_slack_loses_nothing(lengths, capacity, pool):
    documents = [(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate(lengths)]
    got = defaultdict(list)
    for pieces in bin_slack.sequences(iter(documents), capacity, pool):
        total = sum(len(p.ids) for p in pieces)
        assert total == capacity or total & (total - 1) == 0
        for p in pieces:
            assert p.ids[0] == p.start
            got[p.doc_id] += p.ids.tolist()
    assert {k: sorted(v) for k, v in got.items()} == {i: ids.tolist() for i, ids in documents}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing_equals_a_plain_search(lengths):
    rooms, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r[0] >= lengths[i]]
        if fits:
            least = min(r[0] for r in fits)
            row = [r for r in fits if r[0] == least][-1]
        else:
            row = [20, []]
            rooms.append(row)
            want.append(row)
        row[0] -= lengths[i]
        row[1].append(i)
    got = best_fit.best_fit_decreasing(lengths, 20)
    assert sorted(i for row in got for i in row) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in row) <= 20 for row in got)
    assert len(got) == len(want)


def unpacked(rows):
    got = defaultdict(list)
    for r in rows:
        ids, positions = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        bounds = r["cu_seqlens"]
        assert bounds[0] == 0 and bounds[-1] == r["n_tokens"] and len(ids) == len(positions)
        assert not positions[bounds[-1]:].any() and (ids[bounds[-1]:] == 50256).all()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], bounds, bounds[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            got[doc].append((start, ids[a:b].tolist()))
    return got


def test_best_fit_query(spark, sf_dir, documents, encode):
    rows = QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    got = unpacked(rows)
    for doc_id, text in documents:
        assert sum((ids for _, ids in sorted(got[doc_id])), []) == [*encode(text), 50256]
    assert sum(r["n_tokens"] for r in rows) > 0.98 * 2048 * len(rows)


def test_best_fit_awkward(awkward, awkward_rows, empty, encode):
    got = unpacked(best_fit.pack_best_fit(awkward, row_tokens=64, window=500).collect())
    total = sum(len(ids) for pieces in got.values() for _, ids in pieces)
    assert total == sum(len(encode(r[1])) + 1 for r in awkward_rows)
    assert best_fit.pack_best_fit(empty).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack_best_fit(awkward, row_tokens=0)


def test_separator_query(spark, sf_dir, documents, encode):
    rows = QUERIES["op4_separator_scan"](spark, sf_dir).collect()
    assert all(r["terminated"] for r in rows)
    in_order = [r["n_tokens"] for r in sorted(rows, key=lambda r: (r["shard"], r["doc_index"]))]
    assert in_order == [len(encode(text)) for _, text in documents]


def test_separator_awkward(spark, awkward, awkward_rows, empty, encode):
    path = shared_path(spark, "test")
    separators.write_token_files(awkward, path)
    rows = separators.count_tokens(spark, path, block_tokens=7).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(encode(r[1])) for r in awkward_rows)
    path = shared_path(spark, "test")
    separators.write_token_files(empty, path)
    assert separators.count_tokens(spark, path).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_blocks_are_stitched(spark, tmp_path, block):
    """Files that other tools wrote: empty documents, none at all, an open end."""
    files = {"a.bin": [9, 9, 0, 0, 5, 0], "b.bin": [0], "c.bin": [], "d.bin": [1, 2, 3],
             "e.bin": [4, 0, 6, 6, 6, 6, 6], "f.bin": [7] * 30 + [0]}
    want = set()
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        start, index = 0, 0
        for i, x in enumerate(ids):
            if x == 0:
                want.add((name, index, start, i - start, True))
                start, index = i + 1, index + 1
        if start < len(ids):
            want.add((name, index, start, len(ids) - start, False))
    got = separators.count_tokens(spark, str(tmp_path), end_id=0, block_tokens=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_files_of_one_name_are_counted_by_themselves(spark, tmp_path):
    for folder, ids in (("one", [1, 2, 0, 3, 0]), ("two", [4, 0, 5, 5, 5, 0, 6])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = separators.count_tokens(spark, f"{tmp_path}/*", end_id=0, block_tokens=2).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 3]
    assert {r["shard"] for r in got} == {"a.bin"} and sum(not r["terminated"] for r in got) == 1


def test_a_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """Byte ranges of one file are units of work, and documents span them."""
    monkeypatch.setattr(separators, "RANGE_BLOCKS", 2)
    monkeypatch.setattr(separators, "TASK_BYTES", 100)
    pick = random.Random(2)
    lengths = [pick.choice([0, 1, 7, 150]) for _ in range(60)]
    ids = [x for n in lengths for x in [5] * n + [0]]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    blocks = separators.scan_blocks(spark, str(tmp_path), 0, 8)
    assert blocks.rdd.getNumPartitions() == -(-2 * len(ids) // 100)
    got = separators.count_tokens(spark, str(tmp_path), end_id=0, block_tokens=8).collect()
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["doc_index"])] == lengths
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="within an id"):
        separators.count_tokens(spark, str(tmp_path)).collect()


def test_ids_that_need_more_than_16_bits_are_refused():
    assert as_16_bits(np.array([0, 65535], np.uint32)).tobytes() == b"\0\0\xff\xff"
    assert len(as_16_bits(np.zeros(0, np.uint32))) == 0
    with pytest.raises(ValueError, match="16 bits"):
        as_16_bits(np.array([65536], np.uint32))


@pytest.mark.parametrize("file_bytes", [1, 1 << 28])
def test_packed_files_read_back(spark, awkward, awkward_rows, encode, empty, file_bytes):
    packed = best_fit.pack_best_fit(awkward, row_tokens=128).checkpoint()
    listed = best_fit.write_packed(packed, shared_path(spark, "packed"), file_bytes).collect()
    expected = {(bytes(r["input_ids"]), bytes(r["position_ids"]), tuple(r["cu_seqlens"]))
                for r in packed.collect()}
    found, n, texts = set(), 0, []
    for file in listed:
        arrays = best_fit.read_packed(file.asDict())
        assert arrays["input_ids"].shape == (file["n_rows"], 128) == arrays["position_ids"].shape
        for i in range(file["n_rows"]):
            low, high = arrays["cu_rows"][i: i + 2]
            bounds = arrays["cu_seqlens"][low:high].tolist()
            ids, positions = arrays["input_ids"][i], arrays["position_ids"][i]
            found.add((ids.tobytes(), positions.tobytes(), tuple(bounds)))
            texts += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            for a, b in zip(bounds, bounds[1:]):
                assert positions[a:b].tolist() == list(range(b - a))
            n += 1
    assert found == expected and n == packed.count()
    assert sum(map(len, texts)) == sum(len(encode(r[1])) + 1 for r in awkward_rows)
    assert (len(listed) == n) == (file_bytes == 1)
    assert best_fit.write_packed(
        best_fit.pack_best_fit(empty), shared_path(spark, "packed")).count() == 0
