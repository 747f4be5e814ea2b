"""Ranked lexical search against the plain definition."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bit_slices, lexical
from tidemark.llm.queries import ORACLE, QUERIES
from tidemark.llm.words import span_hashes

ITEMS = "item_id long, text string"


def plain_search(docs, items, top=10):
    found = [(i, Counter(lexical.terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    holding = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for (doc_id, counts), n in zip(found, sizes):
            m = 10 + (90 * n * n_docs) // n_terms if n_terms else 10
            score = 0
            for t in set(lexical.terms(text)):
                if tf := counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                    score += w * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, none, doc_id) in enumerate(sorted(
                scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item_id, rank, doc_id, -score))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_query(spark, sf_dir):
    for table in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS FROM '{sf_dir}/{table}.parquet'")
    expected = duckdb.sql(ORACLE["op12_lexical_search"])
    found = QUERIES["op12_lexical_search"](spark, sf_dir)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] == expected.columns
    assert ordered(found.collect()) == ordered(expected.fetchall())


AWKWARD_ITEMS = [
    (1, "Word two words"), (1, "word"), (2, None), (3, ""), (4, "!!! ?"), (None, "words"),
    (5, "nowhere to be found"), (5, "nowhere to be found"), (6, "日本語 ñandú É é"), (7, "x" * 5000)]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_tables(spark, awkward, awkward_rows, documents, monkeypatch, small):
    options = {}
    if small:
        monkeypatch.setattr(lexical, "GATHERED_TERMS", 300)
        monkeypatch.setattr(lexical, "BROADCAST_CANDIDATES", 0)
        monkeypatch.setattr(bit_slices, "BLOCK_DOCS", 3)
        monkeypatch.setattr(bit_slices, "BITS_A_TERM", 1)  # signatures that overestimate wildly
        options["item_chars"] = 3000
    items = [*AWKWARD_ITEMS, *((10 + i, t[:300]) for i, t in documents[:6])]
    docs = [(r[0], r[1]) for r in awkward_rows]
    found = lexical.search(awkward, spark.createDataFrame(
        [(*i, 1) for i in items], ITEMS + ", doc_id int"), **options)
    assert ordered(found.collect()) == ordered(plain_search(docs, items))


def test_more_equal_scores_than_places(spark):
    docs = [(i, "same words") for i in range(40, 0, -1)] + [(50, "other text")] * 30 + [
        (60, None)] * 20 + [(100 + i, f"filler number {i}") for i in range(100)]
    items = [(1, "words"), (2, "text"), (3, "filler words")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = lexical.search(table, spark.createDataFrame(items, ITEMS))
    assert ordered(found.collect()) == ordered(plain_search(docs, items))


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "word")], ITEMS)
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB zZ09_-é\x7f\x80日\n"), max_size=40),
                min_size=1, max_size=12), st.sampled_from([1, 16]))
def test_bounds_are_never_below_the_scores(texts, bits):
    found = bit_slices.terms_of([t.encode() for t in texts], span_hashes)
    assert found.sizes.tolist() == [len(lexical.terms(t)) for t in texts]
    assert np.diff(found.bounds).tolist() == [len(set(lexical.terms(t))) for t in texts]
    names = sorted({n for t in texts for n in lexical.terms(t)})
    if not names:
        return
    n_docs = sum(1 for t in texts if lexical.terms(t))
    items = lexical.Items(
        [0, 1], names, lexical.term_hashes(names), [np.arange(len(names)), np.array([0])],
        np.arange(1, len(names) + 1) * 100, n_docs, int(found.sizes.sum()))
    m = lexical.length_factor(found.sizes, items)
    for block in bit_slices.cut(bit_slices.entries(found)):
        width = max(64, bits * int(bit_slices.entries(found)[block].max()))
        upper = lexical.bounds(bit_slices.build(found, block, width), found.sizes[block], items)
        for column, at in enumerate(block):
            counts = Counter(lexical.terms(texts[at]))
            for row, of in enumerate(items.of):
                exact = sum(int(items.weights[i]) * ((10 ** 9 * counts[names[i]]) // (
                    1000 * counts[names[i]] + 8 * int(m[at]))) for i in of.tolist())
                assert upper[row, column] >= exact


def test_floors_leave_out_most_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = lexical.build_index(docs)
    assert index.selectExpr("sum(size(doc_ids))").first()[0] == docs.count()
    group, = lexical.item_groups(
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", 1 << 20)
    items = lexical.weighted(docs, lexical._items(group))
    first = lexical._scores(docs, lexical._highest(index, items, 10), items,
                            f"{lexical.scratch_folder(spark, 'first')}/first", "doc_id", "text")
    floors = np.ones(len(items.ids), np.int64)
    for row in lexical._ranked(first, 10).where("rank = 10").collect():
        floors[row["item"]] = row["score"]
    scored = lexical._reaching(index, items, floors).count()
    assert scored < 0.25 * len(items.ids) * docs.count()
