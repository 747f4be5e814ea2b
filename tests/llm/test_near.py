"""Near copies, fingerprints and benchmark items against brute force."""

import hashlib
import random
import struct
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import contamination, ngram_join, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.queries import ORACLE, QUERIES


def words(text):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())


def grams(text):
    w = words(text)
    if not w:
        return frozenset([("whole", text)]) if text else None
    n = min(5, len(w))
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1))


def brute_groups(rows):
    """For each row its links and the least id it hangs together with."""
    sets = [grams(t) for _, t in rows]
    linked = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(linked[i])))
    return out


def as_text(rows):
    return sorted(map(str, rows))


def test_join_query(spark, sf_dir, documents):
    got = QUERIES["op1_ngram_join"](spark, sf_dir).collect()
    assert as_text(tuple(r) for r in got) == as_text(brute_groups(documents))


@pytest.fixture(scope="module")
def family(documents):
    """One text with more and more words changed, so that links form chains."""
    pick = random.Random(5)
    base = words(documents[3][1])[:150]
    rows = []
    for i in range(60):
        own = list(base)
        for at in pick.sample(range(150), i % 8):
            own[at] = pick.choice(["alpha", "beta", "gamma", "delta"])
        rows.append((i, " ".join(own)))
        if i % 5 == 0:
            base = own
    return rows


def test_family_in_blocks(spark, family, monkeypatch):
    """A component of many blocks gives the same as one compared whole."""
    frame = spark.createDataFrame(family, "doc_id long, text string").repartition(4)
    want = as_text(brute_groups(family))
    columns = ["doc_id", "class_id", "n_links"]
    got = ngram_join.near_groups(frame, recall=0.99999, most_hashes=256).select(columns)
    assert as_text(map(tuple, got.collect())) == want
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 3000)
    monkeypatch.setattr(ngram_join, "MOST_BLOCKS", 100)
    got = ngram_join.near_groups(frame, recall=0.99999, most_hashes=256).select(columns)
    assert as_text(map(tuple, got.collect())) == want
    # bucket by bucket, in one block and in many
    for most, weight in ((0, 250_000), (0, 3000), (2, 3000)):
        monkeypatch.setattr(ngram_join, "MOST_BLOCKS", most)
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", weight)
        got = ngram_join.near_groups(frame, recall=0.99999, most_hashes=256).select(columns)
        assert as_text(map(tuple, got.collect())) == want


def test_classes_that_agree_in_half_their_key(spark, family, monkeypatch):
    """Sets are told apart by 128 bits: with 64 equal ones everywhere nothing merges."""
    whole = ngram_join.signatures
    half = lambda *args: whole(*args).withColumn("_k1", F.expr("_k1 * 0"))
    monkeypatch.setattr(ngram_join, "signatures", half)
    rows = family + [(100, "nothing like it at all, not one word"), (101, None), (102, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.near_groups(frame, recall=0.99999, most_hashes=256)
    assert as_text(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == as_text(
        brute_groups(rows))


def test_a_chain_of_templates_is_not_compared_as_a_whole(spark, monkeypatch):
    """Families that overlap a little make one component; pairs compared follow the buckets."""
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    whole = [pick.choice(vocabulary) for _ in range(6000)]
    # neighbours are alike to 0.72 and mostly meet in some bucket; those seven apart share nothing
    rows = [(10 * i + k, " ".join([*whole[25 * i: 25 * i + 160], *(["x", "y"] * k)]))
            for i in range(220) for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 3000)

    def pairs(most):
        monkeypatch.setattr(ngram_join, "MOST_BLOCKS", most)
        found = {}
        whole_deal = ngram_join.deal

        def counted(weighed):
            dealt = whole_deal(weighed).checkpoint()
            cells = dealt.selectExpr("inline(_cells)").groupBy("part", "group").count()
            found["n"] = cells.selectExpr("sum(count * (count - 1) / 2)").first()[0]
            found["shared"] = weighed.selectExpr("explode(_bands) AS b").groupBy("b").count().selectExpr(
                "sum(count * (count - 1) / 2)").first()[0]
            return dealt

        monkeypatch.setattr(ngram_join, "deal", counted)
        groups = ngram_join.near_groups(frame).select("doc_id", "class_id", "n_links").collect()
        monkeypatch.setattr(ngram_join, "deal", whole_deal)
        return found, as_text(map(tuple, groups))

    all_pairs, want = pairs(1000)
    by_bucket, got = pairs(1)
    assert got == want == as_text(brute_groups(rows))
    assert by_bucket["n"] <= by_bucket["shared"] * 1.5
    assert by_bucket["n"] < all_pairs["n"] / 4


def test_join_awkward(awkward, awkward_rows, empty):
    rows = [r[:2] for r in awkward_rows]
    got = ngram_join.near_groups(awkward).select("doc_id", "class_id", "n_links").collect()
    want = brute_groups(rows)
    # a null or empty text is linked with nothing
    want = [(i, i, 0) if not t else w for (i, t), w in zip(rows, want)]
    assert as_text(map(tuple, got)) == as_text(want)
    assert ngram_join.near_groups(empty).count() == 0
    kept = ngram_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    distinct = {(i, t) for i, t in rows}
    classes = {(c, i if not t else None) for (i, t), (_, c, _) in zip(rows, want)}
    assert kept.count() <= len(distinct) and kept.count() >= len(classes) - 1
    assert ngram_join.one_of_each(empty).count() == 0


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.9995), (0.5, 0.99), (0.9, 0.999)])
def test_bands_reach_the_recall(threshold, recall):
    bands, rows = ngram_join.bands_for(threshold, recall, 192)
    assert bands * rows <= 192 and 1 - (1 - threshold**rows) ** bands >= recall


def test_signatures_find_pairs_as_often_as_they_should():
    hasher = ngram_join.Hasher(26, 6)
    pick = np.random.default_rng(2)
    found = 0
    for _ in range(400):
        both = pick.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = both[:360], both[40:]
        found += (hasher.keys(a) == hasher.keys(b)).any()  # similarity 0.8
    assert found >= 397
    far = sum((hasher.keys(x[:200]) == hasher.keys(x[160:])).any()
              for x in pick.integers(0, 2**63, (400, 360), dtype=np.uint64))
    assert far <= 8


def test_compare_cell():
    sets = [np.arange(0, 10), np.arange(1, 11), np.arange(0, 10), np.arange(50, 60)]
    sets = [s.astype(np.uint64) for s in sets]
    linked, root = ngram_join.compare_cell(
        sets, np.array([1, 2, 4, 8]), np.zeros(4, bool), True, Fraction(4, 5))
    assert linked.tolist() == [6, 5, 3, 0] and root.tolist() == [0, 0, 0, 3]
    linked, root = ngram_join.compare_cell(
        sets, np.array([1, 2, 4, 8]), np.array([True, True, False, False]), False, Fraction(4, 5))
    assert linked.tolist() == [4, 4, 3, 0] and root.tolist() == [0, 0, 0, 3]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)],
    [(0, i) for i in range(1, 40)] + [(100, 39), (-5, 100), (7, 8)],
    [(3, 1), (3, 2)], [(3, 2), (2, 1)], [(i, i * 7 % 97) for i in range(300)],
    [(i, j) for i in range(12) for j in range(i)],
])
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r[0]: r[1] for r in got} == {x: root(x) for x in list(parent)}
    assert len(got) == len(parent)


# ---- fingerprints --------------------------------------------------------------------------------


def signed_hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def fingerprint(text):
    h = [signed_hash(w.encode()) for w in words(text)]
    terms = [signed_hash(struct.pack("<Q", b), signed_hash(struct.pack("<Q", a)))
             for a, b in zip(h, h[1:])] if len(h) > 1 else h
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in terms) >= len(terms)) if terms else 0


def check_report(got, rows):
    """`rows`: distinct (doc_id, text), ids distinct and not null, in order of id."""
    prints = [fingerprint(t) for _, t in rows]
    bits = lambda x, y: bin(x ^ y).count("1")
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        r = got[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == f"{prints[i]:016x}"
        assert r["edited_fingerprint"] == f"{fingerprint(edited):016x}"
        assert r["near_edited"] == 1 - bits(prints[i], fingerprint(edited)) / 64
        assert r["near_next"] == 1 - bits(prints[i], prints[(i + 1) % len(rows)]) / 64
        want = sum(bits(prints[i], x) <= 3 for x in prints) - 1 if doc_id % 50 == 0 else None
        assert r["n_near"] == want


def test_fingerprint_query(spark, sf_dir, documents):
    rows = QUERIES["op8_fingerprints"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    check_report({r["doc_id"]: r for r in rows}, documents)


def test_fingerprint_awkward(spark, awkward, awkward_rows, empty):
    unique = [(i, t) for i, t, *_ in awkward_rows if i not in (None, 0)]
    got = simhash.fingerprint_report(spark.createDataFrame(
        [(i, t, "x") for i, t in unique], "doc_id int, text string, fingerprint string"))
    check_report({r["doc_id"]: r for r in got.collect()}, unique)
    rows = simhash.fingerprint_report(awkward).collect()
    assert len(rows) == len(awkward_rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["doc_id"], r["n_chars"]].add(tuple(r))
    assert all(len(v) == 1 for k, v in by_text.items() if k[0] is not None)
    assert simhash.fingerprint_report(empty).count() == 0
    alone = simhash.fingerprint_report(spark.createDataFrame(
        [(50, "one two three four five six")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1 and alone["n_near"] == 0


@pytest.mark.parametrize("radius, blocks", [(0, 1), (1, 3), (3, 5), (4, 8)])
def test_search_is_complete(spark, radius, blocks):
    pick = random.Random(radius)
    base = [pick.getrandbits(64) for _ in range(6)]
    values = []
    for i in range(400):
        x = pick.choice(base)
        for k in pick.sample(range(64), pick.randint(0, 6)):
            x ^= 1 << k
        values.append((x - (1 << 64) if x >> 63 else x, 1 + i % 3, i % 10 == 0))
    got = simhash.count_near(
        spark.createDataFrame(values, "_print long, _copies long, _query boolean"), radius, blocks)
    want = {q: sum(c for x, c, _ in values if bin((q ^ x) & (1 << 64) - 1).count("1") <= radius)
            for q, _, is_query in values if is_query}
    assert {r[0]: r[1] for r in got.collect()} == want


@pytest.mark.parametrize("radius, blocks", [(0, 1), (1, 3), (3, 5), (4, 8)])
def test_pairs_are_complete(spark, radius, blocks):
    pick = random.Random(radius)
    base = [pick.getrandbits(64) for _ in range(4)]
    values = {pick.choice(base) ^ sum(1 << k for k in pick.sample(range(64), pick.randint(0, 5)))
              for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    frame = spark.createDataFrame([(x,) for x in signed], "_print long")
    got = simhash.near_pairs(frame, frame.where("_print % 2 = 0"), radius, blocks).collect()
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert as_text(map(tuple, got)) == as_text(
        (x, y, bits(x, y)) for x in signed if x % 2 == 0 for y in signed if bits(x, y) <= radius)


def test_near_documents_are_named(spark, awkward, awkward_rows, documents, empty):
    pick = random.Random(8)
    long = [words(t) for _, t in documents if len(words(t)) > 150][:10]
    rows = [(100 * i + k, " ".join(w if pick.random() > 0.004 * k else "other" for w in own))
            for i, own in enumerate(long) for k in range(5)]
    rows += [(9000 + i, t) for i, t in rows[:3]] + [r[:2] for r in awkward_rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs, members = simhash.near_documents(frame)
    assert pairs.columns == ["fingerprint", "near_fingerprint", "distance"]
    of = {(i, t or ""): fingerprint(t or "") for i, t in rows}
    null = {(None, ""): of[None, ""]}
    want = defaultdict(int)
    for i, t in rows:
        want[f"{of[i, t or '']:016x}", i, t or ""] += 1
    assert as_text(map(tuple, members.collect())) == as_text(
        (f, i, n) for (f, i, _), n in want.items())
    prints = sorted({x - (1 << 64) if x >> 63 else x for x in [*of.values(), *null.values()]})
    hexed = lambda x: f"{x & (1 << 64) - 1:016x}"
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    expected = [(hexed(x), hexed(y), bits(x, y)) for n, x in enumerate(prints)
                for y in prints[n + 1:] if bits(x, y) <= 3]
    assert expected and as_text(map(tuple, pairs.collect())) == as_text(expected)
    assert [x.count() for x in simhash.near_documents(empty)] == [0, 0]


# ---- benchmark items -------------------------------------------------------------------------------


def brute_items(docs, items, threshold=0.8):
    def runs(text):
        w = words(text)
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}

    found = set()
    held = {(i, t): runs(t) for i, t in docs}
    for item, text in items:
        own = runs(text)
        for (i, _), have in held.items():
            n = len(own & have)
            if own and n >= contamination.least_shared(len(own), threshold):
                found.add((i, item, n, len(own), n / len(own)))
    return found


def test_items_query(spark, sf_dir, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    got = QUERIES["op6_decontamination"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == brute_items(documents, items) != set()


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_items_of_all_sizes(spark, documents, threshold):
    pick = random.Random(1)
    items, docs = [], list(documents[:60])
    for n in range(60):
        source = words(pick.choice(documents)[1])
        at = pick.randrange(max(1, len(source) - 80))
        part = source[at: at + pick.randint(1, 80)]
        items.append((n, " ".join(part)))
        broken = [w if pick.random() > 0.03 else "changed" for w in part]
        docs.append((1000 + n, "before it. " + ", ".join(broken).upper() + " after " * n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = contamination.find_items(
        frame, spark.createDataFrame(items, "item_id long, text string"), threshold=threshold)
    assert {tuple(r) for r in got.drop("_a", "_h").collect()} == brute_items(docs, items, threshold)


def test_items_awkward(spark, awkward, awkward_rows, empty):
    passage = " ".join(words(awkward_rows[2][1])[-40:])
    items = spark.createDataFrame(
        [(1, passage, 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (None, passage, 0),
         (1, passage, 0)], "item_id int, text string, doc_id int")
    found = contamination.find_items(awkward, items).collect()
    assert {(r["doc_id"], r["item_id"], r["containment"]) for r in found} == {(0, 1, 1.0)}
    left = contamination.without_items(awkward, items)
    assert left.columns == awkward.columns
    assert left.count() == len(awkward_rows) - 1
    gone = spark.createDataFrame([(1, " ".join(words(awkward_rows[3][1])[:60]))], "item_id int, text string")
    twice = awkward.unionByName(awkward.where("doc_id IS NULL"))
    assert contamination.without_items(twice, gone).where("doc_id IS NULL").count() == 2  # null texts
    assert contamination.find_items(empty, items).count() == 0
    assert contamination.without_items(awkward, items.limit(0)).count() == len(awkward_rows)
    with pytest.raises(ValueError):
        contamination.find_items(awkward, items, threshold=0)


def test_items_that_share_an_id_or_have_none_or_few_words(spark):
    pick = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    one, two, three = (" ".join(pick.sample(vocabulary, 40)) for _ in range(3))
    items = spark.createDataFrame(
        [(1, one), (1, two), (1, one), (None, three), (2, "Alpha, beta GAMMA"), (3, "omega"), (4, "?!"),
         (None, "tau rho")], "item_id int, text string")
    docs = spark.createDataFrame(
        [(10, f"a {one} b"), (11, two), (12, f"{one} x {two}"), (13, f"c {three}"),
         (14, "so alpha beta gamma, they said; alpha beta gamma"), (14, "alpha gamma beta"),
         (15, "omega"), (15, "omega"), (16, "tau"), (None, "tau rho and omega"), (17, None), (18, "clean ?!")],
        "doc_id long, text string")
    named = contamination.find_items(docs, items)
    assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in named.collect()) == [
        (10, 1, 1.0), (11, 1, 1.0), (12, 1, 1.0), (12, 1, 1.0)]
    found = contamination.find_items(docs, items, all_items=True).drop("_a", "_h").collect()
    assert as_text(map(tuple, found)) == as_text(
        [(10, 1, 36, 36, 1.0), (11, 1, 36, 36, 1.0), (12, 1, 36, 36, 1.0), (12, 1, 36, 36, 1.0),
         (13, None, 36, 36, 1.0), (14, 2, 1, 1, 1.0), (15, 3, 1, 1, 1.0),
         (None, 3, 1, 1, 1.0), (None, None, 1, 1, 1.0)])
    left = contamination.without_items(docs, items)
    assert as_text(map(tuple, left.collect())) == as_text(
        [(14, "alpha gamma beta"), (16, "tau"), (17, None), (18, "clean ?!")])


CLASHING = ("_row_a", "_row_h", "_keep_a", "_keep_h", "_gone_a", "_gone_h", "_null", "_row", "_a", "_h")


def test_columns_of_any_name_and_a_defined_survivor(spark, documents):
    """Helper names occur in the table; of rows with one id and text the least stays."""
    text = documents[0][1]
    rows = [(1, text, n) for n in (5, 3, 9)] + [(2, text, 0), (3, None, 4), (3, "", 4), (3, None, 2)]
    for names in (CLASHING, ("x",)):
        docs = spark.createDataFrame(
            [(i, t, *([n] * len(names))) for i, t, n in rows],
            "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)).repartition(4)
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert as_text(map(tuple, kept.collect())) == as_text(
            [(i, t, *([n] * len(names))) for i, t, n in [(1, text, 3), (3, None, 2), (3, "", 4)]])
        items = spark.createDataFrame([(1, text)], "item_id int, text string")
        left = contamination.without_items(docs, items)
        assert left.columns == docs.columns
        assert as_text(r["text"] for r in left.collect()) == as_text([None, None, ""])


def test_rows_with_maps_and_without_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", {"x": 1}), (1, "a b", {"x": 2}), (2, "c", None)],
                                 "doc_id long, text string, m map<string,int>")
    assert ngram_join.one_of_each(docs).count() == 2
    assert ngram_join.one_of_each(docs.drop("m")).count() == 2


def test_items_twin_on_awkward_items(spark, documents, tmp_path):
    """Ids that are shared or missing, short items, repeated and null rows: query and SQL agree."""
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    one, two, three = (" ".join(pick.sample(vocabulary, 40)) for _ in range(3))
    items = [(1, one), (1, two), (1, one), (None, three), (None, three), (2, "Alpha, beta GAMMA"),
             (3, "omega"), (3, one), (4, "?!"), (None, "tau rho"), (5, None), (6, "")]
    docs = [*documents[:20], (10, f"a {one} b"), (10, f"{two} c"), (11, two), (12, f"{one} x {two}"),
            (13, f"c {three}"), (14, "so alpha beta gamma; alpha beta gamma"), (15, "omega"),
            (15, "omega"), (None, "tau rho and omega"), (17, None), (None, three)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    result = con.execute(ORACLE["op6_decontamination"])
    columns = [d[0] for d in result.description]
    mine = QUERIES["op6_decontamination"](spark, str(tmp_path)).select(columns).collect()
    assert as_text(map(tuple, mine)) == as_text(result.fetchall())
    assert len(mine) > 12


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    mine = QUERIES[name](spark, sf_dir).select(columns).collect()
    assert as_text(map(tuple, mine)) == as_text(result.fetchall())
