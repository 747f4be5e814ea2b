"""The corpus pipeline: every stage against plain Python, and all of them together."""

import re
from collections import defaultdict
from pathlib import Path

import pytest
import corpus_pipeline
from tidemark.llm import secrets
from tidemark.llm.shared import drop, shared_folder
from .test_near import brute_groups, brute_items


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage and what comes out last."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], LARGER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_all_but_the_last_return_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_toxic_documents_go(stages):
    before, after = pairs(stages[0]), pairs(stages[1])
    assert set(after) < set(before)
    bad = re.compile(r"\b(idiot|moron|scum|loser)\b.*\b(trash|stupid|clown|pathetic)\b", re.S)
    assert not [i for i, t in after if bad.search(t.lower())]
    assert len(after) > 0.75 * len(before)


def test_one_of_each_class_stays(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    assert after == sorted(r for r, (i, c, _) in zip(before, brute_groups(before)) if i == c)


def test_documents_with_items_go(spark, stages):
    before, after = pairs(stages[2]), pairs(stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    gone = {x[0] for x in brute_items(before, items)}
    assert after == [r for r in before if r[0] not in gone]


def test_secrets_are_masked(stages):
    before, after = pairs(stages[3]), pairs(stages[4])
    assert [i for i, _ in before] == [i for i, _ in after]
    assert not secrets.spans_in([t for _, t in after])
    found = secrets.spans_in([t for _, t in before])
    assert found
    assert all(a == b for n, (a, b) in enumerate(zip(before, after)) if n not in found)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_everything_left_is_packed(spark, stages):
    left = defaultdict(int)
    for r in stages[5].collect():
        left[r["doc_id"]] += r["length"]
    assert left.keys() == {i for i, _ in pairs(stages[4])}
    rows = corpus_pipeline.run(spark, LARGER).collect()
    assert len({r["doc_id"] for r in rows}) == len(left)
    assert sum(r["length"] for r in rows) == sum(left.values())


def test_only_the_table_that_the_result_reads_stays(spark):
    """Each stage's table goes when the next is written, and the last at the end of the process."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    names = {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES}

    def tables():
        return {p.name for p in folder.iterdir() if p.name[:-33] in names}

    before = tables()
    rows = corpus_pipeline.run(spark, LARGER)
    left = tables() - before
    assert {n[:-33] for n in left} == {"secret-scans"}
    assert rows.count() > 0
    drop(spark, f"{folder}/{left.pop()}")
    assert tables() == before


def test_awkward_documents(spark, awkward_rows, sf_dir):
    """Nulls, repeats and empty texts go through all stages; an empty table gives no rows."""
    docs = spark.createDataFrame(
        [(i, t, None, None, n) for i, t, _, _, n, _ in awkward_rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    for frame, some in ((docs, True), (docs.limit(0), False)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir)
        assert bool(frame.count()) is some
