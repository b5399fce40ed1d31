from __future__ import annotations

import pytest
from test_decontam import brute as contaminated
from test_jaccard import brute as components
from test_line_dedup import brute as lines

import corpus_pipeline as pipeline
from quire.llm.quality import classify_quality


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    """The input and result of every stage."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "mix"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality(spark, data, steps):
    scored = classify_quality(steps[0], spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert set(rows(steps[1])) == {r.doc_id for r in scored if r.predicted}
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality}
    assert len(good & set(rows(steps[1]))) >= 0.97 * len(good)


def test_line_dedup(steps):
    kept = {i: t for i, _, gone, t in lines(list(rows(steps[1]).items()), 50) if not gone or t.strip()}
    assert rows(steps[2]) == kept
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_copies(steps):
    groups = components(list(rows(steps[2]).items()), 5, 80)
    assert set(rows(steps[3])) == {i for i, _, top in groups if i == top}


def test_decontamination(spark, data, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = contaminated(list(rows(steps[3]).items()), items)
    assert set(rows(steps[4])) == {r[0] for r in got if not r[-1]}


def test_mix_and_run(spark, data, steps):
    last = sorted(tuple(r) for r in steps[5].collect())
    assert [r[0] for r in last] == sorted(rows(steps[4])) and sum(r[5] for r in last) > 0
    assert sorted(tuple(r) for r in pipeline.run(spark, data).collect()) == last


ODD = "doc_id long, text string, lang string, source string, n_chars int, id long, hash long, removed string, _id long, size long"


def test_stages_on_odd_rows(spark, data):
    """Nulls, empty texts, repeated rows, shared ids, ties, clashing columns; then the empty table."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [(1, None), (2, ""), (3, prose), (3, prose), (None, prose + " end"), (4, prose + " end"), (5, f"{prose}\nx\n{prose} y"), (6, "start " + item + " end"), (6, "other text of the same id"), (7, "a " * 50_000)]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 1, 2, "r", 3, 4) for i, t in texts], ODD)
    stages = dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES[:-1]:
        got, none = stage(spark, docs, data), stage(spark, docs.limit(0), data)
        assert got.columns == docs.columns and none.count() == 0, name
        assert all((r.id, r.hash, r.removed, r._id, r["size"]) == (1, 2, "r", 3, 4) for r in got.collect())
    kept = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, data).collect()), key=repr)
    assert [k for k, t in kept("decontamination")].count(6) == 1 and len(kept("decontamination")) == len(texts) - 1
    # Copies with one id stay together; a null id is judged alone; ids 4 and 5 (56 of 62 shingles) are near copies of id 3.
    assert kept("near_copies") == sorted([x for x in texts if x[0] not in (4, 5)], key=repr)
    assert {k for k, _ in kept("line_dedup")} >= {1, 3, 4, 5, 6, 7}
    mixed = stages["mix"](spark, docs, data)
    assert mixed.count() == len(texts) and stages["mix"](spark, docs.limit(0), data).count() == 0
