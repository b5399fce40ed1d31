from __future__ import annotations

import json
import random

from quire.streaming import events as E
from quire.streaming.keyed import KeyedTable

SCHEMA = "task_id string, sequence long, type string, text string"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_upsert_and_latest(spark, tmp_path):
    write(tmp_path / "in", "1.json", [{"task_id": "a", "sequence": 1, "type": "x"}, {"task_id": "b", "sequence": 5, "type": "y"}])
    write(tmp_path / "in", "2.json", [{"task_id": "a", "sequence": 3, "type": "z"}, {"task_id": "a", "sequence": 2, "type": "old"}])
    schema = spark.createDataFrame([], SCHEMA).schema
    source = E.tail(spark, str(tmp_path / "in"), schema, 1)
    kept = KeyedTable(spark, str(tmp_path / "out"), schema, ["task_id"], "sequence")
    E.drain(E.upsert_to(source, kept, str(tmp_path / "cp")))
    assert {(r.task_id, r.type) for r in kept.read().collect()} == {("a", "z"), ("b", "y")}
    E.drain(E.latest_by_key(source, "task_id", "sequence").writeStream.format("memory").queryName("lat").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")))
    assert {(r.task_id, r.sequence) for r in spark.table("lat").collect()} == {("a", 3), ("b", 5)}


def bytes_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_keyed_table(spark, tmp_path):
    """Random batches with deletions and repeated batch ids against a dictionary; a small batch writes little."""
    rng = random.Random(8)
    schema = spark.createDataFrame([], "k long, n long, text string, gone boolean").schema
    t = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], "n", "gone", buckets=4, compact_after=3)
    assert t.read().collect() == []
    want, number = {}, 0
    for batch in range(8):
        rows = []
        for _ in range(40):
            number += 1
            rows.append((rng.randrange(30), number - 50 * (rng.random() < 0.1), f"t{number}", rng.random() < 0.2))
        for k, n, text, gone in sorted(rows, key=lambda r: r[1]):
            if k not in want or n >= want[k][0]:
                want[k] = (n, text, gone)
        df = spark.createDataFrame(rows, schema)
        t.upsert(df, batch)
        if batch % 2:
            t.upsert(df, batch)  # again, as after a failure
        assert {r.k: (r.n, r.text, r.gone) for r in t.read().collect()} == {k: v for k, v in want.items() if not v[2]}
    k = next(k for k, v in want.items() if not v[2])
    assert [r.text for r in t.lookup(k=k).collect()] == [want[k][1]] and t.lookup(k=999).collect() == []
    assert len(list((tmp_path / "t").iterdir())) <= 2 + 2 * 3

    big = KeyedTable(spark, str(tmp_path / "b"), schema, ["k"], "n", "gone", buckets=4, compact_after=100)
    big.upsert(spark.range(200_000).selectExpr("id AS k", "id AS n", "sha2(cast(id AS string), 256) AS text", "false AS gone"), 0)
    before = bytes_of(tmp_path / "b")
    big.upsert(spark.createDataFrame([(5, 10**9, "new", False)], schema), 1)
    assert bytes_of(tmp_path / "b") - before < 10_000
    assert [r.text for r in big.lookup(k=5).collect()] == ["new"] and big.read().count() == 200_000


def test_incomplete_delta_is_not_read(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long").schema
    t = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], "n")
    t.upsert(spark.createDataFrame([(1, 1)], schema), 0)
    t.upsert(spark.createDataFrame([(2, 2)], schema), 1)
    (tmp_path / "t/delta-1/_SUCCESS").unlink()
    assert [r.k for r in t.read().collect()] == [1]
    t.upsert(spark.createDataFrame([(2, 2)], schema), 1)
    assert sorted(r.k for r in t.read().collect()) == [1, 2]


def test_live_state_over_restarts(spark, tmp_path):
    """Late and repeated sequences over three runs from one checkpoint, against the fold in Python."""
    rng = random.Random(9)
    rows = [(rng.choice("abc"), seq, kind, f"<{seq}>" if kind == "text_delta" else None, turn) for turn in range(3) for seq in rng.choices(range(1 + 10 * turn, 18 + 10 * turn), k=40) for kind in [rng.choice(["text_delta", "thinking", "done"])]]
    rows.append((None, 3, "x", None, 0))
    df = spark.createDataFrame(rows, SCHEMA + ", turn int")
    schema = spark.createDataFrame([], E.LIVE).schema
    live = KeyedTable(spark, str(tmp_path / "live"), schema, ["task_id"], "last_seq")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", E.ROCKS)
    try:
        E.replay(df, "turn", 3, str(tmp_path / "in"), lambda s: E.upsert_to(E.live_state(s), live, str(tmp_path / "cp"), "update"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = {}
    for turn in range(3):
        for task, seq, kind, text, _ in sorted((r for r in rows if r[4] == turn and r[0]), key=lambda r: (r[1], r[2], r[3] or "")):
            partial, phase, last = want.get(task, ("", None, 0))
            if seq > last:
                want[task] = (partial + text, phase, seq) if kind == "text_delta" else (partial, kind, seq)
    assert {r.task_id: (r.partial, r.phase, r.last_seq) for r in live.read().collect()} == want


def test_catch_up(spark):
    log = spark.createDataFrame([("t", i, f"e{i}") for i in range(1, 21)] + [("u", 1, "only")], "task string, seq long, body string")
    snapshots = spark.createDataFrame([("t", 17, "S17"), ("u", 0, None)], "task string, version long, body string")
    polls = spark.createDataFrame([(1, "t", 18), (2, "t", 15), (3, "t", 14), (4, "t", None), (5, "t", 20), (6, "u", 0), (7, "gone", 1)], "poll long, task string, cursor long")
    got = {}
    for r in E.catch_up(polls, snapshots, log, keep=5).collect():
        got.setdefault(r.poll, []).append((r.kind, r.seq, r.body))
    tail = [("event", i, f"e{i}") for i in range(16, 21)]
    resent = [("snapshot", 17, "S17"), *tail[2:]]
    assert got == {1: tail[3:], 2: tail, 3: resent, 4: resent, 6: [("event", 1, "only")]}


def test_windowed_counts(spark, tmp_path):
    write(tmp_path / "in", "1.json", [{"ts": "2024-01-01T00:00:00", "kind": "a"}, {"ts": "2024-01-01T00:02:00", "kind": "a"}, {"ts": "2024-01-01T00:07:00", "kind": "b"}])
    source = E.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], "ts timestamp, kind string").schema)
    E.drain(E.windowed_counts(source, "ts", "kind").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted((r.kind, r["count"]) for r in spark.table("win").collect()) == [("a", 2), ("b", 1)]


def test_snapshot_and_delta(spark):
    old = spark.createDataFrame([("a", "running"), ("b", "queued")], "id string, status string")
    new = spark.createDataFrame([("a", "completed"), ("c", "running")], "id string, status string")
    assert {(r.id, r.status) for r in E.with_snapshot(old, new, "id").collect()} == {("b", "queued"), ("c", "running")}
