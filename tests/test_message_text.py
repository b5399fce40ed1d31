from __future__ import annotations

from quire.operators import agents as A


def test_all_text_blocks_of_a_message(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate([
        '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"t","input":{"a":1}},{"type":"text","text":"one "},{"type":"thinking","text":"no"},{"type":"text","text":"two"}]}}',
        '{"type":"assistant","message":{"content":[{"type":"tool_use","name":"t"}]}}', '{"type":"assistant","message":{}}'])], "task int, n int, line string")
    assert [r.text for r in A.stream_events(lines, "task", "n").orderBy("n").collect()] == ["one two"]
