"""Tool calls and results lose no row."""

from collections import Counter

from quern.llm import toolcalls


def test_differing_calls_and_results_all_stay(spark):
    calls = spark.createDataFrame([
        (None, "a", None, 0, "search", "1"), (None, "a", None, 0, "search", "1"), (None, "a", "b", 1, "lookup", "2"), (None, "b", None, 2, "search", "3"), (1, None, None, 3, "search", "4"), (1, None, "x", 4, "search", "5"),
    ], "conv_id long, call_id string, parent_id string, seq int, name string, arguments string")
    results = spark.createDataFrame([(None, "a", "r"), (None, "a", "s"), (None, "a", "s"), (None, "a", None), (1, None, "t"), (1, None, "u"), (2, "lost", "v"), (2, "lost", "w")], "conv_id long, call_id string, content string")
    got = Counter((r.conv_id, r.call_id, r.arguments, r.content, r.status, r.copies, r.level) for r in toolcalls.levels(toolcalls.link(calls, results)).collect())
    assert got == Counter([
        (None, "a", "1", None, "answered", 1, 0), (None, "a", "2", None, "answered", 0, 1), (None, "a", None, "r", "answered", 0, 0), (None, "a", None, "s", "answered", 1, 0), (None, "b", "3", None, "unanswered", 0, 0),
        (1, None, "4", None, "unanswered", 0, 0), (1, None, "5", None, "unanswered", 0, 0), (1, None, None, "t", "orphan", 0, 0), (1, None, None, "u", "orphan", 0, 0), (2, "lost", None, "v", "orphan", 0, 0), (2, "lost", None, "w", "orphan", 0, 0),
    ])


def test_null_and_system_turns(spark):
    rows = [(1, None, "user", "one"), (1, None, "user", "two"), (1, None, "assistant", "three"), (1, 0, "system", "rules"), (1, 1, "user", "four"), (1, 2, "assistant", "five")]
    got = toolcalls.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert Counter((r.call_id, r.status) for r in got) == {(None, "unanswered"): 2, (None, "orphan"): 1, ("call-1-1", "answered"): 1}
    assert not [r for r in got if "rules" in r.message]
