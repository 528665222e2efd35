"""Tool calls: linking, levels, cycles, schemas, canonical JSON."""

from __future__ import annotations

import json

from tidemark.llm import tool_calls as TC

CALLS = "conv_id long, turn long, call_id string, parent_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOLS = {"f": {"a": ("integer", True, None), "b": ("string", False, 3), "c": ("array", False, None)}}


def test_links_levels_and_errors(spark):
    calls = [
        (1, 5, "x", None, "f", '{"b":"é","a":1}'), (1, 1, "y", "x", "f", '{ "a" : 2.5 }'), (1, 2, "z", "y", "f", '{"a":1,"q":2,"b":"long"}'), (1, 3, "z", "x", "f", '{"a":9}'),
        (1, 7, "p", "q", "f", '{"a":1}'), (1, 8, "q", "p", "f", '{"a":1}'), (1, 9, "r", "q", "f", "[1]"), (1, 10, "s", "none", "g", "{}"),
        (None, None, None, None, None, None), (2, 1, "x", "y", "f", '{"a":1,"c":[{"k":1,"j":null}]}')]
    results = [(1, 6, "x", "r1"), (1, 4, "x", "r0"), (1, 6, "lost", None), (2, 2, "x", "two")]
    rows = TC.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()
    assert sorted((r["status"], r["turn"], r["result_turn"]) for r in rows if r["status"].startswith("dup")) == [("duplicate_call", 3, None), ("duplicate_result", None, 6)]
    assert json.loads(next(r["json"] for r in rows if r["status"] == "duplicate_result"))["result"] == "r1"
    out = {(r["conv_id"], r["call_id"]): r for r in rows if not r["status"].startswith("dup")}
    assert len(out) == 10
    level = {k: r["level"] for k, r in out.items()}
    assert level == {(1, "x"): 0, (1, "y"): 1, (1, "z"): 2, (1, "p"): -1, (1, "q"): -1, (1, "r"): -1, (1, "s"): 0, (None, None): None, (2, "x"): 0, (1, "lost"): None}
    errors = {k: r["errors"] for k, r in out.items()}
    assert errors[(1, "x")] == "" and errors[(1, "y")] == "type:a" and errors[(1, "z")] == "long:b,extra:q" and errors[(1, "r")] == "not_json"
    assert errors[(1, "s")] == "unknown_tool" and errors[(None, None)] == "not_json" and errors[(1, "lost")] is None
    assert out[(1, "x")]["result_turn"] == 4 and out[(1, "x")]["n_results"] == 2 and out[(1, "z")]["n_calls"] == 2 and out[(1, "z")]["turn"] == 2
    assert out[(1, "lost")]["status"] == "orphan_result" and out[(1, "y")]["status"] == "unanswered" and out[(2, "x")]["status"] == "linked"
    assert out[(1, "x")]["json"] == '{"arguments":{"a":1,"b":"é"},"call_id":"x","conv_id":1,"level":0,"name":"f","result":"r0","status":"linked"}'
    for r in out.values():
        assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_long_chain_and_star_of_calls(spark):
    n = 300
    chain = [(1, i, f"c{i}", f"c{i - 1}", "f", "{}") for i in range(n)]
    star = [(2, i, f"c{i}", "c0" if i else None, "f", "{}") for i in range(n)]
    out = TC.levels(spark.createDataFrame(chain + star, CALLS)).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in out} == {**{(1, f"c{i}"): i for i in range(n)}, **{(2, f"c{i}"): int(i > 0) for i in range(n)}}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, 2, "user", 'say "x"\n\t\\ é'), (None, 0, "user", "a"), (2, None, "user", "a"), (2, 0, None, "a"), (3, 4, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = TC.format_conversations(df).collect()
    got = {(r["conv_id"], r["turn"], r["result_turn"]): (r["status"], r["level"], r["valid"]) for r in out}
    assert got[(1, 0, 1)] == ("linked", 0, True) and got[(1, 2, None)] == ("unanswered", 1, True) and got[(3, None, 4)] == ("orphan_result", None, None)
    assert got[(None, 0, None)][0] == got[(2, None, None)][0] == "unkeyed_call" and got[(2, 0, None)][0] == "message"
    assert sum(1 + (r["status"] == "linked") for r in out) == len(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert TC.format_conversations(empty).count() == 0


def test_every_turn_is_in_some_row(spark):
    """Repeated rows, system turns, null ids: turns go in, the same turns come out; a text of a megabyte passes."""
    rows = [(2**60, 0, "system", "be brief"), (2**60, 1, "user", "hi"), (2**60, 2, "assistant", "x" * 1_000_000)] + [(2**60, 1, "user", "hi")] * 50 + [
        (None, t, r, "t") for t in (None, 1) for r in ("user", "assistant", "tool", None)] + [(7, 1, "assistant", "a")] * 3 + [(7, 1, "assistant", "b")]
    out = TC.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(1 + (r["status"] == "linked") for r in out) == len(rows)
    count = {}
    for r in out:
        count[r["status"]] = count.get(r["status"], 0) + 1
    assert count == {"linked": 1, "duplicate_call": 50, "message": 5, "unkeyed_call": 2, "unkeyed_result": 2, "orphan_result": 1, "duplicate_result": 3}
