"""Conversation repair against exhaustive edits and a plain fold."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from tidemark.llm import conversation_repair as CR

LEGAL = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def exhaustive(rows):
    """Every edit script with up to two insertions in a row."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    for ops in itertools.product(*[("D",) if f in (1, 2) else ("K", "Ru", "Ra", "D") for _, f in rows]):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, roles = 0, "", ""
            for i, g in enumerate(ins):
                cost, audit, roles = cost + 2 * len(g), audit + "I" * len(g), roles + g
                if i < len(rows):
                    c, f = rows[i]
                    cost += {"K": 0, "R": 2, "D": 3}[ops[i][0]] + (f == 3 and ops[i] != "D")
                    audit += ops[i][0]
                    roles += c if ops[i] == "K" else ops[i][1:]
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit, roles) < best):
                best = cost, audit, roles
    return best


def by_table(rows):
    """Least (cost, audit) from the end backwards, for longer conversations."""
    @cache
    def rest(i, s, inserts=0):
        found = [(0, "", "")] if i == len(rows) and s in (0, 3) else []
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s]
        if inserts < 2:
            found += [(2 + c, "I" + a, x + r) for x, t in step.items() if x != "s" for c, a, r in [rest(i, t, inserts + 1)] if c is not None]
        if i < len(rows):
            initial, f = rows[i]
            found += [(3 + c, "D" + a, r) for c, a, r in [rest(i + 1, s)] if c is not None]
            if f not in (1, 2):
                for x, t in step.items():
                    if x == initial or x != "s":
                        c, a, r = rest(i + 1, t)
                        if c is not None:
                            found.append((c + (f == 3) + (0 if x == initial else 2), ("K" if x == initial else "R") + a, x + r))
        return min(found, default=(None, "", ""))
    import sys
    sys.setrecursionlimit(20000)
    return rest(0, 0)


def test_search_against_all_edits():
    r = random.Random(5)
    cases = [[(r.choice("suax "), r.choice([0, 0, 0, 3, 1, 2])) for _ in range(n)] for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3)]
    for rows in cases:
        cost, audit, _ = CR.cheapest(rows, 0, CR.FINAL)
        assert (cost, audit) == exhaustive(rows)[:2] == by_table(rows)[:2], rows


def test_long_searches_and_blocks():
    """One search over all rows, and blocks of few rows, give the same cost and audit."""
    r = random.Random(6)
    for n in (5, 30, 100):
        for mix in ("ua", "suax", "u", "aaau", "s"):
            rows = [(r.choice(mix), r.choice([0, 0, 0, 0, 3, 1, 2])) for _ in range(n)]
            cost, audit, roles = by_table(rows)
            assert CR.cheapest(rows, 0, CR.FINAL)[:2] == (cost, audit)
            results = set()
            for block in (1, 3, 8, 1000):
                w = CR.Repair(block)
                for c, f in rows:
                    w.add(1, c, {0: "x.", 1: " ", 2: "y.", 3: "x"}[f], f == 2)
                results.add(w.result())
            (one,) = results
            assert one[5:7] == (cost, audit) and LEGAL.fullmatch(roles)


def plain(rows):
    """Results of rows (conv_id, turn, role, text), written out."""
    after, order = {}, lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    for conv, turn, role, text in rows:
        here = after.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        row = (turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        here += [row] * (2 if how == 3 else 1)
    out = {}
    for conv, here in after.items():
        here.sort(key=order)
        faults, seen = [], set()
        for _, role, text in here:
            chars = WORD.findall(text)
            faults.append(1 if not chars else 2 if (role, text) in seen else 0 if chars[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in here]
        turns = [t for t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, roles = by_table(list(zip(initials, faults)))
        lines, i, k = [], 0, 0
        for letter in audit:
            name = {"u": "user", "a": "assistant"}.get(roles[k] if letter != "D" else "")
            if letter == "I":
                lines.append(f"{name}:")
            elif letter != "D":
                lines.append(f"{here[i][1] if letter == 'K' else name}:{here[i][2]}")
            k += letter != "D"
            i += letter != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def compare(df, rows, **kw):
    got = {r["conv_id"]: tuple(r)[1:] for r in CR.repair(CR.damage(df), **kw).collect()}
    want = plain(rows)
    assert got == want


def test_given_conversations(spark, sf):
    for d in (sf, sf.replace("0.001", "0.01")):
        df = spark.read.parquet(f"{d}/conversations.parquet")
        compare(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    """Nulls everywhere, ties of a turn, repeated rows, one long conversation, very long texts, ids above 2^53 beside a null, other columns."""
    r = random.Random(8)
    roles, texts = ["user", "assistant", "system", None, "tool", " "], ["Yes.", "No", None, "", " \n", "a!", "long " * 20000 + ".", "é 日本?", "\x1c."]
    rows = [(r.choice([None, 2**60 + 1, 2**60 + 3, 5, 6]), r.choice([None, 1, 2, 3, 4, -7]), r.choice(roles), r.choice(texts)) for _ in range(120)]
    rows += [(77, i, ["user", "assistant"][i % 2] if r.random() < 0.9 else "assistant", f"turn {i}" + r.choice([".", ""])) for i in range(700)]
    rows += [(88, 5, "user", "same.")] * 40 + [(99, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    compare(df.selectExpr("*", "1 as audit", "2 as seen"), rows, block=50)
    assert CR.repair(CR.damage(df.limit(0))).count() == 0


def test_conversation_that_loses_all_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = CR.repair(CR.damage(spark.createDataFrame([(lost, 0, "user", "x.")], SCHEMA))).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
