"""Exit rules that share an entry share its searches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from test_exits import PRINT, walk
from tidemark.operators import trades as X
from tidemark.operators.ladder import Ladder


def test_rules_of_an_entry_share_their_searches(spark, monkeypatch):
    r = random.Random(8)
    rows, t, px = [], 1000, 10.0
    for blk in range(300):
        t += r.choice([0, 1, 7, 40])
        px = max(0.05, px * r.choice([0.7, 0.97, 1.0, 1.02, 1.4]))
        kind = r.choice(["v2", "v4"])
        rows.append(dict(tok="k", pool="a", ts=t, blk=blk, li=0, px=px, usd=r.choice([1.0, 20.0]), kind=kind, impact=None if kind == "v2" else r.choice([0.0, 0.01, 0.3]), low_other=r.choice([None, px])))
    end = t - 100
    rules = [{"rule": f"{tp}/{hold}", "tp": tp, "hold": hold} for tp in (1.2, 2.0) for hold in (30, 400, 5000)]
    entries = [dict(id=i, tok="k", pool="a", entry_ts=e["ts"], entry_blk=e["blk"], entry_px=e["px"], clip=1.0) for i, e in enumerate(r.sample(rows[:250], 60)) if e["ts"] <= end]
    prints = X.with_next_priceable(spark.createDataFrame([tuple(x[c.split()[0]] for c in PRINT.split(", ")) for x in rows], PRINT), ["tok", "pool"], 10.0, 500)
    at = {x["blk"]: x["rk"] for x in prints.collect()}
    pos = spark.createDataFrame([(*p.values(), at[p["entry_blk"]]) for p in entries],
                                "id long, tok string, pool string, entry_ts long, entry_blk long, entry_px double, clip double, entry_rk long")
    searched, first = [], Ladder.first

    def counted(self, want, *args, **kw):
        searched.append(want.select(F.size("_asks").alias("n")).agg(F.count("*"), F.max("n")).first())
        return first(self, want, *args, **kw)

    monkeypatch.setattr(Ladder, "first", counted)
    out = X.exit_first_hit(X.exit_overlays(pos, rules), prints, ["tok", "pool"], ["id"], end, [1.2, 2.0], [1.0], 20, 60, 10.0, 0.3, markup=1.0, slice_width=500, each="rules")
    got = {(x["id"], x["rule"]): (x["reason"], x["exit_px"], x["exit_ts"]) for x in out.collect()}
    want = {(p["id"], c["rule"]): walk(p | {"deadline": p["entry_ts"] + c["hold"], "tp_line": p["entry_px"] * c["tp"]}, rows, end, 20, 60, 10.0, 0.3, X.DEEP)[:3]
            for p in entries for c in rules}
    assert got == want and {w[0] for w in want.values()} >= {"tp", "time", "drain"}
    assert [tuple(n) for n in searched] == [(len(entries), 3)]  # a drain and two targets an entry, not two a rule
