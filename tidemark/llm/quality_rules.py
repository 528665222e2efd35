"""Quality rules as a short-circuit cascade.

Every rule looks at one text and says whether to reject it. On a sample each rule's cost (seconds a text) and selectivity (share it
rejects) are estimated; rules then run in descending order of rejection per cost, and a text meets no rule after the first that rejects
it. The verdict does not depend on the order, only the work does.

Defined results: a null or empty text has no words and fails the first rule; equal rows are judged alike; an empty table gives no rows;
columns of the input are kept as they are, and one named like a result gets the suffix ``_in`` (``keep_good`` gives the columns it got).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACES, make_room, query, shielded, table, texts

SYMBOLS = "#*$%&|<>"
SAMPLE_FRACTION = 0.05
SAMPLE_ROWS = 400


class Text:
    """What the rules ask of a text; each measure is taken once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        self.__dict__[name] = value
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes.split() takes exactly the six spaces

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count, total, until = Counter(windows), 0, 0
        for i, x in enumerate(windows):  # words covered by a window found twice or more
            if count[x] > 1:
                total += i + 3 - max(i, until)
                until = i + 3
        return total

    def _n_bangs(self) -> int:
        return self.text.count("!")

    def _n_caps(self) -> int:
        return sum(w.isupper() and len(w) > 1 for w in self.text.split())


Rule = Callable[[Text], bool]
#: The two base rules, then the method's own.
BASE: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
OWN: dict[str, Rule] = {
    "symbols": lambda t: 4 * t.n_symbols > t.n_words,
    "exclamations": lambda t: 5 * t.n_bangs > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 16 * t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 7 * len(t.lines),
    "capitals": lambda t: 2 * t.n_caps > t.n_words,
}
RULES = BASE | OWN
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: dict[str, Rule] = RULES, fraction: float = SAMPLE_FRACTION, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rule, seconds, texts, rejected) over a sample of about ``rows`` texts (at most ``fraction`` of all), each timed where it lies; each rule is
    timed on a fresh text."""
    def measure(frames: Iterable[pd.DataFrame]):
        for pdf in frames:
            out = []
            for name, rule in rules.items():
                fresh = [Text(x) for x in pdf["text"]]
                began = time.perf_counter()
                rejected = sum(map(rule, fresh))
                out.append((name, time.perf_counter() - began, len(fresh), rejected))
            yield pd.DataFrame(out, columns=["rule", "seconds", "texts", "rejected"])

    sample = docs.select("text").sample(False, min(fraction, rows / max(docs.count(), 1)), 7)  # bounded before anything is shuffled
    parts = sample.mapInPandas(measure, "rule string, seconds double, texts long, rejected long")
    return parts.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "texts", "rejected")])


def best_order(docs: DataFrame, rules: dict[str, Rule] = RULES) -> list[str]:
    """Rule names by rejections per second of the sample, best first; ties and an empty sample keep the given order."""
    found = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in estimate(docs, rules).collect()}  # a row a rule
    return sorted(rules, key=lambda n: -found.get(n, 0.0))


def cascade(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None, measures: tuple[str, ...] = (),
            carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all) with kept (boolean), rules_run (int) and the measures asked for."""
    order = order or best_order(docs, rules)
    added = ["kept", "rules_run", *measures]
    docs = make_room(docs, added)
    keep = list(carry or docs.columns)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("kept", T.BooleanType()), T.StructField("rules_run", T.IntegerType())]
                          + [T.StructField(m, T.LongType()) for m in measures])

    at = keep.index("text") if "text" in keep else len(keep)

    def judge(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            verdicts, runs, values = [], [], []
            for x in texts(b.column(at)):
                t, n, ok = Text(x), 0, True
                for name in order:
                    n += 1
                    if rules[name](t):
                        ok = False
                        break
                verdicts.append(ok)
                runs.append(n)
                values.append([getattr(t, m) for m in measures])
            own = [pa.array(verdicts, pa.bool_()), pa.array(runs, pa.int32()), *[pa.array([v[i] for v in values], pa.int64()) for i in range(len(measures))]]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *own], [*keep, *added])  # carried columns stay in Arrow

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(judge, schema)


BASE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) as g from w),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
k as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i+1, i+2]) as p from r) group by 1),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
      cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
      len(lines) as n_lines, length(regexp_replace(t, '[^!]', '', 'g')) as n_bangs,
      len(list_filter(w, lambda x: length(x) > 1 and x = upper(x) and x <> lower(x))) as n_caps
      from w left join k using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 4 * n_symbols <= n_words and 5 * n_bangs <= n_words and word_chars between 2 * n_words and 16 * n_words
  and 10 * n_dup_lines <= 7 * n_lines and 2 * n_caps <= n_words as kept
from b
"""


@query("op2_quality_rules", BASE_SQL)
def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cascade(docs, measures=MEASURES, carry=["doc_id"])
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return out.select("doc_id", *MEASURES, ((n < 50) | (100 * r > 50 * n)).alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects."""
    return shielded(docs, lambda d: cascade(d).filter("kept").drop("kept", "rules_run"))
