"""Chat formatting with tool calls: link, order, validate, serialise. DataFrame functions only.

Calls meet their results in a hash join on (conversation, call id). A call may name the call whose result it builds on; the calls of a
conversation then form a forest, and a call's level is its number of ancestors, found by pointer doubling (rounds grow with the logarithm
of the longest chain). Sorted by (level, turn, call id) every call stands after what it builds on. Arguments are parsed once, checked
against the tool's schema, and written as canonical JSON: keys sorted, no white space.

Defined results: every turn is in some row. Of several calls with one id the first by turn is linked, and so for results (n_calls and n_results say
how many there were); the others are rows of status 'duplicate_call' and 'duplicate_result'. Calls and results without a conversation or an id are rows of
their own ('unkeyed_call', 'unkeyed_result'); turns of other roles are rows of status 'message' with their text. A call without a result is 'unanswered' and has result null; a result without a call is 'orphan_result' and has no level; a parent that
does not exist counts as none; calls on a cycle of parents, or below one, get level -1; arguments that are null or no JSON object give the
error 'not_json'; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, query, table
from tidemark.session import cut_lineage

#: tool -> field -> (JSON type, required, longest text). The registered query's tools.
SCHEMAS: dict[str, dict[str, tuple[str, bool, int | None]]] = {
    "lookup": {"query": ("string", True, 100)},
    "answer": {"prompt": ("string", True, None), "words": ("integer", True, None)},
    "summarise": {"prompt": ("string", True, None), "words": ("integer", True, None), "max_words": ("integer", False, None)},
}
# How a parsed value's SQL type begins, by JSON type.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls (conv_id, call_id, parent_id)."""
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    ids = calls.select("conv_id", "call_id")
    up = calls.alias("c").join(ids.alias("p"), same("c", "p") & (F.col("c.parent_id") == F.col("p.call_id")), "left")
    at = cut_lineage(up.select("c.conv_id", "c.call_id", F.col("p.call_id").alias("up"), F.when(F.col("p.call_id").isNotNull(), 1).otherwise(0).alias("d")))
    left = at.filter("up is not null").count()
    while left:
        # each pointer takes over its target's pointer; the way so far grows by the target's way
        nxt = at.alias("a").join(at.alias("b"), same("a", "b") & (F.col("a.up") == F.col("b.call_id")), "left")
        at = cut_lineage(nxt.select("a.conv_id", "a.call_id", F.col("b.up").alias("up"), (F.col("a.d") + F.coalesce("b.d", F.lit(0))).alias("d")))
        now = at.filter("up is not null").count()
        if now == left:  # on a chain some call reaches the root in every round: what is left turns in circles
            break
        left = now
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("d")).otherwise(-1).cast("int").alias("level"))


def _errors(name: Column, arguments: Column, parsed: Column, schemas) -> Column:
    """Array of what is wrong with a call's arguments, in the order of the schema's fields."""
    none = F.array().cast("array<string>")
    found = F.array(F.lit("unknown_tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required, longest) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            wrong = ~F.schema_of_variant(value).rlike(f"^({_TYPES[kind]})")
            case = F.when(value.isNull(), F.lit(f"missing:{field}") if required else F.lit(None)).when(wrong, F.lit(f"type:{field}"))
            if longest is not None:
                case = case.when(F.length(F.try_variant_get(parsed, f"$.{field}", "string")) > longest, F.lit(f"long:{field}"))
            checks.append(case)
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields])))
        extra = F.transform(extra, lambda k: F.concat(F.lit("extra:"), k))
        found = F.when(name == tool, F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), F.coalesce(extra, none))).otherwise(found)
    return F.when(F.coalesce(F.json_object_keys(arguments), F.lit(None)).isNull() | parsed.isNull(), F.array(F.lit("not_json"))).otherwise(found)


def _keyed(rows: DataFrame, body: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (conv_id, call_id, body) as the first of every key with its number ``n``, the other rows of a key, and rows without a key.

    Rows that are equal in every column are counted first, so a row that comes a million times is one row until it is written out again.
    """
    key = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    each = cut_lineage(rows.filter(known).groupBy(*key, *body).agg(F.count("*").alias("_times")))
    first = cut_lineage(each.groupBy(*key).agg(F.min(F.struct(*body)).alias("_first"), F.sum("_times").alias("n")))
    more = each.join(first.filter("n > 1"), key)
    is_first = F.struct(*body).eqNullSafe(F.col("_first"))
    more = more.withColumn("_left", F.col("_times") - F.when(is_first, 1).otherwise(0)).filter("_left > 0")
    more = more.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left")))).select(*key, *body, "n")
    return first.select(*key, "_first.*", "n"), more, rows.filter(~known).select(*key, *body, F.lit(1).cast("long").alias("n"))


def link_calls(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """``calls`` (conv_id, turn, call_id, parent_id, name, arguments) and ``results`` (conv_id, turn, call_id, content) to one row per call
    and per result that is not a call's: (conv_id, call_id, turn, result_turn, status, level, valid, errors, n_calls, n_results, json)."""
    key = ["conv_id", "call_id"]
    c, c_more, c_free = _keyed(calls, ["turn", "parent_id", "name", "arguments"])
    r, r_more, r_free = _keyed(results, ["turn", "content"])
    c, r = c.withColumnRenamed("n", "n_calls"), r.select(*key, F.col("turn").alias("result_turn"), "content", F.col("n").alias("n_results"))
    c = c.join(levels(c.select(*key, "parent_id")), key)
    j = c.join(r, key, "full")
    status = F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    linked = j.withColumn("status", status).withColumn("_call", F.col("n_calls").isNotNull())
    none = lambda kind, *cs: {x: F.lit(None).cast(kind) for x in cs}

    def calls_as(rows: DataFrame, status: str) -> DataFrame:
        return rows.withColumnRenamed("n", "n_calls").withColumns({**none("long", "result_turn"), **none("string", "content"), **none("int", "level")}).withColumn(
            "n_results", F.lit(0).cast("long")).withColumn("status", F.lit(status)).withColumn("_call", F.lit(True))

    def results_as(rows: DataFrame, status: str) -> DataFrame:
        return rows.withColumnsRenamed({"n": "n_results", "turn": "result_turn"}).withColumns({**none("long", "turn"), **none("string", "parent_id", "name", "arguments"), **none("int", "level")}
                                       ).withColumn("n_calls", F.lit(0).cast("long")).withColumn("status", F.lit(status)).withColumn("_call", F.lit(False))

    order = linked.columns
    out = linked
    for part in (calls_as(c_more, "duplicate_call"), results_as(r_more, "duplicate_result"), calls_as(c_free, "unkeyed_call"), results_as(r_free, "unkeyed_result")):
        out = out.unionByName(part.select(*order))
    out = out.withColumn("_v", F.try_parse_json("arguments"))
    is_call = F.col("_call")
    out = out.withColumn("errors", F.when(is_call, _errors(F.col("name"), F.col("arguments"), F.col("_v"), schemas)))
    text = F.to_json(F.struct(
        F.col("_v").alias("arguments"), "call_id", "conv_id", "level", "name", F.col("content").alias("result"), "status"), {"ignoreNullFields": "false"})
    return out.select(
        "conv_id", "call_id", "turn", "result_turn", "status", "level", F.when(is_call, F.size("errors") == 0).alias("valid"),
        F.array_join("errors", ",").alias("errors"), F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), text.alias("json"))


def messages(rows: DataFrame) -> DataFrame:
    """Turns that are neither call nor result (conv_id, turn, role, text), as rows of ``link_calls`` with status 'message'."""
    text = F.to_json(F.struct(F.col("text").alias("content"), "conv_id", "role", F.lit("message").alias("status"), "turn"), {"ignoreNullFields": "false"})
    return rows.select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit(None).cast("long").alias("result_turn"), F.lit("message").alias("status"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("errors"),
        F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"), text.alias("json"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every turn of plain conversations in a row: calls with their results, and all other turns as messages."""
    calls, results = calls_of(conversations)
    other = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    return link_calls(calls, results).unionByName(messages(conversations.filter(other).select("conv_id", "turn", "role", "text")))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls of plain conversations (conv_id, turn, role, text): a user's turn calls a tool chosen by its length, the assistant's
    turn after it is the result, and a call builds on the user's turn two before."""
    name = lambda d: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + d).cast("string"))
    text = F.coalesce("text", F.lit(""))
    n = n_words(text)
    said = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    tool = F.when(n <= 12, "lookup").when(n <= 60, "answer").otherwise("summarise")
    arguments = F.when(n <= 12, F.concat(F.lit('{ "query": '), said, F.lit(" }"))).when(
        n <= 60, F.concat(F.lit('{ "words": '), n.cast("string"), F.lit(', "prompt": '), said, F.lit(" }"))).otherwise(
        F.concat(F.lit('{ "words": '), n.cast("string"), F.lit(', "prompt": '), said, F.lit(', "max_words": 60 }')))
    calls = conversations.filter("role = 'user'").select(
        "conv_id", "turn", name(0).alias("call_id"), name(-2).alias("parent_id"), tool.alias("name"), arguments.alias("arguments"))
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", name(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = r"""
with recursive t as (select conv_id, turn, role, coalesce(text, '') as x, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from conversations),
c as (select conv_id, turn, conv_id || ':' || turn as call_id, conv_id || ':' || (turn - 2) as parent_id, x, n,
      case when n <= 12 then 'lookup' when n <= 60 then 'answer' else 'summarise' end as name,
      case when n <= 12 then '{"query":' || to_json(x) || '}' when n <= 60 then '{"prompt":' || to_json(x) || ',"words":' || n || '}'
      else '{"max_words":60,"prompt":' || to_json(x) || ',"words":' || n || '}' end as arguments from t where role = 'user'),
r as (select conv_id, turn as result_turn, conv_id || ':' || (turn - 1) as call_id, text as content from t where role = 'assistant'),
l as (select conv_id, call_id, 0 as level from c where parent_id not in (select call_id from c)
      union all select c.conv_id, c.call_id, l.level + 1 from c join l on c.conv_id = l.conv_id and c.parent_id = l.call_id),
j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, turn, result_turn, level, name, arguments, content,
      case when c.call_id is null then 'orphan_result' when r.call_id is null then 'unanswered' else 'linked' end as status,
      case when c.call_id is null then null when name = 'lookup' and length(x) > 100 then 'long:query' else '' end as errors,
      c.call_id is not null as is_call, r.call_id is not null as is_result
      from c join l using (conv_id, call_id) full join r using (conv_id, call_id))
select conv_id, call_id, turn, result_turn, status, level, case when is_call then errors = '' end as valid, errors,
  cast(is_call as bigint) as n_calls, cast(is_result as bigint) as n_results,
  '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":' || to_json(call_id) || ',"conv_id":' || conv_id || ',"level":' || coalesce(cast(level as varchar), 'null')
  || ',"name":' || coalesce(to_json(name), 'null') || ',"result":' || coalesce(to_json(content), 'null') || ',"status":' || to_json(status) || '}' as json
from j
union all
select conv_id, null, turn, null, 'message', null, null, null, 0, 0, '{"content":' || coalesce(to_json(text), 'null') || ',"conv_id":' || coalesce(cast(conv_id as varchar), 'null')
  || ',"role":' || coalesce(to_json(role), 'null') || ',"status":"message","turn":' || coalesce(cast(turn as varchar), 'null') || '}'
from conversations where role is null or role not in ('user', 'assistant')
"""


@query("op9_tool_calls", SQL)
def op9_tool_calls(spark, sf_dir):
    return format_conversations(table(spark, sf_dir, "conversations"))
