"""Tool calls of chats: linked to their results, ordered, validated and serialised, by Spark expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.common import materialize

#: JSON types of schemas and the names that Spark gives values of a variant.
KINDS = {"integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": r"^STRING$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY.*$", "object": r"^OBJECT.*$"}


@dataclass(frozen=True)
class Parameter:
    kind: str
    required: bool = True
    least: float | None = None
    choices: tuple[str, ...] = ()


#: By tool and parameter: a short list, held in the plan.
Schemas = dict[str, dict[str, Parameter]]


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted texts of what is wrong with the arguments (JSON text) of a call of the tool.

    Arguments that repeat a key, or are beyond the size of a variant, can't be read; their values aren't checked.
    """
    value = F.try_parse_json(arguments)
    given = F.json_object_keys(arguments)
    readable = given.isNotNull() & value.isNotNull()
    keys = F.coalesce(given, F.array().cast("array<string>"))
    found: list[Column] = [F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.array(F.lit("unknown tool"))), F.when(given.isNull(), F.array(F.lit("arguments are no JSON object"))), F.when(given.isNotNull() & value.isNull(), F.array(F.lit("arguments repeat a key or are too long")))]
    for tool, parameters in schemas.items():
        each: list[Column] = []
        for key, p in parameters.items():
            kind = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
            missing = F.lit(f"{key}: missing") if p.required else F.lit(None).cast("string")
            check = F.when(~F.array_contains(keys, key), missing).when(~kind.rlike(KINDS[p.kind]), F.lit(f"{key}: not of type {p.kind}"))
            if p.least is not None:
                check = check.when(F.try_variant_get(value, f"$.{key}", "double") < p.least, F.lit(f"{key}: less than {p.least:g}"))
            if p.choices:
                check = check.when(~F.try_variant_get(value, f"$.{key}", "string").isin(list(p.choices)), F.lit(f"{key}: not a choice"))
            each.append(check)
        other = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in parameters]).cast("array<string>")), lambda k: F.concat(k, F.lit(": unexpected")))
        found.append(F.when((name == tool) & readable, F.concat(F.array_compact(F.array(*each)), other)))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in found])))


#: Calls of a conversation that is read in one go.
FOLD = 4096
#: What identifies a call.
CALL = ["conv_id", "call_id"]


def links_of(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (node, turn) and links (child, parent) between them; a node is a struct of conversation and identifier.

    Identifiers that no call of the conversation has are no links. Of a call that uses its latest predecessor and calls which that one
    uses too, the latter links are left out: they change no longest path.
    """
    node = F.struct(*CALL)
    nodes = materialize(calls.where("conv_id is not null and call_id is not null").groupBy(node.alias("node")).agg(F.min("turn").alias("turn")))
    links = calls.where("conv_id is not null and call_id is not null").select(node.alias("child"), F.explode("after").alias("_p")).select("child", F.struct(F.col("child.conv_id").alias("conv_id"), F.col("_p").alias("call_id")).alias("parent")).distinct()
    links = materialize(links.join(nodes.select(F.col("node").alias("parent"), F.col("turn").alias("_turn")), "parent"))
    latest = links.where("child != parent").groupBy("child").agg(F.max_by("parent", F.struct("_turn", "parent")).alias("parent"))
    through = latest.join(links.select(F.col("child").alias("parent"), F.col("parent").alias("_far")), "parent").where("_far != parent and _far != child").select("child", F.col("_far").alias("parent")).distinct()
    return nodes, materialize(links.select("child", "parent").join(through, ["child", "parent"], "left_anti"))


def folded(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and level of the calls of conversations which have FOLD calls at most, and in which calls wait for earlier ones only.

    Such a conversation is read once, in the order of turn and identifier: a call's level is one more than the highest of those it waits for, which come before it.
    """
    short = nodes.groupBy(F.col("node.conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= FOLD)
    placed = nodes.withColumn("conv_id", F.col("node.conv_id")).join(short, "conv_id", "left_semi")
    placed = materialize(placed.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "node"))).select("conv_id", "node", "place"))
    at = lambda x: placed.select(F.col("node").alias(x), F.col("place").alias(f"_{x}"))
    waits = links.join(at("child"), "child").join(at("parent"), "parent").groupBy("child").agg(F.collect_list("_parent").alias("_after"), F.max(F.col("_parent") >= F.col("_child")).alias("_back"))
    rows = placed.join(waits, F.col("node") == F.col("child"), "left")
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "node", F.coalesce("_after", F.array().cast("array<int>")).alias("after")))).alias("_calls"), F.max(F.coalesce("_back", F.lit(False))).alias("_back"))
    found = F.aggregate("_calls", F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.array_max(F.transform(x["after"], lambda p: F.get(acc, p - 1))) + 1, F.lit(0)))))
    out = each.where("not _back").select(F.explode(F.arrays_zip(F.transform("_calls", lambda x: x["node"]).alias("node"), found.alias("level"))).alias("_x"))
    return materialize(out.select(F.col("_x.node").alias("node"), F.col("_x.level").cast("long").alias("level")))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level: 0 for a call that waits for none, else one more than the calls (column after) it waits for; null for those in or behind a circle.

    A conversation of up to FOLD calls, each of which waits for earlier ones, is read once in their order. In others,
    calls that wait for one call only are chains, and a chain of any length is followed by doubling its steps: its
    calls know the end of the chain and how far it is. What is left are calls that wait for several; each round settles
    those that wait for nothing unsettled.
    """
    nodes, links = links_of(calls)
    done = folded(nodes, links)
    if done.isEmpty():
        return by_rounds(nodes, links)
    convs = done.select(F.col("node.conv_id").alias("_conv")).distinct()
    rest = materialize(nodes.join(convs, F.col("node.conv_id") == F.col("_conv"), "left_anti"))
    told = done.select("node.*", F.col("level").cast("int").alias("level"))
    if rest.isEmpty():
        return told
    return told.unionByName(by_rounds(rest, materialize(links.join(convs, F.col("child.conv_id") == F.col("_conv"), "left_anti"))))


def by_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """As levels, of calls and links between them."""
    waits = links.groupBy("child").agg(F.count(F.lit(1)).alias("_k"), F.min("parent").alias("_one"))
    chained = F.coalesce((F.col("_k") == 1) & (F.col("_one") != F.col("node")), F.lit(False))
    jumps = nodes.select("node").join(waits, F.col("node") == F.col("child"), "left").select("node", F.when(chained, F.col("_one")).otherwise(F.col("node")).alias("to"), chained.cast("long").alias("far"), F.coalesce("_k", F.lit(0).cast("long")).alias("k"))
    jumps = materialize(jumps)
    ends = jumps.where("far = 0").select(F.col("node").alias("to"))
    reach, open_ = jumps.select("node", "to", "far"), jumps.where("far > 0").select("node", "to", "far")
    while True:  # each round doubles how far the open ones reach; the others stay at the end of their chain
        settled = open_.join(ends, "to", "left_semi").select("node")
        left = open_.join(ends, "to", "left_anti")
        if settled.isEmpty() or left.isEmpty():  # circles are left, or nothing
            break
        ahead = reach.where("far > 0").select(F.col("node").alias("to"), F.col("to").alias("_next"), F.col("far").alias("_more"))
        open_ = materialize(left.join(ahead, "to").select("node", F.col("_next").alias("to"), (F.col("far") + F.col("_more")).alias("far")))
        reach = materialize(reach.join(open_.select("node"), "node", "left_anti").union(open_))

    known = materialize(jumps.where("k = 0").select(F.col("node").alias("to"), F.lit(0).cast("long").alias("level")))
    step = links.join(jumps.where("k > 0 and far = 0").select(F.col("node").alias("child")), "child", "left_semi")  # of calls that wait for several
    step = materialize(step.join(reach.select(F.col("node").alias("parent"), "to", "far"), "parent", "left").select("child", "to", (F.col("far") + 1).alias("far")))
    while not step.isEmpty():
        tried = step.join(known, "to", "left").groupBy("child").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("_open"))
        new = materialize(tried.where("_open = 0").select(F.col("child").alias("to"), "level"))
        if new.isEmpty():
            break
        step = materialize(step.join(new.select(F.col("to").alias("child")), "child", "left_anti"))
        known = materialize(known.union(new))
    return nodes.select("node").join(reach, "node", "left").join(known, "to", "left").select("node.*", (F.col("level") + F.col("far")).cast("int").alias("level"))


def canonical_number(x: Column) -> Column:
    """A JSON number without needless zeros: 1.0 and 1e0 are 1, 1e2 is 100. What has no exponent keeps all its digits; with an exponent it is a double, written plainly where that is exact."""
    plain = F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.when(plain == "-0", "0").otherwise(plain)
    value = x.try_cast("double")
    wide = value.try_cast("decimal(38,18)").cast("string")
    wide = F.regexp_replace(F.regexp_replace(wide, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(F.lower(x), r"(\.[0-9]*?)0+e", "$1e"), r"\.e", "e")
    return F.when(~x.rlike("[eE]"), plain).when(F.coalesce(wide.try_cast("double") == value, F.lit(False)), F.when(wide == "-0", "0").otherwise(wide)).otherwise(short)


def canonical(json: Column) -> Column:
    """JSON text as to_json writes it (sorted keys, no white space) with canonical numbers. Strings stay as they are: escapes are set aside, and of the parts between quotes every other one is a string."""
    safe = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))

    def outside(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit(r"-?[0-9][0-9.eE+-]*|[^0-9-]+"), F.lit(0))
        return F.when(part.rlike(r"[.eE]|-0"), F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), canonical_number(t)).otherwise(t)), "")).otherwise(part)

    parts = F.transform(F.split(safe, '"'), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Each call with its result, its place in the order, its problems and its canonical JSON.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (identifiers of calls of the same conversation whose results it
    uses). results: conv_id, call_id, turn, content. A call is linked to the result of its conversation with its
    identifier, by a hash join, of several to the earliest (then the smallest content); n_results tells
    how many there are. Sorting a conversation by level, turn and call_id gives an order in which each
    call comes after those it uses.

    json has its keys sorted at every depth, no white space, and numbers without needless zeros or exponents (of up to 38 digits exactly; longer ones
    are doubles); a call without name or result has no
    key for it, a null within the arguments stays as null, and arguments that can't be read as JSON (see problems) stand as text. Calls without a conversation or an identifier have level
    0 and no result; repeated rows stay. Extra columns are neither read nor returned. Empty tables give no rows.
    """
    first = results.where("conv_id is not null and call_id is not null").groupBy(*CALL).agg(F.min(F.struct("turn", "content")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    rows = calls.join(first.hint("shuffle_hash"), CALL, "left").join(levels(calls), CALL, "left")
    found = problems(F.col("name"), F.col("arguments"), schemas)
    value = F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("text"))))
    rows = rows.select(
        "conv_id",
        "turn",
        "call_id",
        "name",
        F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0).otherwise(F.col("level")).alias("level"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_results"),
        F.col("_r.turn").alias("result_turn"),
        F.array_join(found, "; ").alias("problems"),
        canonical(F.to_json(F.struct(value.alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("_r.content").alias("result")))).alias("json"),
    )
    return rows.withColumn("valid", F.col("problems") == "")


#: Schemas of the calls that the query derives from conversations.
DERIVED: Schemas = {
    "search": {"query": Parameter("string"), "limit": Parameter("integer", True, 1)},
    "count": {"text": Parameter("string"), "unit": Parameter("string", False, None, ("word", "line"))},
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from turns: each assistant's turn is a call with its whole text as an argument, each later user's turn the result of the turn before it.

    A call uses the results of the assistant's turn before and of the calls half and a third as far into the conversation. Some have a limit of 0, a unit that is no
    choice, a missing or an unexpected argument, by their length.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = F.when(F.col("turn") % 4 == 1, "search").otherwise("count")

    def key(turn: Column) -> Column:
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))

    n = F.char_length("text")
    search = F.to_json(F.struct(F.when(n % 7 != 0, F.col("text")).alias("query"), (n % 5).alias("limit")))
    count = F.to_json(F.struct(F.col("text"), F.when(n % 3 == 0, "word").when(n % 3 == 1, "page").alias("unit"), F.when(n % 11 == 0, True).alias("deep")))
    earlier = F.array_distinct(F.array(key(F.floor(F.col("turn") / 2)), key(F.floor(F.col("turn") / 3)), key(F.col("turn") - 2)))
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", key(F.col("turn")).alias("call_id"), name.alias("name"), F.when(name == "search", search).otherwise(count).alias("arguments"), F.filter(earlier, lambda k: k != key(F.col("turn"))).alias("after"))
    results = turns.where("role = 'user'").select("conv_id", key(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


ORACLE = """
with recursive t as (
  select conv_id, turn, role, coalesce(text, '') as text, length(coalesce(text, '')) as n from conversations
), c as (
  select conv_id, turn, 'call_' || conv_id || '_' || turn as call_id, case when turn % 4 = 1 then 'search' else 'count' end as name, text, n from t where role = 'assistant'
), l as (
  select distinct x.call_id as child, y.call_id as parent from c x join c y on x.conv_id = y.conv_id and (y.turn = x.turn // 2 or y.turn = x.turn // 3 or y.turn = x.turn - 2) and y.turn <> x.turn
), p(call_id, level) as (
  select call_id, 0 from c union select l.child, p.level + 1 from p join l on l.parent = p.call_id
), v as (
  select call_id, max(level) as level from p group by call_id
), r as (
  select 'call_' || conv_id || '_' || (turn - 1) as call_id, count(*) as n, min({'turn': turn, 'content': text}) as first from t where role = 'user' group by 1
), a as (
  select c.*, v.level, coalesce(r.n, 0) as n_results, r.first.turn as result_turn, r.first.content as content,
    case when name = 'search' then '{"limit":' || (c.n % 5) || case when c.n % 7 <> 0 then ',"query":' || to_json(text) else '' end || '}'
         else '{' || case when c.n % 11 = 0 then '"deep":true,' else '' end || '"text":' || to_json(text) || case c.n % 3 when 0 then ',"unit":"word"' when 1 then ',"unit":"page"' else '' end || '}' end as arguments,
    array_to_string(list_filter(case when name = 'search' then [case when c.n % 5 < 1 then 'limit: less than 1' end, case when c.n % 7 = 0 then 'query: missing' end]
         else [case when c.n % 11 = 0 then 'deep: unexpected' end, case when c.n % 3 = 1 then 'unit: not a choice' end] end, lambda x: x is not null), '; ') as problems
  from c left join v using (call_id) left join r using (call_id)
)
select conv_id, turn, call_id, name, level, n_results::bigint as n_results, result_turn, problems,
       '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '"' || case when content is not null then ',"result":' || to_json(content) else '' end || '}' as json,
       problems = '' as valid
from a
"""
