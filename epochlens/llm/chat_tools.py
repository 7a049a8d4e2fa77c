"""Tool-call linking for chat data, with DataFrame functions only.

Calls and their results are hash-joined by conversation and identifier (identifiers such as call_1 come again in every conversation). Calls are put into topological levels: a call's level is the
length of the longest way to it from a call that comes after none. Every round puts known levels into those that come after them, and lets calls that still wait for one other call alone look past it,
so that a chain of n calls takes log2(n) rounds; only calls that wait for several unknown ones take a round each. Arguments are parsed and held against the tools' schemas, and each call is
serialised as canonical JSON: keys in order, no white space, absent members left out.

Defined results: of several results of one call the first by turn and then content counts; a result without a call in its conversation is an ``orphan`` row, a call without a result ``unanswered``; a null identifier links to nothing;
rows without a conversation are one conversation; repeated calls each give a row and come after all that any of them does; a predecessor that doesn't exist in the conversation, or that the call itself is, counts as none; calls in a circle,
and calls after these, have a null level and status ``cycle``; arguments that are no JSON object are invalid (``arguments``) and serialised as null; an unknown tool is invalid (``tool``); empty tables give no rows;
of further columns none is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.llm.common import materialised, table

#: tool: {field: (JSON type, required, greatest value or None)}
Schemas = dict[str, dict[str, tuple[str, bool, int | None]]]
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE"]}


def _conversation(conv_id: str) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("none"))


def levels(calls: DataFrame) -> DataFrame:
    """calls (c, call_id, after: array) to c, call_id, level: null for calls in a circle or after one.

    An edge (v, u, s) says that v's level is that of u plus s at least, least says the same of a number. Edges go once u is known, or turn to what u waits for if that is one call.
    A way longer than its conversation has calls runs in a circle.
    """
    known = calls.where("call_id is not null").groupBy("c", "call_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("after", F.array().cast("array<string>"))))).alias("after"))
    sizes = known.groupBy("c").agg(F.count("*").alias("n"))
    edges = known.select("c", F.col("call_id").alias("v"), F.explode("after").alias("u")).where("u <> v")
    edges = edges.join(known.select("c", F.col("call_id").alias("u")), ["c", "u"], "left_semi").select("c", "v", "u", F.lit(1).cast("long").alias("s")).join(sizes, "c")
    nodes = known.select("c", F.col("call_id").alias("v"), F.lit(0).cast("long").alias("least"), F.lit(False).alias("circle"))
    edges = materialised(edges, "edges")
    nodes, done = _parted(nodes, edges)
    out = [done]
    while edges.limit(1).count():
        waits = edges.groupBy("c", "v").agg(F.count("*").alias("open"), F.first("u").alias("to"), F.first("s").alias("more"))
        ups = nodes.join(waits, ["c", "v"], "left").select("c", F.col("v").alias("u"), F.col("least").alias("u_least"), F.col("circle").alias("u_circle"), F.coalesce("open", F.lit(0)).alias("open"), "to", "more")
        met = materialised(edges.join(ups, ["c", "u"]), "met")
        # what u says of v's level whatever u waits for, and whether v is in a circle or after one
        told = met.groupBy("c", "v").agg(F.max(F.when(F.col("open") <= 1, F.col("u_least") + F.col("s"))).alias("told"), F.max(F.col("u_circle") | (F.col("s") > F.col("n"))).alias("bad"))
        new = nodes.join(told, ["c", "v"], "left").select("c", "v", F.greatest("least", F.coalesce("told", F.lit(0))).alias("least"), (F.col("circle") | F.coalesce("bad", F.lit(False))).alias("circle"))
        open_ = met.where((F.col("open") > 0) & ~F.col("u_circle") & (F.col("s") <= F.col("n")))
        jumped = open_.select("c", "v", F.when(F.col("open") == 1, F.col("to")).otherwise(F.col("u")).alias("u"), (F.col("s") + F.when(F.col("open") == 1, F.col("more")).otherwise(0)).alias("s"), "n")
        left = jumped.groupBy("c", "v", "u").agg(F.max("s").alias("s"), F.first("n").alias("n")).join(new.where("not circle").select("c", "v"), ["c", "v"], "left_semi").select("c", "v", "u", "s", "n")
        left = materialised(left, "edges")
        if not met.where("open <= 1 or u_circle or s > n").limit(1).count():  # nothing has moved: all that is left waits in circles
            stuck = left.select("c", "v").distinct().withColumn("_stuck", F.lit(True))
            new = new.join(stuck, ["c", "v"], "left").select("c", "v", "least", (F.col("circle") | F.coalesce("_stuck", F.lit(False))).alias("circle"))
            left = left.limit(0)
        nodes, done = _parted(new, left)
        edges = left
        out.append(done)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("c", F.col("v").alias("call_id"), F.when(~F.col("circle"), F.col("least")).cast("int").alias("level"))


def _parted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that edges speak of, and the others, which are settled and take no part in further rounds."""
    named = edges.select("c", "v").unionByName(edges.select("c", F.col("u").alias("v"))).distinct().withColumn("_named", F.lit(True))
    marked = materialised(nodes.join(named, ["c", "v"], "left"), "nodes")
    return marked.where("_named").drop("_named"), marked.where("_named is null").drop("_named")


def argument_errors(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Sorted texts of what is wrong with a call's arguments."""
    kind = F.schema_of_variant(parsed)
    per_tool = F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.array(F.lit("tool")))
    per_tool = per_tool.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("arguments")))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (json_type, required, most) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            have = F.schema_of_variant(value)
            absent = value.isNull() | (have == "VOID")
            right = have.isin(_TYPES[json_type]) | (have.startswith("DECIMAL") if json_type == "number" else F.lit(False))
            found.append(F.when(absent, F.lit(f"{field}: missing") if required else F.lit(None)).when(~right, F.lit(f"{field}: not {json_type}")))
            if most is not None:
                found.append(F.when(right & (F.try_variant_get(parsed, f"$['{field}']", "bigint") > most), F.lit(f"{field}: over {most}")))
        per_tool = per_tool.when(name == tool, F.array_compact(F.array(*found)))
    return per_tool


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row for each call, and for each result without one.

    calls: conv_id, call_id, after (an identifier, or an array of them), turn, name, arguments (JSON text). results: conv_id, call_id, turn, content.
    Gives conv_id, call_id, turn, level, status, valid, errors, canonical; (conv_id, level, turn) is a topological order.
    """
    after = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.when(F.col("after").isNotNull(), F.array("after"))
    calls = calls.select("conv_id", "call_id", after.alias("after"), "turn", "name", "arguments", _conversation("conv_id").alias("c"))
    results = results.select("conv_id", "call_id", "turn", "content", _conversation("conv_id").alias("c"))
    answered = results.where("call_id is not null").groupBy("c", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    on = ["c", "call_id"]
    named = calls.where("call_id is not null").join(levels(calls).hint("shuffle_hash"), on, "left").join(answered.hint("shuffle_hash"), on, "left")
    # calls without an identifier have nothing to look up, and would all meet in one task
    nameless = calls.where("call_id is null").withColumn("level", F.lit(None).cast("int")).withColumn("r", F.lit(None).cast(answered.schema["r"].dataType))
    placed = named.unionByName(nameless)
    parsed = F.try_parse_json("arguments")
    rows = placed.withColumn("parsed", parsed).withColumn("errors", argument_errors(F.col("name"), F.col("parsed"), schemas))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    canonical = F.concat(
        F.lit('{"arguments":'), F.when(is_object, F.to_json("parsed")).otherwise(F.lit("null")),
        F.coalesce(F.concat(F.lit(',"id":'), _json(F.col("call_id"))), F.lit("")), F.coalesce(F.concat(F.lit(',"name":'), _json(F.col("name"))), F.lit("")),
        F.coalesce(F.concat(F.lit(',"result":'), _json(F.col("r.content"))), F.lit("")), F.lit("}"),
    )
    status = F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), "cycle").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    linked = rows.select("conv_id", "call_id", "turn", "level", status.alias("status"), (F.size("errors") == 0).alias("valid"), F.array_join(F.array_sort("errors"), "; ").alias("errors"), canonical.alias("canonical"))
    lone = results.where("call_id is not null").join(calls.select(*on).distinct(), on, "left_anti").unionByName(results.where("call_id is null"))
    orphans = lone.select("conv_id", "call_id", "turn", F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"), F.lit(False).alias("valid"), F.lit("call").alias("errors"), F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"id":'), _json(F.col("call_id")), F.lit(",")), F.lit("")), F.lit('"result":'), F.coalesce(_json(F.col("content")), F.lit("null")), F.lit("}")).alias("canonical"))
    return linked.unionByName(orphans)


def _json(text: Column) -> Column:
    """A JSON string; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def in_order(linked: DataFrame) -> DataFrame:
    """With the place of each row among those of its conversation and level, which tells ties apart."""
    return linked.withColumn("place", F.row_number().over(W.partitionBy("conv_id", "level").orderBy("turn", "call_id", "canonical")))


#: The tool that an assistant's turn is taken for.
REPLY: Schemas = {"reply": {"text": ("string", True, None), "chars": ("integer", True, 300), "turn": ("integer", True, None)}}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation's user turns as calls of ``reply``, each after the user turn two before (some also after that four before), and its assistant turns as their results. Identifiers come again in every conversation."""
    key = lambda turn: F.concat(F.lit("call_"), turn)
    user = messages.where("role = 'user'")
    arguments = F.to_json(F.struct("turn", "text", F.length("text").alias("chars")))
    turn = F.col("turn")
    calls = user.select("conv_id", key(turn).alias("call_id"), F.array_compact(F.array(F.when(turn >= 2, key(turn - 2)), F.when(turn % 6 == 4, key(turn - 4)))).alias("after"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = messages.where("role = 'assistant'").select("conv_id", key(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op6_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return in_order(link_tool_calls(calls, results, REPLY))


OP6_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 'call_' || turn AS call_id FROM conversations WHERE role = 'user'
), edges AS (
  SELECT DISTINCT c.conv_id, c.turn AS v, u.turn AS u FROM calls c JOIN calls u ON u.conv_id = c.conv_id AND (u.turn = c.turn - 2 OR c.turn % 6 = 4 AND u.turn = c.turn - 4)
), ways AS (
  SELECT DISTINCT conv_id, turn AS v, 0 AS level FROM calls
  UNION
  SELECT e.conv_id, e.v, w.level + 1 FROM edges e JOIN ways w ON w.conv_id = e.conv_id AND w.v = e.u
), walk AS (SELECT conv_id, v, max(level) AS level FROM ways GROUP BY ALL),
results AS (
  SELECT conv_id, turn, text, 'call_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), answered AS (
  SELECT conv_id, call_id, arg_min(text, (turn, text)) AS content, true AS have FROM results GROUP BY ALL
), linked AS (
  SELECT c.conv_id, c.call_id, c.turn, w.level,
    CASE WHEN a.have THEN 'linked' ELSE 'unanswered' END AS status,
    length(c.text) <= 300 AS valid,
    CASE WHEN length(c.text) > 300 THEN 'chars: over 300' ELSE '' END AS errors,
    '{"arguments":' || json_object('chars', length(c.text), 'text', c.text, 'turn', c.turn)::VARCHAR
      || ',"id":' || to_json(c.call_id)::VARCHAR || ',"name":"reply"'
      || coalesce(',"result":' || to_json(a.content)::VARCHAR, '') || '}' AS canonical
  FROM calls c LEFT JOIN walk w ON w.conv_id = c.conv_id AND w.v = c.turn LEFT JOIN answered a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
  UNION ALL
  SELECT conv_id, call_id, turn, NULL, 'orphan', false, 'call', '{"id":' || to_json(call_id)::VARCHAR || ',"result":' || to_json(text)::VARCHAR || '}'
  FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
)
SELECT *, row_number() OVER (PARTITION BY conv_id, level ORDER BY turn, call_id, canonical) AS place FROM linked
"""
