"""Chat formatting: linking tool calls with their results (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import cut, discard


def canonical(json: Column) -> Column:
    """Canonical JSON of a JSON text: members sorted by key, no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def order_labels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological labels: (conv, id, label), ``label`` being (wave, depth) and greater than those of the calls it waits for.

    ``calls``: (conv, id, pos), one row for each id; ``edges``: (conv, id, after). A label starts as (position, 0); where a call waits
    for one that is not before it, it takes that one's wave and a depth greater by one, until nothing changes. The number of rounds is the
    longest run of calls against the order of the conversation, not its length. A depth that passes the number of calls of the
    conversation is on a cycle, and its label becomes null; calls that wait for one keep their own place. A cycle of n calls takes n rounds.
    Only calls raised in the round before can raise others, so a round reads the edges from those alone.
    """
    spark = calls.sparkSession
    size = calls.groupBy("conv").agg(F.count(F.lit(1)).alias("_size"))
    start = F.struct(F.col("pos").cast("long").alias("wave"), F.lit(0).cast("long").alias("depth"))
    labels = cut(calls.join(size, "conv").select("conv", "id", "_size", start.alias("label"), F.lit(True).alias("_up")))
    edges = cut(edges.join(calls.select("conv", F.col("id").alias("after")), ["conv", "after"], "left_semi").distinct())
    known = bool(edges.take(1))
    while known:
        after = labels.where("_up").select("conv", F.col("id").alias("after"), F.struct(F.col("label.wave"), (F.col("label.depth") + 1).alias("depth")).alias("next"))
        want = edges.join(after, ["conv", "after"]).groupBy("conv", "id").agg(F.max("next").alias("want"))
        up = F.coalesce(F.col("want") > F.col("label"), F.lit(False)) & (F.col("label.depth") <= F.col("_size"))
        raised = cut(labels.drop("_up").join(want, ["conv", "id"], "left")
                     .select("conv", "id", "_size", F.when(up, F.col("want")).otherwise(F.col("label")).alias("label"), up.alias("_up")))
        discard(spark, labels)
        labels = raised
        known = bool(labels.where("_up").take(1))
    return labels.select("conv", "id", F.when(F.col("label.depth") <= F.col("_size"), F.col("label")).alias("label"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tool calls with their results, in topological order, checked and serialised.

    ``calls``: (conv, id, pos, name, arguments, after): the arguments as a JSON text, ``after`` an array of the ids that must come
    first (null: none). ``results``: (conv, id, content). ``schemas``: (tool, argument, kind, required), ``kind`` being the
    JSON kind as Spark names it: BIGINT, DOUBLE, STRING, BOOLEAN, ARRAY, OBJECT (a whole number passes as DOUBLE).

    Returns (conv, id, name, wave, depth, status, result, canonical). Sorting a conversation by (wave, depth, id) puts
    every call behind what it waits for; both are null on a cycle. ``status`` is the first that holds of: ``no tool``,
    ``not json``, ``missing <argument>``, ``unknown <argument>``, ``wrong <argument>`` (the first such argument by name), ``cycle``, ``no
    result``, ``ok``. ``canonical`` is the call and its result as canonical JSON, null where the arguments are no JSON object.

    Calls and results are joined by hash on (conv, id). A call id that comes several times in a conversation is the call
    with the smallest position (then name, then arguments); of several results the smallest content counts; ids that a
    call waits for but that nothing defines are left out. Calls with a null conv or id are dropped: nothing can name them. Further
    columns of the three tables are left out, whatever their names. Arguments and contents may be of any length; empty ones are no JSON and
    an empty result. Equal rows count once. Without calls the result is empty; without schemas every call has ``no tool``.
    """
    calls = calls.select("conv", "id", "pos", "name", "arguments", "after")
    results = results.select("conv", "id", "content")
    schemas = schemas.select("tool", "argument", "kind", "required")
    named = calls.where("conv IS NOT NULL AND id IS NOT NULL")
    w = Window.partitionBy("conv", "id").orderBy("pos", "name", "arguments")
    one = cut(named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
    edges = one.select("conv", "id", F.explode("after").alias("after"))
    labels = order_labels(one.select("conv", "id", F.coalesce("pos", F.lit(0)).alias("pos")), edges)
    answer = results.groupBy("conv", "id").agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("_answers"))

    # one row for each tool: its arguments as a map; schemas are written by hand, so this side is short
    tools = schemas.groupBy("tool").agg(
        F.map_from_entries(F.collect_list(F.struct("argument", F.struct("kind", "required")))).alias("_spec"))
    variant = F.try_parse_json("arguments")
    d = one.join(tools, one["name"] == tools["tool"], "left").withColumn("_v", variant)
    d = d.withColumn("_args", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.from_json("arguments", "map<string,variant>")))
    given, spec = F.map_keys("_args"), F.col("_spec")
    needed = F.map_keys(F.map_filter(spec, lambda k, v: v["required"]))
    missing = F.array_sort(F.array_except(needed, given))
    unknown = F.array_sort(F.array_except(given, F.map_keys(spec)))
    kinds = F.transform_values("_args", lambda k, v: F.regexp_replace(F.schema_of_variant(v), "[<(].*", ""))
    fits = lambda k, v: (spec[k]["kind"] == v) | ((spec[k]["kind"] == "DOUBLE") & v.isin("BIGINT", "DECIMAL"))
    wrong = F.array_sort(F.map_keys(F.map_filter(kinds, lambda k, v: ~fits(k, v))))
    d = d.withColumns({"_missing": missing, "_unknown": unknown}).withColumn("_wrong", wrong)
    first = lambda c: F.element_at(c, 1)
    error = (F.when(F.col("_spec").isNull(), F.lit("no tool")).when(F.col("_args").isNull(), F.lit("not json"))
             .when(F.size("_missing") > 0, F.concat(F.lit("missing "), first("_missing")))
             .when(F.size("_unknown") > 0, F.concat(F.lit("unknown "), first("_unknown")))
             .when(F.size("_wrong") > 0, F.concat(F.lit("wrong "), first("_wrong"))))
    d = d.withColumn("_error", error)
    d = d.join(labels, ["conv", "id"]).join(answer, ["conv", "id"], "left")
    status = (F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("label").isNull(), F.lit("cycle"))
              .when(F.col("_answers").isNull(), F.lit("no result")).otherwise(F.lit("ok")))
    # members in the order of their keys; the arguments are put in as the canonical text they are
    text = F.concat(F.lit('{"arguments":'), F.to_json("_v"), F.lit(',"call":'), _quoted(F.col("id").cast("string")),
                    F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"result":'), F.coalesce(_quoted(F.col("result")), F.lit("null")), F.lit("}"))
    return d.select("conv", "id", "name", F.col("label.wave").alias("wave"), F.col("label.depth").alias("depth"), status.alias("status"), "result",
                    F.when(F.col("_args").isNotNull(), text).alias("canonical"))


def _quoted(c: Column) -> Column:
    """A JSON string; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1))


# the tools of the derived calls, fixed values
TOOLS = [("search", "text", "STRING", True), ("search", "limit", "BIGINT", True), ("search", "turn", "BIGINT", False),
         ("reply", "text", "STRING", True), ("reply", "turn", "BIGINT", True), ("reply", "limit", "BIGINT", False),
         ("count", "limit", "BIGINT", True), ("count", "turn", "BIGINT", True)]


def tool_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, "tool string, argument string, kind string, required boolean")


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off plain conversations, which have no tool turns: a rule that gives every case.

    Each assistant turn is a call with its turn as position and id. The tool is search, reply or count by ``turn`` div 2
    mod 3; the arguments are the text, the turn and a limit (the text's length mod 10, written as a string where that is 7). The
    result of a call is the user's text of the next turn. A call waits for the assistant turn two before it; but where
    the length of its text is 3 mod 16 and an assistant turn follows two later, it waits for that one instead, which
    then does not wait for it.
    """
    c = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    calls = c.where("role = 'assistant' AND conv IS NOT NULL AND turn IS NOT NULL").groupBy("conv", "turn").agg(F.min("text").alias("text"))
    text = F.coalesce("text", F.lit(""))
    third = (F.char_length(text) % 16 == 3).alias("third")
    behind = calls.select("conv", (F.col("turn") - 2).alias("turn"), F.lit(True).alias("next"))
    ahead = calls.select("conv", (F.col("turn") + 2).alias("turn"), third.alias("before"))
    calls = calls.join(behind, ["conv", "turn"], "left").join(ahead, ["conv", "turn"], "left")
    # the call before has this one behind it, so it is turned where its text says so
    after = (F.when(third & F.col("next").isNotNull(), F.array(F.col("turn") + 2))
             .when(~F.col("before"), F.array(F.col("turn") - 2)))
    length = F.char_length(text) % 10
    limit = F.when(length == 7, F.concat(F.lit('"'), length.cast("string"), F.lit('"'))).otherwise(length.cast("string"))
    arguments = F.concat(F.lit('{"text":'), F.coalesce(_quoted(F.col("text")), F.lit("null")), F.lit(', "turn":'), F.col("turn").cast("string"),
                         F.lit(', "limit":'), limit, F.lit("}"))
    name = F.element_at(F.array(F.lit("search"), F.lit("reply"), F.lit("count")), (F.expr("turn div 2") % 3 + 1).cast("int"))
    calls = calls.select("conv", F.col("turn").alias("id"), F.col("turn").alias("pos"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = c.where("role = 'user' AND turn > 0").select("conv", (F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    return calls, results


SQL = r"""
WITH a AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn),
b AS (SELECT *, length(text) % 16 = 3 AND EXISTS (SELECT 1 FROM a x WHERE x.conv_id = a.conv_id AND x.turn = a.turn + 2) AS turned FROM a),
e AS (SELECT *, min(CASE WHEN NOT turned THEN turn END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wave FROM b),
u AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY conv_id, turn),
j AS (SELECT e.*, u.result, u.turn IS NOT NULL AS answered, ['search', 'reply', 'count'][turn // 2 % 3 + 1] AS name,
             length(text) % 10 AS l FROM e LEFT JOIN u USING (conv_id, turn))
SELECT conv_id AS conv, turn AS id, name, wave, (wave - turn) // 2 AS depth,
       CASE WHEN name = 'count' THEN 'unknown text' WHEN l = 7 THEN 'wrong limit' WHEN NOT answered THEN 'no result' ELSE 'ok' END AS status,
       result, '{"arguments":{"limit":' || CASE WHEN l = 7 THEN '"7"' ELSE l::VARCHAR END || ',"text":' || to_json(text)::VARCHAR || ',"turn":' || turn
       || '},"call":"' || turn || '","name":"' || name || '","result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS canonical
FROM j
"""
