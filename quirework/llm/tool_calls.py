"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Everything is DataFrame operations. Calls and results meet in a hash join on conversation and
identifier. Arguments are parsed as variants, held against the tool's schema, and written as
canonical JSON: keys sorted, no blanks, numbers in their shortest form, nothing for absent values.

Order. Where every call depends on earlier calls only, the order of appearance is topological and is
kept (level 0 throughout). A conversation in which some call depends on a later one is ordered by
level, the length of the longest chain of dependencies below a call, then by appearance. Calls on a
cycle, or above one, have no level and say so. Levels are found in rounds over those conversations
alone; there are as many rounds as the longest chain there has links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirework.llm.registry import query, read

KEY = ["conv_id", "call_id"]
# The types a schema may ask for, and the variant types that satisfy each.
TYPES = {
    "string": "^STRING$", "boolean": "^BOOLEAN$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "array": "^ARRAY<", "object": "^OBJECT<",
}


def first_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, position): where each identifier is first used; null keys are left out."""
    return calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(F.min("position").alias("position"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cycle) of the calls in conversations with a backward reference.

    Unknown dependencies do not count here.
    """
    known = first_calls(calls)
    edges = (
        calls.join(known, [*KEY, "position"], "left_semi")
        .select(*KEY, "position", F.explode(F.array_distinct("depends_on")).alias("needs"))
        .where("needs IS NOT NULL")
        .join(known.select("conv_id", F.col("call_id").alias("needs"), F.col("position").alias("needs_at")), ["conv_id", "needs"])
        .distinct()
        .checkpoint()
    )
    odd = edges.where(F.col("needs_at") >= F.col("position")).select("conv_id").distinct()
    edges = edges.join(odd, "conv_id", "left_semi").select(*KEY, "needs").checkpoint()
    nodes = known.join(odd, "conv_id", "left_semi").select(*KEY).checkpoint()
    done = nodes.join(edges.select(*KEY), KEY, "left_anti").withColumn("level", F.lit(0)).checkpoint()
    count = done.count()
    while count:
        met = edges.join(done.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"], "left")
        fresh = (
            met.groupBy(*KEY)
            .agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("open"))
            .where("open = 0")
            .select(*KEY, (F.col("top") + 1).cast("int").alias("level"))
            .join(done.select(*KEY), KEY, "left_anti")
            .checkpoint()
        )
        count = fresh.count()
        if count:
            done = done.union(fresh).checkpoint()
    return nodes.join(done, KEY, "left").select(*KEY, "level", F.col("level").isNull().alias("cycle"))


def _wanted(kind: Column, got: Column) -> Column:
    """Whether a variant type satisfies the type that a schema asks for; unknown types ask for nothing."""
    out = F.lit(True)
    for name, pattern in TYPES.items():
        out = F.when(kind == name, F.regexp_like(got, F.lit(pattern))).otherwise(out)
    return out


def argument_errors(arguments: Column, params: Column, known_tool: Column) -> Column:
    """Sorted list of what is wrong with variant ``arguments`` under ``params``, array<struct<name, type, required>>."""
    fields = F.try_variant_get(arguments, "$", "map<string,variant>")
    is_object = F.regexp_like(F.schema_of_variant(arguments), F.lit("^OBJECT<"))
    value = lambda p: F.try_element_at(fields, p["name"])
    kind = lambda p: F.coalesce(F.schema_of_variant(value(p)), F.lit("VOID"))
    absent = lambda p: kind(p) == "VOID"
    missing = F.transform(F.filter(params, lambda p: p["required"] & absent(p)), lambda p: F.concat(F.lit("missing:"), p["name"]))
    wrong = F.transform(F.filter(params, lambda p: ~absent(p) & ~_wanted(p["type"], kind(p))), lambda p: F.concat(F.lit("type:"), p["name"]))
    names = F.transform(params, lambda p: p["name"])
    extra = F.transform(F.array_except(F.map_keys(fields), names), lambda k: F.concat(F.lit("unknown:"), k))
    return (
        F.when(~known_tool, F.array(F.lit("no_schema")))
        .when(arguments.isNull(), F.array(F.lit("not_json")))
        .when(~is_object, F.array(F.lit("not_object")))
        .otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    )


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls``: conv_id, position, call_id, tool, arguments (JSON text), depends_on (array of
    identifiers). ``results``: conv_id, position, call_id, content. ``schemas``: tool, name, type,
    required. Further columns are ignored.

    ``status``: ``linked``; ``unanswered``; ``repeated`` for calls that use an identifier again, which
    take no result; ``no_id`` for calls without conversation or identifier; ``orphan`` for results
    that no call asks for. Of several results the first by position, then by content, is linked, and
    ``n_results`` counts all. Equal rows at the same position count as one call and the rest as repeated.
    """
    calls = calls.select("conv_id", "position", "call_id", "tool", "arguments", "depends_on").withColumn("line", F.xxhash64("tool", "arguments", F.to_json("depends_on")))
    results = results.select("conv_id", "call_id", F.struct("position", "content").alias("answer"))
    # The first use of an identifier; among equals at one position any, for they are alike or told apart by their hash.
    numbered = calls.groupBy("conv_id", "position", "call_id", "tool", "arguments", "depends_on", "line").agg(F.count(F.lit(1)).alias("copies"))
    first = numbered.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct("position", "line")).alias("first"))
    per_call = results.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_results"), F.min("answer").alias("answer"))
    marked = numbered.join(first, KEY, "left").withColumn("is_first", F.coalesce(F.struct("position", "line") == F.col("first"), F.lit(False)))
    spread = marked.select(
        "*", F.explode(F.when(F.col("is_first") & (F.col("copies") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array("is_first"))).alias("counts")
    ).withColumn("n_rows", F.when(F.col("is_first") & F.col("counts"), F.lit(1)).when(F.col("is_first"), F.col("copies") - 1).otherwise(F.col("copies")))
    one = spread.where("counts").drop("first", "is_first", "copies", "counts", "line")
    again = spread.where("NOT counts").drop("first", "is_first", "copies", "counts", "line")
    joined = one.join(per_call, KEY, "full")
    linked = joined.withColumn(
        "status", F.when(F.col("n_rows").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    )
    other = again.withColumn("status", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id").otherwise("repeated"))
    rows = linked.unionByName(other, allowMissingColumns=True)

    params = schemas.where("tool IS NOT NULL AND name IS NOT NULL").groupBy("tool").agg(
        F.array_sort(F.collect_set(F.struct("name", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("params")
    )
    rows = rows.join(params, "tool", "left").withColumn("parsed", F.try_parse_json("arguments"))
    is_call = F.col("status") != "orphan"
    errors = F.when(is_call, argument_errors(F.col("parsed"), F.coalesce("params", F.expr("cast(array() AS array<struct<name: string, type: string, required: boolean>>)")), F.col("params").isNotNull()))
    rows = rows.withColumn("errors", errors).withColumn("valid", F.when(is_call, F.size("errors") == 0))

    # Dependencies on identifiers that the conversation never uses.
    named = first_calls(calls)
    unknown = (
        calls.select(*KEY, "position", F.explode("depends_on").alias("needs"))
        .where("needs IS NOT NULL")
        .join(named.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti")
        .groupBy(*KEY, "position")
        .agg(F.count_distinct("needs").alias("n_unknown"))
    )
    rows = rows.join(unknown, [*KEY, "position"], "left").join(levels(calls), KEY, "left")
    canonical = F.to_json(
        F.struct(
            F.col("parsed").alias("arguments"), "call_id", "conv_id",
            F.when(F.size("depends_on") > 0, F.array_sort(F.array_distinct("depends_on"))).alias("depends_on"),
            F.col("answer.content").alias("result"), "tool",
        )
    )
    return rows.select(
        "conv_id", "position", "call_id", "tool", "status", F.col("n_rows").cast("long").alias("n_rows"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("cycle", F.lit(False)).alias("cycle"),
        F.when(is_call & ~F.coalesce("cycle", F.lit(False)), F.coalesce("level", F.lit(0))).alias("level"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), "valid", "errors",
        F.when(is_call, canonical).alias("canonical"),
    )


SCHEMAS = [
    ("ask", "text", "string", True), ("ask", "limit", "integer", False),
    ("compute", "text", "string", True), ("compute", "factor", "number", True),
    ("lookup", "text", "string", True), ("lookup", "tags", "array", True), ("lookup", "exact", "boolean", False),
]


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation stands for.

    A user's turn asks a tool, and the next turn of the assistant is its result. Tool, arguments and
    dependencies follow from the length of the text: some arguments break their schema, and some
    calls depend on the next call instead of the one before.
    """
    n = F.char_length(F.coalesce("text", F.lit("")))
    turn = lambda k: F.concat_ws(":", F.col("conv_id"), F.col("turn") + k)
    arguments = (
        F.when(n % 3 == 0, F.to_json(F.struct("text", F.when(n % 5 == 0, F.lit("many")).alias("note"), (n % 7).alias("limit"))))
        .when(n % 3 == 1, F.to_json(F.struct("text", F.when(n % 5 != 0, (n % 100) + 0.5).alias("factor"))))
        .otherwise(F.to_json(F.struct("text", F.array((n % 4), F.lit(1)).alias("tags"), F.when(n % 5 == 0, (n % 2)).alias("exact"))))
    )
    needs = F.when(n % 11 == 0, F.array(turn(2))).when((F.col("turn") >= 2) & (n % 4 != 0), F.array(turn(-2))).otherwise(F.array().cast("array<string>"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", F.col("turn").alias("position"), turn(0).alias("call_id"),
        F.element_at(F.array(F.lit("ask"), F.lit("compute"), F.lit("lookup")), n % 3 + 1).alias("tool"), arguments.alias("arguments"), needs.alias("depends_on"),
    )
    results = conversations.where("role = 'assistant'").select("conv_id", F.col("turn").alias("position"), turn(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _sql() -> str:
    return """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n FROM conversations),
calls AS (
  SELECT conv_id, turn AS position, conv_id || ':' || turn AS call_id, ['ask', 'compute', 'lookup'][n % 3 + 1] AS tool, n, text,
    CASE WHEN n % 11 = 0 THEN conv_id || ':' || (turn + 2) WHEN turn >= 2 AND n % 4 <> 0 THEN conv_id || ':' || (turn - 2) END AS needs
  FROM c WHERE role = 'user'),
results AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM c WHERE role = 'assistant'),
edges AS (SELECT a.conv_id, a.call_id, a.needs, b.position >= a.position AS back FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND a.needs = b.call_id),
odd AS (SELECT DISTINCT conv_id FROM edges WHERE back),
walk AS (
  SELECT conv_id, call_id, call_id AS at, 0 AS depth FROM calls WHERE conv_id IN (SELECT conv_id FROM odd)
  UNION ALL
  SELECT w.conv_id, w.call_id, e.needs, w.depth + 1 FROM walk w JOIN edges e ON w.conv_id = e.conv_id AND w.at = e.call_id WHERE w.depth < 50),
level AS (SELECT conv_id, call_id, max(depth) AS depth FROM walk GROUP BY ALL),
found AS (
  SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, a.position, coalesce(a.call_id, r.call_id) AS call_id, a.tool, a.n, a.text, a.needs, r.content, r.call_id IS NOT NULL AS answered
  FROM calls a FULL JOIN results r ON a.conv_id = r.conv_id AND a.call_id = r.call_id),
judged AS (
  SELECT f.*, coalesce(l.depth >= 50, false) AS cycle, coalesce(l.depth, 0) AS depth,
    CASE WHEN f.n IS NULL THEN NULL
      WHEN tool = 'ask' THEN list_concat(CASE WHEN text IS NULL THEN ['missing:text'] ELSE [] END, CASE WHEN f.n % 5 = 0 THEN ['unknown:note'] ELSE [] END)
      WHEN tool = 'compute' THEN list_concat(CASE WHEN f.n % 5 = 0 THEN ['missing:factor'] ELSE [] END, CASE WHEN text IS NULL THEN ['missing:text'] ELSE [] END)
      ELSE list_concat(CASE WHEN text IS NULL THEN ['missing:text'] ELSE [] END, CASE WHEN f.n % 5 = 0 THEN ['type:exact'] ELSE [] END) END AS errors,
    concat_ws(',',
      CASE WHEN tool = 'lookup' AND f.n % 5 = 0 THEN '"exact":' || (f.n % 2) END,
      CASE WHEN tool = 'compute' AND f.n % 5 <> 0 THEN '"factor":' || (f.n % 100) || '.5' END,
      CASE WHEN tool = 'ask' THEN '"limit":' || (f.n % 7) END,
      CASE WHEN tool = 'ask' AND f.n % 5 = 0 THEN '"note":"many"' END,
      CASE WHEN tool = 'lookup' THEN '"tags":[' || (f.n % 4) || ',1]' END,
      CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text)::VARCHAR END) AS args
  FROM found f LEFT JOIN level l ON f.conv_id = l.conv_id AND f.call_id = l.call_id)
SELECT conv_id, position, call_id, tool,
  CASE WHEN n IS NULL THEN 'orphan' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status,
  CASE WHEN n IS NOT NULL THEN 1::BIGINT END AS n_rows, answered::BIGINT AS n_results, cycle,
  CASE WHEN n IS NOT NULL AND NOT cycle THEN depth::INTEGER END AS level,
  CASE WHEN needs IS NOT NULL AND needs NOT IN (SELECT call_id FROM calls) THEN 1::BIGINT ELSE 0::BIGINT END AS n_unknown,
  len(errors) = 0 AS valid, array_to_string(errors, ',') AS errors,
  CASE WHEN n IS NOT NULL THEN '{' || concat_ws(',', '"arguments":{' || args || '}', '"call_id":"' || call_id || '"', '"conv_id":' || conv_id,
    CASE WHEN needs IS NOT NULL THEN '"depends_on":["' || needs || '"]' END,
    CASE WHEN content IS NOT NULL THEN '"result":' || to_json(content)::VARCHAR END, '"tool":"' || tool || '"') || '}' END AS canonical
FROM judged
"""


@query("op9_tool_call_linking", _sql())
def op9(spark, sf_dir):
    calls, results = from_conversations(read(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(SCHEMAS, "tool string, name string, type string, required boolean")
    return link(calls, results, schemas).withColumn("errors", F.array_join("errors", ","))
