"""Chat formatting: tool calls linked to their results, in topological order, validated, as canonical JSON.

DataFrame expressions only. ``link`` hash-joins calls with the smallest result on (conv_id, call_id); the further results
of an identifier are rows of their own, so repeated identifiers cost no product; a hot identifier's calls are split by Spark (adaptive skew joins). ``levels`` orders calls after the calls they follow: pointers
to the parents are doubled, so the rounds follow the logarithm of the longest chain; what still points somewhere after
that many rounds is on a cycle and has no level. ``validate`` checks arguments against a schema of typed, bounded or
enumerated fields, nested ones by their path; fields that a schema doesn't name are faults.
Arguments are parsed to variants, whose objects keep their keys sorted, which makes their JSON canonical at any depth.

Edge cases: a call without a result is "unanswered", a result without a call "orphan"; differing calls and results with
one identifier are rows of their own, the further results without a call ("answered" if there is one, with a null name
and problem); only exact repeats are combined and counted in ``copies``; a null turn makes a null identifier, which
nothing answers or follows, and its rows stay; turns of other roles than user and assistant (system) are neither calls
nor results and make no rows; an unknown parent counts as none; arguments that aren't an object are "malformed" and stay in
the message as they came (``raw``), a tool without a schema is an "unknown tool"; very long texts pass whole; null texts make null contents, which the JSON leaves out; rows with a null conv_id form
one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialise, table

class Field(NamedTuple):
    """A schema's field: variant type, whether required, bounds (of a number, or a string's length), allowed values."""

    kind: str
    required: bool = False
    least: int | None = None
    most: int | None = None
    options: tuple[str, ...] = ()


#: tool -> path of a field -> what it must be. Fields of an object have its path before their name.
SCHEMAS = {
    "lookup": {"limit": Field("BIGINT", True, 1, 120), "query": Field("STRING", True, 1, 100_000)},
    "search": {
        "limit": Field("BIGINT", True, 1, 40), "query": Field("STRING", True, 1, 100_000), "scope": Field("STRING", options=("news", "web")),
        "options": Field("OBJECT"), "options.depth": Field("BIGINT", True, 0, 4),
    },
}
KEY = ["conv_id", "call_id"]


def calls_of(conversations: DataFrame) -> DataFrame:
    """User turns as tool calls: every call names the one two turns before as its parent."""
    ident = lambda back: F.concat(F.lit("call-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("-"), (F.col("turn") - back).cast("string"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    name = F.when(F.col("turn") % 2 == 0, "search").otherwise("lookup")
    options = F.when((name == "search") & (F.col("turn") % 3 == 0), F.struct((F.col("turn") % 10).cast("long").alias("depth")))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit"), F.when(F.col("turn") % 4 == 0, "web").alias("scope"), options.alias("options")))
    return conversations.where("role = 'user'").select("conv_id", ident(0).alias("call_id"), ident(2).alias("parent_id"), F.col("turn").alias("seq"), name.alias("name"), arguments.alias("arguments"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Assistant turns as results of the call in the turn before."""
    ident = F.concat(F.lit("call-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("-"), (F.col("turn") - 1).cast("string"))
    return conversations.where("role = 'assistant'").select("conv_id", ident.alias("call_id"), F.col("text").alias("content"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every differing call and result: call, result, ``status`` and ``copies`` (exact repeats of what the row shows first).

    Calls take the smallest result of their identifier; each further result is a row with the identifier and no call.
    """
    seen = calls.groupBy(*KEY, "seq", "name", "arguments", "parent_id").agg((F.count("*") - 1).alias("copies"))
    own = seen.select(*KEY, F.struct("seq", "name", "arguments", "parent_id").alias("c"), "copies")
    got = results.groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "content").agg((F.count("*") - 1).alias("again"))
    got = materialise(got.select("_conv", "_call", F.struct("content").alias("r"), "again"), "results")
    first = got.groupBy("_conv", "_call").agg(F.min(F.struct("r", "again")).alias("f")).select("_conv", "_call", "f.r", "f.again")
    least = first.select(F.col("_conv").alias("_c"), F.col("_call").alias("_k"), F.col("r").alias("_r"))
    named = F.col("_call").eqNullSafe(F.col("_k")) & F.col("_conv").eqNullSafe(F.col("_c"))
    further = got.join(least, named).where(~F.col("r").eqNullSafe(F.col("_r"))).select("_conv", "_call", "r", "again")
    least_call = own.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k")).agg(F.min("c").alias("lead"))
    asked = own.join(least_call, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("call_id").eqNullSafe(F.col("_k")), "left").drop("_c", "_k")
    # outer on the side of the calls only, so that Spark can split the calls of a hot identifier; results nobody asked for follow
    met = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call"))
    unasked = first.join(least_call, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_call") == F.col("_k")), "left_anti")
    both = asked.join(first, met, "left").unionByName(unasked, allowMissingColumns=True)
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("answered")
    shown = F.when(F.col("c").isNull() | F.col("c").eqNullSafe(F.col("lead")), F.coalesce("again", F.lit(0))).otherwise(0)
    linked = both.select(
        F.when(F.col("c").isNull(), F.col("_conv")).otherwise(F.col("conv_id")).alias("conv_id"), F.coalesce("call_id", "_call").alias("call_id"),
        "c.seq", "c.name", "c.arguments", "c.parent_id", "r.content", status.alias("status"), (F.coalesce("copies", F.lit(0)) + shown).cast("long").alias("copies"),
    )
    answers = least_call.select("_c", "_k", F.lit(True).alias("asked"))
    rest = further.join(answers, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_call") == F.col("_k")), "left")
    none = [F.lit(None).cast(linked.schema[x].dataType).alias(x) for x in ("seq", "name", "arguments", "parent_id")]
    more = rest.select(F.col("_conv").alias("conv_id"), F.col("_call").alias("call_id"), *none, "r.content", F.when(F.col("asked"), "answered").otherwise("orphan").alias("status"), F.col("again").cast("long").alias("copies"))
    return linked.unionByName(more)


def levels(linked: DataFrame) -> DataFrame:
    """``linked`` with ``level``: 0 for calls without a (known) parent, else one more than the parent's; null on a cycle.

    An identifier has the level of its smallest call; every row has its own parent's and one more.
    """
    nodes = linked.where("call_id IS NOT NULL").groupBy(*KEY).agg(F.min(F.when(F.col("seq").isNotNull() | F.col("name").isNotNull(), F.struct("seq", "name", "arguments", "parent_id"))).alias("c")).select(*KEY, "c.parent_id")
    nodes = materialise(nodes, "identifiers")
    same = lambda left, right: F.col(f"{left}.conv_id").eqNullSafe(F.col(f"{right}.conv_id"))
    known = nodes.alias("n").join(nodes.alias("p"), same("n", "p") & (F.col("n.parent_id") == F.col("p.call_id")), "left")
    state = materialise(known.select("n.conv_id", "n.call_id", F.col("p.call_id").alias("up"), F.when(F.col("p.call_id").isNotNull(), 1).otherwise(0).cast("long").alias("level")), "levels")
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        if not state.where("up IS NOT NULL").limit(1).count():
            break
        step = state.alias("s").join(state.alias("p"), same("s", "p") & (F.col("s.up") == F.col("p.call_id")), "left")
        state = materialise(step.select("s.conv_id", "s.call_id", F.col("p.up").alias("up"), (F.col("s.level") + F.coalesce("p.level", F.lit(0))).alias("level")), "levels")
    level = F.when(F.col("l.call_id").isNull(), 0).when(F.col("l.up").isNull(), F.col("l.level") + 1)
    return linked.alias("c").join(state.alias("l"), same("c", "l") & (F.col("c.parent_id") == F.col("l.call_id")), "left").select("c.*", level.cast("long").alias("level"))


def validate(linked: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``linked`` with ``args`` (a variant) and ``problem``: the first fault of the arguments, or null.

    Faults by path: missing, of another type, out of range, none of the options; then fields without a schema, by object.
    """
    parsed = linked.withColumn("args", F.try_parse_json("arguments"))
    problem = F.when(~F.col("name").isin(*schemas), "unknown tool").when(F.col("args").isNull() | ~F.schema_of_variant("args").startswith("OBJECT"), "malformed")
    for tool, fields in schemas.items():
        mine = F.col("name") == tool
        for path, field in sorted(fields.items()):
            value = F.try_variant_get("args", f"$.{path}", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            if field.required:
                above = path.rpartition(".")[0]
                inside = ~F.try_variant_get("args", f"$.{above}", "variant").isNull() if above else F.lit(True)
                problem = problem.when(mine & inside & missing, f"missing {path}")
            there = mine & ~missing
            problem = problem.when(there & ~F.schema_of_variant(value).startswith(field.kind), f"type of {path}")
            if field.least is not None:
                size = F.length(F.try_variant_get("args", f"$.{path}", "string")) if field.kind == "STRING" else F.try_variant_get("args", f"$.{path}", field.kind)
                problem = problem.when(there & ~size.between(field.least, field.most), f"range of {path}")
            if field.options:
                problem = problem.when(there & ~F.try_variant_get("args", f"$.{path}", "string").isin(*field.options), f"value of {path}")
        for at in ["", *sorted(p for p, f in fields.items() if f.kind == "OBJECT")]:
            known = [p.rpartition(".")[2] for p in fields if p.rpartition(".")[0] == at]
            own = F.map_keys(F.try_variant_get("args", f"$.{at}" if at else "$", "map<string,variant>"))
            extra = F.array_min(F.array_except(own, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
            problem = problem.when(mine & extra.isNotNull(), F.concat(F.lit(f"unknown field {at}{'.' if at else ''}"), extra))
    return parsed.withColumn("problem", F.when(F.col("seq").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull(), problem))


def formatted(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, call_id, level, name, status, copies, problem, message); order by conv_id, level, call_id."""
    done = validate(levels(link(calls_of(conversations), results_of(conversations))))
    return done.select("conv_id", "call_id", "level", "name", "status", "copies", "problem", message().alias("message"))


def message() -> Column:
    """The canonical JSON of a validated row; its keys are in order."""
    raw = F.when(F.col("problem") == "malformed", F.col("arguments"))
    args = F.when(F.col("problem").isNull() | (F.col("problem") != "malformed"), F.col("args"))
    return F.to_json(F.struct(args.alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.when(F.col("level") > 0, F.col("parent_id")).alias("parent"), raw.alias("raw"), F.col("content").alias("result")))


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, 'call-' || conv_id || '-' || (turn - 2) AS parent_id,
    CASE WHEN turn % 2 = 0 THEN 'search' ELSE 'lookup' END AS name, text,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n, CASE WHEN turn % 4 = 0 THEN 'web' END AS scope,
    CASE WHEN turn % 2 = 0 AND turn % 3 = 0 THEN json_object('depth', turn % 10) END AS options
  FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
depth AS (
  SELECT conv_id, turn, call_id, CAST(0 AS BIGINT) AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, c.call_id, d.level + 1 FROM depth d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(d.level, 0) AS level, c.name, c.parent_id, c.text, c.n, c.scope, c.options, r.content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status
  FROM calls c FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id LEFT JOIN depth d ON d.call_id = c.call_id AND d.conv_id = c.conv_id)
SELECT conv_id, call_id, level, name, status, CAST(0 AS BIGINT) AS copies,
  CASE WHEN status = 'orphan' THEN NULL WHEN n NOT BETWEEN 1 AND CASE name WHEN 'search' THEN 40 ELSE 120 END THEN 'range of limit'
    WHEN options IS NOT NULL AND CAST(options ->> 'depth' AS BIGINT) > 4 THEN 'range of options.depth'
    WHEN text IS NULL THEN 'missing query' WHEN length(text) NOT BETWEEN 1 AND 100000 THEN 'range of query' END AS problem,
  CAST(json_merge_patch('{}', json_object('arguments', CASE WHEN status <> 'orphan' THEN json_merge_patch('{}', json_object('limit', n, 'options', options, 'query', text, 'scope', scope)) END,
    'id', call_id, 'level', level, 'name', name, 'parent', CASE WHEN level > 0 THEN parent_id END, 'result', content)) AS VARCHAR) AS message
FROM linked
"""
