"""Steps around retrieval that are plug-ins in an application: rewriting, re-ranking, corrective search, backends, hooks.

Defaults are deterministic stand-ins built from column functions; a model is plugged in as another function of the same
shape (DataFrame -> DataFrame, or Column -> Column). Nothing here calls a service.
"""

from __future__ import annotations

import ast
import inspect
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.session import materialise

#: search backend -> function(vectors, queries, k), exact ones first.
BACKENDS: dict[str, Callable] = {"exact": R.knn, "l2": lambda v, q, k: R.knn(v, q, k, "l2", 4), "ann": R.ann}


def backend(vectors: DataFrame, preferred: str = "exact", exact_rows: int = 50_000) -> str:
    """The backend named; "auto" is the one that a relation's size asks for: exact up to some rows, then approximate."""
    if preferred != "auto":
        if preferred not in BACKENDS:
            raise ValueError(f"no such backend: {preferred}")
        return preferred
    return "exact" if vectors.limit(exact_rows + 1).count() <= exact_rows else "ann"


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, preferred: str = "exact") -> DataFrame:
    return BACKENDS[backend(vectors, preferred)](vectors, queries, k)


def halves(text: Column) -> Column:
    """A rewriter: the question itself and its two halves of words."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    half = F.ceil(F.size(words) / 2).cast("int")
    return F.array_distinct(F.array_compact(F.array(text, F.array_join(F.slice(words, 1, half), " "), F.when(F.size(words) > 1, F.array_join(F.slice(words, half + 1, F.size(words)), " ")))))


def rewrite(queries: DataFrame, rewriter: Callable[[Column], Column] = halves, most: int = 4) -> DataFrame:
    """(query_id, part, text): at most ``most`` sub-queries a query."""
    return queries.select("query_id", F.posexplode(F.slice(rewriter(F.col("text")), 1, most)).alias("part", "text"))


def first_words(question: Column, content: Column) -> Column:
    """A scorer of pairs: share of the question's words among the first 1000 characters."""
    return F.round(T.overlap(T.words(question), T.words(F.substring(content, 1, 1000))), 4)


def rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = first_words, k: int = 5) -> DataFrame:
    """Hits in the order of a scorer of (question, content)."""
    pairs = hits.select("query_id", "id").join(docs, "id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    return R.top(pairs.select("query_id", "id", scorer(F.col("question"), F.col("text")).alias("score")), k)


def corrective(find: Callable[[DataFrame], DataFrame], queries: DataFrame, rewriter: Callable[[Column], Column], threshold: float = 0.35, rounds: int = 2, k: int = 10) -> DataFrame:
    """Search again, with rewritten texts, for queries whose mean score is low; of equal ids the best score stays."""
    found = materialise(find(queries).select("query_id", "id", "score"), "corrective")
    asked = queries
    for _ in range(rounds):
        weak = found.groupBy("query_id").agg(F.avg("score").alias("mean")).where(F.col("mean") < threshold).select("query_id")
        asked = asked.join(weak, "query_id", "left_semi").withColumn("text", rewriter(F.col("text")))
        if not asked.limit(1).count():
            break
        found = materialise(R.best_of([found, find(asked)]), "corrective")
    return R.top(found, k)


def query_log(results: DataFrame, queries: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """One row a query at the end of a search: its sub-queries' number, its results in order, and how good they look.

    ``results``: (query_id, id, score, rank); ``queries``: (query_id, text); ``parts``: (query_id), a row a sub-query; ``texts``:
    (id, text). Queries without results have an empty list and zeros.
    """
    held = materialise(results.select("query_id", "id", "score", "rank"), "search-results")
    measured = R.quality_metrics(held.join(texts.select("id", "text"), "id").select("query_id", "text", "score"), queries)
    listed = held.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("chunk_ids"))
    asked = queries.select("query_id").join(parts.groupBy("query_id").agg(F.count("*").alias("n_queries")), "query_id", "left")
    none = F.array().cast("array<bigint>")
    return asked.join(listed, "query_id", "left").join(measured, "query_id", "left").select("query_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), F.coalesce("chunk_ids", none).alias("chunk_ids"), "faithfulness", "relevancy", "context_precision")


def prefixed(chunks: DataFrame, summary: Callable[[Column], Column] = lambda doc: F.substring(doc, 1, 80)) -> DataFrame:
    """(id, content) with the context of the document in front, once there is some."""
    context = summary(F.col("document"))
    return chunks.select("id", F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n"), F.col("content"))).otherwise(F.col("content")).alias("content"))


# registered functions


TYPES = {int: "bigint", float: "double", str: "string", bool: "boolean"}


def schema_of(function: Callable) -> dict:
    """Parameters and their types, as a schema inferred from the hints; those without a default are required."""
    parameters = inspect.signature(function, eval_str=True).parameters.values()
    names = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}
    return {"type": "object", "properties": {p.name: {"type": names.get(p.annotation, "string")} for p in parameters}, "required": [p.name for p in parameters if p.default is p.empty]}


def registered(spark: SparkSession, function: Callable, most: int = 10_000) -> None:
    """Registers a typed function for SQL; errors become the field ``error`` of its result, long strings are cut."""
    kind = TYPES[inspect.signature(function, eval_str=True).return_annotation]

    def call(*args):
        try:
            value = function(*args)
            return (value[:most] if isinstance(value, str) else value, None)
        except Exception as e:  # noqa: BLE001  the error is the result
            return (None, f"{type(e).__name__}: {e}")

    spark.udf.register(function.__name__, F.udf(call, f"value {kind}, error string"))


#: What source text of a function may hold.
MODULES = frozenset(("math", "json", "re", "datetime", "collections", "itertools", "statistics", "string"))
FORBIDDEN = frozenset(("eval", "exec", "compile", "open", "input", "__import__", "globals", "locals", "getattr", "setattr", "delattr", "vars"))


def objections(source: str) -> list[str]:
    """Why source text isn't one harmless function; it is only parsed, never run."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"syntax: {e.msg}"]
    out = [] if sum(isinstance(n, ast.FunctionDef) for n in tree.body) == 1 else ["needs one function"]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [f"import of {a.name}" for a in node.names if a.name.split(".")[0] not in MODULES]
        elif isinstance(node, ast.ImportFrom) and (node.module or "").split(".")[0] not in MODULES:
            out.append(f"import of {node.module}")
        elif isinstance(node, ast.Name) and node.id in FORBIDDEN:
            out.append(f"use of {node.id}")
        elif isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            out.append(f"use of {node.attr}")
    return out


class Hooks:
    """Named points with ordered DataFrame -> DataFrame steps. A step that can't be planned is left out and noted."""

    def __init__(self):
        self.steps: dict[str, list[tuple[int, int, Callable]]] = {}
        self.failed: list[tuple[str, str]] = []

    def add(self, point: str, step: Callable, priority: int = 100) -> None:
        self.steps.setdefault(point, []).append((priority, len(self.steps.get(point, [])), step))

    def apply(self, point: str, df: DataFrame) -> DataFrame:
        def one(df: DataFrame, item) -> DataFrame:
            try:
                return item[2](df)
            except Exception as e:  # noqa: BLE001  an error ends a step, not the chain
                self.failed.append((point, f"{type(e).__name__}: {e}"))
                return df

        return reduce(one, sorted(self.steps.get(point, []), key=lambda s: s[:2]), df)


def eligible(skills: DataFrame, system: str, binaries: list[str], variables: list[str]) -> DataFrame:
    """Skills (os, bins, env as arrays, null: any) that this machine can run."""
    have = lambda column, names: F.col(column).isNull() | (F.size(F.array_except(F.col(column), F.array(*map(F.lit, names)).cast("array<string>"))) == 0)
    return skills.where((F.col("os").isNull() | F.array_contains("os", system)) & have("bins", binaries) & have("env", variables))


def first_success(results: DataFrame, order: list[str]) -> DataFrame:
    """Of each query's results by provider (query_id, provider, ok, value) the first in order that succeeded."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    w = Window.partitionBy("query_id").orderBy(place, "value")
    return results.where(F.col("ok") & (place > 0)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
