"""Strings and names looked up in many texts by an index or an automaton, not text by text and string by string."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.session import materialise, maybe_broadcast, prepare

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(id, string): which of the strings (string) stand in which texts (id, text), by postings of stretches of three characters.

    A string's trigrams are looked up among those of the texts; texts that have all of them are candidates, which are
    verified. Strings of one or two characters are stretches themselves, so no string needs all texts. An empty string stands nowhere.
    """
    asked = strings.select("string").where("string <> ''").distinct().withColumn("size", F.least(F.length("string"), F.lit(GRAM)))
    parts = F.when(F.col("size") == 1, grams(F.col("string"), 1)).when(F.col("size") == 2, grams(F.col("string"), 2)).otherwise(grams(F.col("string"), GRAM))
    needed = materialise(asked.select("string", F.size(parts).alias("needed"), F.explode(parts).alias("gram")), "asked-grams")
    sizes = [r[0] for r in needed.select(F.length("gram").alias("n")).distinct().collect()]  # three numbers at most
    if not sizes:
        return texts.select("id", F.lit("").alias("string")).limit(0)
    listed = texts.select("id", F.explode(F.concat(*(grams(F.col("text"), n) for n in sizes))).alias("gram"))
    met = listed.join(maybe_broadcast(needed), "gram").groupBy("id", "string").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    candidates = materialise(met.select("id", "string"), "gram-candidates")
    return candidates.join(texts.select("id", "text"), "id").where(F.contains("text", F.col("string"))).select("id", "string")


def substring_score(queries: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """Files by 0.3 times the share of the query's words that stand in their description; above 0.05 only."""
    asked = materialise(queries.select("query_id", F.array_distinct(T.words(F.col("text"))).alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("string")), "asked-words")
    found = holding(files.select("id", F.lower("description").alias("text")), asked)
    share = found.join(maybe_broadcast(asked), "string").groupBy("query_id", "id").agg((F.count("*") / F.first("n")).alias("share"))
    return R.top(share.select("query_id", "id", F.round(0.3 * F.col("share"), 3).alias("score")).where("score > 0.05"), k)


def naming(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): which names (name: terms joined by blanks) stand in which texts (id, text), in one pass by an automaton.

    The names, a block of a stated set, go to the tasks as one Aho-Corasick automaton over whole terms; the rows made are the hits.
    Texts of a single term mention nothing.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for r in names.select("name").distinct().collect():  # bounded by the block
        if r["name"]:
            automaton.add_word(f" {r['name']} ", r["name"])
    automaton.make_automaton()
    shared = prepare(texts.sparkSession).sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(n, 512) for b in batches for n in range(0, b.num_rows, 512)):
            ids, found = [], []
            for i, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(shared.value) and terms and len(terms) > 1:
                    own = {name for _, name in shared.value.iter(f" {' '.join(terms)} ")}
                    ids += [i] * len(own)
                    found += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "name"])

    return texts.select(F.col("id").cast("long").alias("id"), T.terms(F.col("text")).alias("t")).mapInArrow(run, "id bigint, name string")


def entity_search(texts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Texts (id, text) that name an entity of the query: whole names score 1; queries without any hit fall back to words, 0.5.

    ``queries``: (query_id, names, words), in blocks; names and words of more than three characters are found by automaton.
    """

    def own(some: DataFrame) -> DataFrame:
        names = materialise(some.select("query_id", F.explode(F.array_distinct(F.transform("names", F.lower))).alias("name")), "asked-names")
        exact = materialise(naming(texts, names).join(maybe_broadcast(names), "name").select("query_id", "id", F.lit(1.0).alias("score")), "entity-hits")
        missed = some.join(exact.select("query_id").distinct(), "query_id", "left_anti")
        words = materialise(missed.select("query_id", F.explode(F.array_distinct("words")).alias("name")).where(F.length("name") > 3), "asked-name-words")
        loose = naming(texts, words).join(maybe_broadcast(words), "name").select("query_id", "id", F.lit(0.5).alias("score"))
        return exact.unionByName(loose)

    return R.top(R.blocks(queries, own).groupBy("query_id", "id").agg(F.max("score").alias("score")), k)
