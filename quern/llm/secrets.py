"""Secret scans over a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression is turned into a Boolean trigram query (``trigram_query``: clauses of trigrams that a
match's text must hold, as an OR of ANDs). The index holds postings (trigram, doc_id) for the trigrams that some rule
asks for, as no other posting would be read; a rule's candidates are the documents in the postings of all trigrams of one
of its clauses. Only candidates are matched against the expression itself, twice: for the matches and for what stands
between them. Rules without a mandatory trigram (here ``hex``) match every document.

Edge cases: a null text is an empty one, without spans; documents that share an id (or a null id) share candidates, and
each is verified on its own text, so nothing is lost; copies, ties and repeated rows have equal spans, a row each; very long texts with many matches cost no
more than matches times the root of their number; an empty table gives an empty result; columns other than doc_id and text are ignored. Offsets are code points.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialise, maybe_broadcast, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, expression, (group, least length) that a match must have. The first three are the base rules, as listed.
RULES = (
    ("assign", ASSIGN, (2, 8)),
    ("access", r"AKIA[A-Z0-9]{12,}", None),
    ("hex", r"[0-9a-f]{32,}", None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    ("google", r"AIza[A-Za-z0-9_-]{35}", None),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", None),
    ("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._!$%-]{6,}@", None),
)
BASE = ("assign", "access", "hex")
#: Above so many alternatives a stretch of the expression counts as unknown.
MOST = 24


def _strings(items) -> list[tuple[set[str], bool]]:
    """Stretches of an expression: sets of possible strings (lower case), split where anything may stand."""
    out: list[set[str]] = [{""}]

    def gap():
        out.append({""})

    def put(options: set[str]) -> None:
        joined = {a + b for a, b in product(out[-1], options)}
        if len(joined) > MOST:
            out.append(options if len(options) <= MOST else {""})
            if len(options) > MOST:
                gap()
        else:
            out[-1] = joined

    for op, arg in items:
        if op is C.LITERAL:
            put({chr(arg).lower()})
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            put({chr(v).lower() for _, v in arg})
        elif op is C.SUBPATTERN or op is C.BRANCH:
            branches = arg[1] if op is C.BRANCH else [arg[3]]
            parts = [_strings(b) for b in branches]
            if all(len(p) == 1 for p in parts):
                put(set().union(*(p[0] for p in parts)))
            elif len(parts) == 1:
                first, *rest = parts[0]
                put(first)
                out.extend(rest)
            else:
                gap()
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            inner = _strings(arg[2])
            if len(inner) == 1:
                put(inner[0] | ({""} if arg[0] == 0 else set()))
            else:
                gap()
        else:
            gap()
    return out


def trigram_query(expression: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that each match's text satisfies; empty: no mandatory trigram."""
    clauses: list[frozenset[str]] = [frozenset()]
    for options in _strings(parser.parse(expression)):
        grams = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in options]
        if grams and all(grams) and len(clauses) * len(grams) <= 64:
            clauses = list(dict.fromkeys(a | b for a, b in product(clauses, grams)))
    return [c for c in clauses if not any(o < c for o in clauses)] if all(clauses) else []


def queries(rules=RULES) -> dict[str, list[frozenset[str]]]:
    return {kind: trigram_query(expression) for kind, expression, _ in rules}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for each of ``trigrams`` that the lower-cased text holds."""
    low = docs.select("doc_id", F.lower("text").alias("low")).where(F.col("low") != "")
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, asked: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(_id, kinds): for each document the rules of which one clause's postings all hold it."""
    rows = [(kind, f"{kind}{k}", t, len(clause)) for kind, clauses in asked.items() for k, clause in enumerate(clauses) for t in sorted(clause)]
    # a row for each trigram of each clause of each rule: fixed by the rules, not by the data
    wanted = F.broadcast(index.sparkSession.createDataFrame(rows, "kind string, clause string, trigram string, need int"))
    found = (
        index.join(wanted, "trigram").groupBy("doc_id", "kind", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("need").alias("need")).where("n = need")
    )
    return found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("kind").alias("kinds"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """For each of an array of numbers the sum of those before it, in blocks of about the root of their number.

    Inside a block, and over the blocks before it, sums are added up anew, so n numbers cost n times the root of n.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def blocked(own: Column) -> Column:
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(own) - 1, wide), lambda k: F.slice(own, k + 1, wide))

        def placed(parts: Column) -> Column:
            firsts = let(F.transform(parts, total), lambda sums: F.transform(F.sequence(F.lit(1), F.size(sums)), lambda k: total(F.slice(sums, F.lit(1), k - 1))))
            return F.flatten(F.zip_with(parts, firsts, lambda part, first: F.transform(part, lambda _, k: first + total(F.slice(part, F.lit(1), k)))))

        return let(blocks, placed)

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(sizes, blocked))


NOTHING = "array<struct<start:int,ord:int,kind:string,end:int>>"


def spans(text: Column, order: int, kind: str, expression: str, least: tuple[int, int] | None) -> Column:
    """array<struct<start, ord, kind, end>> of the leftmost non-overlapping matches, from the pieces between them."""

    def placed(hits: Column) -> Column:
        pieces = F.slice(F.split(text, expression, -1), F.lit(1), F.size(hits))
        sizes = F.zip_with(pieces, hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n")))
        wide = F.transform(F.regexp_extract_all(text, F.lit(expression), F.lit(least[0])), F.length) if least else F.transform(hits, lambda h: F.lit(0))

        def cut(both: Column) -> Column:
            rows = F.arrays_zip(both.alias("b"), running(F.transform(both, lambda x: x["gap"] + x["n"])).alias("at"), wide.alias("g"))
            good = F.filter(rows, lambda r: r["g"] >= least[1]) if least else rows
            start = lambda r: r["at"] + r["b"]["gap"]
            return F.transform(good, lambda r: F.struct(start(r).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start(r) + r["b"]["n"]).alias("end")))

        return F.when(F.size(hits) > 0, let(sizes, cut)).otherwise(F.array().cast(NOTHING))

    return let(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), placed)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and ``found``, the sorted spans of all rules, of each row."""
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    asked = {kind: q for kind, q in queries(rules).items() if q}
    trigrams = sorted({t for q in asked.values() for clause in q for t in clause})
    index = materialise(postings(docs, trigrams), "postings")
    some = materialise(candidates(index, asked), "candidates")
    joined = docs.join(maybe_broadcast(some), docs["doc_id"].eqNullSafe(some["_id"]), "left").select("doc_id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    each = []
    for order, (kind, expression, least) in enumerate(rules):
        own = spans(F.col("text"), order, kind, expression, least)
        each.append(F.when(F.array_contains("kinds", kind), own).otherwise(F.array().cast(NOTHING)) if kind in asked else own)
    return joined.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def digest_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.expr(f"filter(found, s -> s.ord = {k})")).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(digest_text(base), 256).alias("base_sha256"), digest_text(F.col("found")).alias("spans"))


def _duck(kind: str, order: int, expression: str, least) -> str:
    quoted = expression.replace("'", "''")
    g = f"regexp_extract_all(text, '{quoted}', {least[0]})" if least else "h"
    return f"""(SELECT coalesce(list({{'s': s, 'o': {order}, 'k': '{kind}', 'e': e}}), []) FROM (
      SELECT unnest(range(1, len(h) + 1)) i, h, p, g FROM (SELECT regexp_extract_all(text, '{quoted}') h, string_split_regex(text, '{quoted}') p, {g} g)) x,
      LATERAL (SELECT list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i-1], lambda v: length(v))), 0) s),
      LATERAL (SELECT s + length(h[i]) e) WHERE length(g[i]) >= {least[1] if least else 0})"""


def oracle() -> str:
    """The same result from plain matching of each rule, without an index."""
    # an expression that starts with a flag means the same in both engines
    lists = ", ".join(_duck(kind, k, e, least) for k, (kind, e, least) in enumerate(RULES))
    text = "lambda v: v.k || ':' || CAST(v.s AS BIGINT) || ':' || CAST(v.e AS BIGINT)"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda v: v.o = {k})) AS BIGINT) AS n_{kind}" for k, kind in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      found AS (SELECT doc_id, list_sort(flatten([{lists}])) AS f FROM d)
      SELECT doc_id, {counts}, sha256(array_to_string(list_transform(list_filter(f, lambda v: v.o < {len(BASE)}), {text}), ',')) AS base_sha256,
        array_to_string(list_transform(f, {text}), ',') AS spans FROM found"""
