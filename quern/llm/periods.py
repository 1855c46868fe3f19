"""Periodic runs of words with an enhanced suffix array: branching tandem repeats of LCP intervals, rotated and merged.

Texts are handled in blocks of some 65,000 words (a longer text is a block of its own), with an alphabet for each text, so that
no suffix matches one of another text. The suffix array comes from prefix doubling over what isn't sorted yet, the LCP
values from its levels. Every LCP interval is met as binary splits between neighbouring children; the suffixes i of the
smaller side are tested by ISA[i + depth] and ISA[i - depth]: if that suffix is on the other side, the two are branching and a
square of this period ends where its next word would break the period. Rotating a square to the left, as far as words that far
apart are equal, gives the run; squares of multiples of a period are merged into the run of the least one. There are no tree
nodes: a split is a place in the array and its two bounds. A text in which no five words repeat has no run of
the asked size, so its intervals aren't opened.

A run is a stretch with smallest period q, of ``max(LEAST, TIMES * q)`` words at least, that no neighbouring word extends.

Edge cases: a null, empty or blank text has no words and no runs; a text is one task's, however long (about 150 bytes a
word); repeated rows and ties have equal results; rows with a null id are kept, as are rows of any other id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encode import release, slices
from quern.session import prepare, table

LEAST, TIMES = 6, 4
#: Words in a block, about, and suffixes tested at a time.
BLOCK, TESTED = 1 << 16, 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP values (of places k - 1 and k) of whole numbers."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[sa[1:]] != s[sa[:-1]]
    split = np.where(new, 0, -1).astype(np.int8)  # the level that parts k - 1 and k
    rank = np.empty(n + 1, np.int64)
    first = np.flatnonzero(new)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    rank[n] = -1
    levels = [rank.astype(np.int32)]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 1
    while len(open_):
        own = sa[open_]
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[open_] = own
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        parted = open_[new]
        split[parted[split[parted] < 0]] = len(levels)
        first = np.flatnonzero(new)
        rank[own] = np.repeat(parted, np.diff(np.append(first, len(own))))
        open_ = open_[~(new & np.append(new[1:], True))]
        levels.append(rank.astype(np.int32))
        h *= 2
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        at = np.flatnonzero(split > k)
        a, b = sa[at - 1] + lcp[at], sa[at] + lcp[at]
        lcp[at] += (levels[k][a] == levels[k][b]).astype(np.int64) << k
    return sa, rank[:n], lcp


def splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, first, last) of the binary splits of all LCP intervals: places first .. k - 1 against k .. last."""
    n = len(lcp)
    at = np.flatnonzero(lcp)
    first, last = [0] * len(at), [0] * len(at)
    held: list[int] = []  # open splits, of rising depth
    depth, place = lcp[at].tolist(), at.tolist()
    before = base = -1
    for x, (d, k) in enumerate(zip(depth, place, strict=True)):
        if k != before + 1:
            for y in held:
                last[y] = before
            held, base = [], k - 1
        while held and depth[held[-1]] > d:
            y = held.pop()
            last[y] = before
        first[x] = place[held[-1]] if held else base
        held.append(x)
        before = k
    for y in held:
        last[y] = min(before, n - 1)
    return at, np.array(first, np.int64), np.array(last, np.int64)


def squares(s: np.ndarray, sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching squares that two more words to the left don't rule out as ends of long runs."""
    k, first, last = splits(lcp)
    depth = lcp[k]
    left = k - first <= last + 1 - k
    a, b = np.where(left, first, k), np.where(left, k, last + 1)  # the smaller side
    c, d = np.where(left, k, first), np.where(left, last + 1, k)  # the other one
    size = b - a
    ends = np.cumsum(size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    x = 0
    while x < len(k):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + TESTED, "right")))
        node = np.repeat(np.arange(x, y), size[x:y])
        begin = np.repeat(ends[x:y] - size[x:y], size[x:y])
        i = sa[a[node] + np.arange(len(node)) + (ends[x - 1] if x else 0) - begin]
        q = depth[node]
        for start, other in ((i, i + q), (i - q, i - q)):
            there = np.flatnonzero((other >= 0) & (other < len(s)))
            at, within = isa[other[there]], node[there]
            there = there[(at >= c[within]) & (at < d[within])]
            # of an end of a run of four periods, the word two periods before is the same; of one of period 1, four words
            start_, q_ = start[there], q[there]
            back = np.maximum(2 * q_, LEAST - 2 * q_)
            good = start_ >= back
            start_, q_, back = start_[good], q_[good], back[good]
            good = (s[start_ - 1] == s[start_ - 1 + q_]) & (s[start_ - back] == s[start_ - back + q_])
            found.append((start_[good], q_[good]))
        x = y
    return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def rotated(s: np.ndarray, start: int, q: int) -> int:
    """The first place to which a square of period q rotates."""
    size = 64
    while start > 0:
        a = max(0, start - size)
        differ = np.flatnonzero(s[a:start] != s[a + q : start + q])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, size = a, size * 2
    return start


def merged(s: np.ndarray, start: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that branching squares belong to, by start and period."""
    end = start + 2 * period
    order = np.lexsort((period, end))
    end, period = end[order], period[order]
    cuts = np.flatnonzero(np.diff(end)) + 1
    out = set()
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(end)], strict=True):
        if a == b:
            continue
        e, left = int(end[a]), period[a:b]
        while len(left):
            q = int(left[0])
            first = rotated(s, e - 2 * q, q)
            if e - first >= max(LEAST, TIMES * q):
                out.add((first, e - first, q))
            # squares of a multiple of the period in the same stretch are no runs of their own
            left = left[~((left % q == 0) & (e - 2 * left >= first))]
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as numbers of words below 2**31."""
    lengths = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not bounds[-1]:
        return out
    own = np.repeat(np.arange(len(texts)), lengths)
    s = (own << 31) | np.concatenate([np.array(t, np.int64) for t in texts])
    sa, isa, lcp = suffixes(s)
    least = np.zeros(len(texts), np.int64)
    np.maximum.at(least, own[sa], lcp)
    lcp[least[own[sa]] < LEAST - 1] = 0
    for run in merged(s, *squares(s, sa, isa, lcp)):
        k = int(own[run[0]])
        out[k].append((run[0] - int(bounds[k]), run[1], run[2]))
    return out


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The stated rewriting of a tenth of all texts: from some word on they repeat themselves; null ids are left alone."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def find(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (by start and period) and ``collapsed``, the text without repeated periods; ``rewrite`` changes words first."""
    prepare(docs.sparkSession)

    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers = []
        for words in texts:
            known: dict[bytes, int] = {}
            numbers.append([known.setdefault(w, len(known)) for w in words])
        runs = runs_of(numbers)
        flat = [r for own in runs for r in own]
        cuts = np.cumsum([0, *map(len, runs)])
        fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        held = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        collapsed = [b" ".join(kept(w, r)) for w, r in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), held, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes are split at ASCII white space, which is what separates words here
                words = (text.as_py() or "").encode().split()
                if rewrite:
                    words = rewrite(doc_id, words)
                if size and size + len(words) > BLOCK:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if ids:
                yield done(ids, texts)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, runs array<{RUN}>, collapsed string")


def strongest(runs):
    """The run of the greatest length / period, then of the smallest start and period (exact: products are compared)."""
    ahead = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | (
        (a["length"] * b["period"] == b["length"] * a["period"]) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"]))
    )
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, x: F.when(ahead(x, best), x).otherwise(best))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), periodic_tail).withColumn("top", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.expr("1000 * top.length div top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
