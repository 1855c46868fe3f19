"""Word statistics and hashed word and character n-grams of many texts at once, as numpy arrays.

All functions take a list of whole texts; ``chunks`` cuts a batch into lists of a few million characters, so that memory
follows the longest text and not the batch. Hashes are polynomial prefix sums modulo 2**64, so a window's hash costs two
look-ups whatever its length. Counts don't rest on hashes: what has one hash is compared character by character, and a text
in which unequal stretches share a hash is counted plainly (``plain_dup_lines``, ``plain_repeated``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np

BITS = 18
CHUNK_CHARS = 1 << 19
SYMBOLS = "#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Kinds of grams: words, pairs of words, three and four characters.
KINDS = 4
DENSE = 9

_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n; kept between calls up to a chunk's size."""
    if _powers["n"] < n + 1:
        size = max(n + 1, CHUNK_CHARS + 1)
        made = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * CHUNK_CHARS:
            return made[0], made[1]
        _powers.update(n=size, up=made[0], down=made[1])
    return _powers["up"], _powers["down"]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive lists of whole texts of about CHUNK_CHARS characters; a longer text stands alone."""
    now, size = [], 0
    for text in texts:
        if now and size + len(text) > CHUNK_CHARS:
            yield now
            now, size = [], 0
        now.append(text)
        size += len(text)
    if now:
        yield now


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def plain_repeated(text: str, size: int) -> int:
    """Words in windows of ``size`` words that stand twice or more in the text."""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
    n = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(size)})


class Scan:
    """Code points, words and prefix hashes of a list of texts."""

    def __init__(self, texts: list[str]):
        self.n, self.texts = len(texts), texts
        self.lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.cp = cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.lens)])
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), self.lens)
        self.solid = solid = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
        edge = np.zeros(len(cp) + 1, bool)
        edge[self.first] = True
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(cp):
            before[0], before[1:], after[-1], after[:-1] = False, solid[:-1], False, solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.word_doc = self.doc[self.starts]
        self.up, self.down = powers(len(cp))
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        self.prefix = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mixed * self.up[: len(cp)], out=self.prefix[1:])
        self.words = self.span(self.starts, self.ends)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the code points in [start, end)."""
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def unequal(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Whether the code points in [a, a_end) and [b, b_end) differ, for arrays of stretches; ``most`` at a time."""
        n, out = a_end - a, (a_end - a) != (b_end - b)
        total = np.cumsum(np.where(out, 0, n))
        for part in np.split(np.arange(len(n)), np.searchsorted(total, np.arange(most, int(total[-1]) if len(n) else 0, most))):
            part = part[~out[part]]
            if not len(part):
                continue
            size = n[part]
            of = np.repeat(np.arange(len(part)), size)
            step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            differ = self.cp[a[part][of] + step] != self.cp[b[part][of] + step]
            out[part] = np.bincount(of, differ, minlength=len(part)) > 0
        return out

    def per_doc(self, docs: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(docs, weights=weights, minlength=self.n)

    def base(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
        table = np.zeros(128, bool)
        table[[ord(x) for x in SYMBOLS]] = True
        return {
            "n_words": self.per_doc(self.word_doc),
            "word_chars": self.per_doc(self.word_doc, self.ends - self.starts).astype(np.int64),
            "n_symbols": self.per_doc(self.doc[table[np.minimum(self.cp, 127)]]),
            "n_dup_lines": self._dup_lines(),
            "n_repeat_words": self._repeated(8),
        }

    def _dup_lines(self) -> np.ndarray:
        cuts, some = np.flatnonzero(self.cp == 10), self.lens > 0
        # in order, the k-th start and the k-th end are those of the k-th line
        start = np.sort(np.concatenate([self.first[:-1][some], cuts + 1]))
        end = np.sort(np.concatenate([cuts, self.first[1:][some]]))
        words = np.concatenate([[0], np.cumsum(self.solid)])
        some = words[end] > words[start]
        start, end = start[some], end[some]
        doc = self.doc[start]
        key = (self.span(start, end) + (end - start).astype(np.uint64) * MIX) ^ (doc.astype(np.uint64) * BASE)
        order = np.lexsort((key, doc))
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        found, one, two = self.per_doc(doc[order][1:][same]), order[:-1][same], order[1:][same]
        for k in np.unique(doc[two[self.unequal(start[one], end[one], start[two], end[two])]]).tolist():
            found[k] = plain_dup_lines(self.texts[k])
        return found

    def _repeated(self, size: int) -> np.ndarray:
        n = len(self.words)
        if n < size:
            return np.zeros(self.n, np.int64)
        last = n - size + 1
        key = np.zeros(last, np.uint64)
        for k in range(size):
            key = key * BASE + (self.words[k : k + last] ^ (self.words[k : k + last] >> np.uint64(31)))
        key = key * MIX + self.word_doc[:last].astype(np.uint64) * BASE
        inside = self.word_doc[:last] == self.word_doc[size - 1 :]
        at = np.flatnonzero(inside)
        key = key[at]
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return np.zeros(self.n, np.int64)
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        mine = twice[place] == key
        hit, place = at[mine], place[mine]
        cover = np.bincount(hit, minlength=n + size) - np.bincount(hit + size, minlength=n + size)
        found = self.per_doc(self.word_doc[np.cumsum(cover)[:n] > 0])
        order = np.argsort(place, kind="stable")
        next_to = place[order][1:] == place[order][:-1]
        one, two = hit[order][:-1][next_to], hit[order][1:][next_to]
        wrong = self.word_doc[one] != self.word_doc[two]
        for k in range(size):
            rest = ~wrong
            wrong[rest] = self.unequal(self.starts[one[rest] + k], self.ends[one[rest] + k], self.starts[two[rest] + k], self.ends[two[rest] + k])
        for k in np.unique(np.concatenate([self.word_doc[one[wrong]], self.word_doc[two[wrong]]])).tolist():
            found[k] = plain_repeated(self.texts[k], size)
        return found

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of gram its buckets and the texts they stand in, in text order."""
        shift = np.uint64(64 - BITS)
        words = (self.words ^ (self.words >> np.uint64(32))) * MIX
        yield ((words * BASE) >> shift).astype(np.int32), self.word_doc
        if len(words) > 1:
            pair = (words[:-1] * np.uint64(3) + words[1:]) * BASE
            same = self.word_doc[:-1] == self.word_doc[1:]
            yield (pair >> shift).astype(np.int32)[same], self.word_doc[1:][same]
        else:
            yield np.zeros(0, np.int32), np.zeros(0, np.int32)
        for size in (3, 4):
            last = len(self.cp) - size + 1
            if last < 1:
                yield np.zeros(0, np.int32), np.zeros(0, np.int32)
                continue
            at = (self.prefix[size:] - self.prefix[:last]) * self.down[:last]
            at ^= at >> np.uint64(32)
            at *= np.uint64(int(MIX) * (2 * size + 1) & (1 << 64) - 1)
            same = self.doc[:last] == self.doc[size - 1 :]
            yield (at >> shift).astype(np.int32)[same], self.doc[:last][same]

    def dense(self, base: dict[str, np.ndarray]) -> np.ndarray:
        """Shares that n-grams cannot show: symbols, repeats, duplicate lines, case, digits, distinct words, lengths, stutter."""
        n, chars = np.maximum(base["n_words"], 1), np.maximum(self.lens, 1)
        cp = self.cp
        key = np.unique((self.words >> np.uint64(24)) | (self.word_doc.astype(np.uint64) << np.uint64(40)))
        distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=self.n)[: self.n]
        again = (self.words[1:] == self.words[:-1]) & (self.word_doc[1:] == self.word_doc[:-1])
        out = np.stack([
            base["n_symbols"] / n, base["n_repeat_words"] / n, base["n_dup_lines"] / n,
            self.per_doc(self.doc[(cp >= 65) & (cp <= 90)]) / chars, self.per_doc(self.doc[(cp >= 48) & (cp <= 57)]) / chars,
            distinct / n, np.log1p(base["n_words"]) / 10, np.minimum(base["word_chars"] / n, 40) / 10, self.per_doc(self.word_doc[1:][again]) / n,
        ], axis=1)
        return np.clip(out, 0, 4)


def scores(scan: Scan, weights: np.ndarray) -> np.ndarray:
    """For each text the sum over kinds of the mean weight of its grams."""
    total = np.zeros(scan.n)
    for kind, (bucket, doc) in enumerate(scan.grams()):
        n = np.maximum(scan.per_doc(doc), 1)
        total += scan.per_doc(doc, weights[kind][bucket]) / n
    return total


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the texts' gram shares (column: kind << BITS | bucket), and the dense features."""
    rows, cols, values, dense, at = [], [], [], [], 0
    for part in chunks(texts):
        scan = Scan(part)
        for kind, (bucket, doc) in enumerate(scan.grams()):
            key, n = np.unique((doc.astype(np.int64) << BITS) | bucket, return_counts=True)
            of = key >> BITS
            rows.append((of + at).astype(np.uint16 if len(texts) < 1 << 16 else np.int32))
            cols.append(((key & ((1 << BITS) - 1)) | (kind << BITS)).astype(np.int32))
            values.append((n / np.maximum(scan.per_doc(doc), 1)[of]).astype(np.float32))
        dense.append(scan.dense(scan.base()))
        at += scan.n
    if not dense:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, DENSE))
    joined = []
    for parts in (rows, cols, values, dense):  # one at a time, so that what is joined needn't be held twice
        joined.append(np.concatenate(parts))
        parts.clear()
    return tuple(joined)


def compact(cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns in use, and each entry's place among them; no sort of the entries."""
    seen = np.zeros(KINDS << BITS, bool)
    seen[cols] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[cols]


def product(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sparse matrix times x, in slices, so that no array of doubles is as long as the entries."""
    out, x = np.zeros(n), x.astype(np.float32)
    for k in range(0, len(rows), 1 << 20):
        part = slice(k, k + (1 << 20))
        out += np.bincount(rows[part], values[part] * x[cols[part]], minlength=n)
    return out


def transposed(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The transposed matrix times y."""
    out, y = np.zeros(n), y.astype(np.float32)
    for k in range(0, len(rows), 1 << 20):
        part = slice(k, k + (1 << 20))
        out += np.bincount(cols[part], values[part] * y[rows[part]], minlength=n)
    return out


def minimise(f, x: np.ndarray, steps: int = 30, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``f`` returns value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            q += (a - r * (y @ q)) * s
        slope, step = -(grad @ q), 1.0 if past else 1.0 / max(1e-12, float(np.abs(grad).max()))
        if slope > -1e-12:
            break
        for _ in range(20):
            new_value, new_grad = f(x - step * q)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-7 * max(1, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x
