"""Best-fit packing by a grouping genetic algorithm: whole well-filled bins are what parents pass on.

A document's ids (word-level vocabulary, each document ends with the id 0) are one piece, or pieces of ``LENGTH`` if there are
more. Full pieces are sequences of their own. The others are dealt by number to shards of about ``SHARD`` pieces, each
of which is evolved on ``ISLANDS`` islands from best-fit decreasing and shaken variants of it. A crossover injects a share of
one parent's well-filled bins whole, removes the other's bins that hold any of the same pieces, and best-fits the pieces
displaced by that, longest first; a mutation empties some of the worst bins. After each epoch an island's elite moves on to the
next island (an equi-join of the written states), and shards whose best packing meets the lower bound of Martello and Toth
leave. Bins that stay loose (under ``LOOSE``) give their pieces back, which are dealt to new shards, as long as that frees bins.

A task holds one shard at a time, at most a few thousand numbers; texts and ids don't leave the task that encodes them.

Edge cases: a null or empty text is the id 0 alone; very long texts are whole pieces and a rest; null ids, ties and repeated
rows are dealt by the place of the row, so that copies don't meet in one shard; an empty table gives an empty result; other
columns are ignored. ``keep_ids`` adds the ids of each piece as bytes.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import encode
from quern.llm.encode import JOINED, Encoder, batches_of, release, slices, vocabulary_path
from quern.session import materialise, prepare, table

LENGTH, END = 2048, 0
SHARD, ISLANDS, EPOCHS, LEVELS = 2048, 3, 3, 4
POPULATION, CHILDREN, ELITES = 6, 18, 2
#: Bins under this share of ``LENGTH`` give their pieces back.
LOOSE = 0.97
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, serial bigint"

#: Texts with other characters are encoded whole (İ has a lower case of two characters).
OTHER = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ‘’“”–—…€«»¡¿°]")
#: The pre-tokens of the other texts in lower case, fixed by the vocabulary.
PIECE = re.compile(r"[a-zß-öø-ɏ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ɏ]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder(Encoder):
    """Ids of a vocabulary whose pre-tokens are words without their white space, remembered by word.

    A text of the characters that ``OTHER`` leaves is cut as ``PATTERN`` says, in lower case; other texts, texts with the
    string of an added token, and all texts of other vocabularies are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        state = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (state["normalizer"] or {}).get("normalizers", [])]
        parts = (state["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        split, suffix = parts[0], state["model"].get("end_of_word_suffix")
        self.cuts = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and bool(split.get("invert")) and bool(suffix)
        if self.cuts:
            # the same model for words that are cut already; a word's last id says that it is the last
            bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *parts[1:]]}
            self.bare = type(self.tokenizer).from_str(json.dumps(state | {"normalizer": None, "pre_tokenizer": bare, "added_tokens": []}))
            self.last = np.zeros(self.bare.get_vocab_size(), bool)
            self.last[[k for token, k in self.bare.get_vocab().items() if token.endswith(suffix)]] = True

    def whole(self, text: str) -> bool:
        return not self.cuts or bool(OTHER.search(text)) or any(m in text for m in self.marks)

    def _learn(self, pieces: set[str]) -> None:
        if len(self.pieces) + len(pieces) > encode.GENERATION:
            self.older, self.pieces = self.pieces, {}
        known = pieces & self.older.keys()
        self.pieces.update((p, self.older[p]) for p in known)
        missing = list(pieces - known)
        groups = [missing[k : k + JOINED] for k in range(0, len(missing), JOINED)]
        for k in range(0, len(groups), JOINED):
            some = groups[k : k + JOINED]
            for group, e in zip(some, self.bare.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                self.pieces.update((word, ids[x:y].tobytes()) for word, x, y in zip(group, [0, *ends], ends, strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.whole(t) else PIECE.findall(t.lower()) for t in texts]
        whole = iter(self._whole([t for t, parts in zip(texts, cut, strict=True) if parts is None]))
        found = [None if parts is None else list(map(self.pieces.get, parts)) for parts in cut]
        open_ = [k for k, ids in enumerate(found) if ids and None in ids]
        self._learn({p for k in open_ for p, x in zip(cut[k], found[k], strict=True) if x is None})
        for k in open_:
            found[k] = [self.pieces[p] if x is None else x for p, x in zip(cut[k], found[k], strict=True)]
        return [next(whole) if ids is None else b"".join(ids) for ids in found]


def bound(sizes: list[int], length: int = LENGTH) -> int:
    """A number of bins that no packing goes below: that of Martello and Toth over all thresholds."""
    x = np.sort(np.array(sizes, np.int64))
    if not len(x):
        return 0
    total = np.concatenate([[0], np.cumsum(x)])
    half = int(np.searchsorted(x, length // 2, "right"))  # from here on no two fit together
    alone = len(x) - half
    a = np.unique(np.concatenate([[0], x[:half]]))
    low = np.searchsorted(x, a, "left")
    top = np.maximum(half, np.searchsorted(x, length - a, "right"))
    room = (top - half) * length - (total[top] - total[half])
    return int(max(-(-int(total[-1]) // length), alone + np.maximum(0, -(-(total[half] - total[low] - room) // length)).max()))


class Shard:
    """Packings of one shard's pieces; a packing is the number of its bin for each piece, pieces by falling length."""

    def __init__(self, sizes: list[int], length: int, seed: int):
        self.sizes, self.length, self.rng = sizes, length, random.Random(seed)
        self.weights = np.array(sizes, np.int64)
        self.least = bound(sizes, length)

    def fit(self, bins: list[int], fills: list[int], items: list[int]) -> None:
        """Puts ``items`` into the fullest bins that take them, in the order given; new bins where none does."""
        by_room: dict[int, list[int]] = {}
        rooms = 0  # a bit for each room that some bin has
        for b, fill in enumerate(fills):
            if room := self.length - fill:
                by_room.setdefault(room, []).append(b)
                rooms |= 1 << room
        for i in items:
            size = self.sizes[i]
            if fitting := rooms >> size:
                room = size + (fitting & -fitting).bit_length() - 1
                own = by_room[room]
                b = own.pop()
                if not own:
                    rooms ^= 1 << room
            else:
                b, room = len(fills), self.length
                fills.append(0)
            bins[i] = b
            fills[b] += size
            if room := room - size:
                if not (own := by_room.setdefault(room, [])):
                    rooms |= 1 << room
                own.append(b)

    def packed(self, order: list[int]) -> np.ndarray:
        bins, fills = [0] * len(self.sizes), []
        self.fit(bins, fills, order)
        return np.array(bins, np.int16)

    def shaken(self) -> np.ndarray:
        """Best fit in an order of roughly falling lengths."""
        spread = self.rng.choice((0.05, 0.15, 0.4))
        key = [s * (1 + spread * self.rng.random()) for s in self.sizes]
        return self.packed(sorted(range(len(key)), key=lambda i: -key[i]))

    def refit(self, bins: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """A packing of the bins that ``keep`` marks for each piece; the pieces of the others are placed anew."""
        out = np.full(len(bins), -1, np.int64)
        _, out[keep] = np.unique(bins[keep], return_inverse=True)
        fills = np.bincount(out[keep], self.weights[keep]).astype(np.int64).tolist() if keep.any() else []
        packing = out.tolist()
        self.fit(packing, fills, np.flatnonzero(~keep).tolist())
        return np.array(packing, np.int16)

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` with some well-filled bins of ``b``: its bins that share pieces with them dissolve."""
        fills = np.bincount(b, self.weights)
        good = np.argsort(-fills, kind="stable")[: max(1, len(fills) * 3 // 4)].tolist()
        chosen = np.zeros(len(fills), bool)
        chosen[self.rng.sample(good, max(1, int(len(good) * self.rng.uniform(0.05, 0.4))))] = True
        injected = chosen[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[injected]] = True
        # numbers of the injected bins follow those of the first parent
        both = np.where(injected, b.astype(np.int64) + len(hit), a)
        return self.refit(both, injected | ~hit[a])

    def changed(self, a: np.ndarray) -> np.ndarray:
        """``a`` without some of its worst bins and some others, whose pieces are placed anew."""
        fills = np.bincount(a, self.weights)
        gone = np.zeros(len(fills), bool)
        gone[np.argsort(fills, kind="stable")[: self.rng.randint(1, max(1, len(fills) // 20))]] = True
        gone[self.rng.sample(range(len(fills)), max(1, len(fills) // 20))] = True
        return self.refit(a, ~gone[a])

    def worth(self, a: np.ndarray) -> tuple[int, float]:
        """Bins, then the want of full ones (the mean square of the fills): less is better."""
        fills = np.bincount(a, self.weights)
        return len(fills), -float(np.mean((fills / self.length) ** 2))

    def evolved(self, guests: list[np.ndarray]) -> list[np.ndarray]:
        """The elite after one epoch that starts with ``guests``, or with best fit where there are none."""
        n = len(self.sizes)
        best = [(self.worth(g), k, g) for k, g in enumerate(guests or [self.packed(list(range(n)))])]
        if min(best)[0][0] > self.least:
            while len(best) < POPULATION:
                x = self.shaken()
                best.append((self.worth(x), len(best), x))
            for k in range(CHILDREN):
                a, b = (min(self.rng.sample(best, 2), key=lambda x: x[:2])[2] for _ in range(2))
                x = self.crossed(a, b)
                if k % 3 == 2:
                    x = self.changed(x)
                best = sorted([*best, (self.worth(x), POPULATION + k, x)], key=lambda x: x[:2])[:POPULATION]
                if best[0][0][0] <= self.least:
                    break
        return [x for _, _, x in sorted(best, key=lambda x: x[:2])[:ELITES]]


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row's ids with a number (serial) of their own; consume it once, as a written table."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.setdefault(path, WordEncoder(path)) if path not in _encoders else _encoders[path]
        serial = TaskContext.get().partitionId() << 40
        last = np.array([end], enc.dtype).tobytes()
        for batch in slices(batches, 2000):
            ids = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in batches_of(texts):
                rows, blobs = [], []
                for doc_id, data in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    own = np.frombuffer(data + last, enc.dtype).astype("<u4")
                    for k, start in enumerate(range(0, len(own), length)):
                        part = own[start : start + length].tobytes()
                        rows.append((doc_id, k, start, len(part) // 4, zlib.crc32(part), serial))
                        serial += 1
                        if keep_ids:
                            blobs.append(part)
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "serial"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(blobs, pa.binary())] if keep_ids else arrays, names=[*names, "ids"] if keep_ids else names)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


STATE = "shard bigint, island int, sizes array<int>, bins int, least int, worth double, elite array<binary>"


def epoch(rows: DataFrame, number: int, length: int) -> DataFrame:
    """One epoch of each island: ``rows`` are (shard, island, sizes, elite, guest), the last two null at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for r in batch.to_pylist():
                own = Shard(r["sizes"], length, zlib.crc32(b"%d %d %d" % (r["shard"], r["island"], number)))
                guests = [np.frombuffer(x, np.int16) for x in (r["elite"] or []) + (r["guest"] or [])]
                elite = own.evolved(guests)
                bins, want = own.worth(elite[0])
                out.append((r["shard"], r["island"], r["sizes"], bins, own.least, want, [x.tobytes() for x in elite]))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "island", "sizes", "bins", "least", "worth", "elite"])

    return rows.select("shard", "island", "sizes", "elite", "guest").mapInArrow(run, STATE)


def evolve(shards: DataFrame, length: int = LENGTH, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(shard, elite, bins, least) of each of ``shards`` (shard, sizes): the best packing of all islands, as bytes of int16."""
    none = F.lit(None).cast("array<binary>")
    start = shards.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), none.alias("elite"), none.alias("guest"))
    state, done = materialise(epoch(start.repartition("shard", "island"), 0, length), "islands"), []
    best = F.min_by(F.struct(F.col("elite")[0].alias("elite"), "bins", "least"), F.struct("bins", "worth", "island")).alias("b")
    for number in range(1, epochs):
        settled = state.groupBy("shard").agg(best, F.min("bins").alias("_bins"), F.min("least").alias("_least"))
        settled = materialise(settled, "best-packings")
        done.append(settled.where("_bins <= _least").select("shard", "b.*"))
        open_ = settled.where("_bins > _least").select("shard")
        left = state.join(open_, "shard", "left_semi")
        # the elite of an island goes to the next one
        moved = left.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("guest"))
        state = materialise(epoch(left.join(moved, ["shard", "island"]), number, length), "islands")
    done.append(state.groupBy("shard").agg(best).select("shard", "b.*"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def placed(rows: DataFrame, length: int) -> DataFrame:
    """(serial, shard, bin, at, fill) of the pieces of packed shards (shard, serials, sizes, elite)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                bins, sizes = np.frombuffer(r["elite"], np.int16).astype(np.int64), np.array(r["sizes"], np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                fills = np.bincount(bins, sizes).astype(np.int64)
                at = np.empty(len(bins), np.int64)
                at[order] = before - (np.cumsum(fills) - fills)[bins[order]]
                n = len(bins)
                yield pa.RecordBatch.from_arrays([pa.array(r["serials"], pa.int64()), pa.array([r["shard"]] * n, pa.int64()), pa.array(bins), pa.array(at), pa.array(fills[bins])], names=["serial", "shard", "bin", "at", "fill"])

    return rows.select("shard", "serials", "sizes", "elite").mapInArrow(run, "serial bigint, shard bigint, bin bigint, at bigint, fill bigint")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, shard: int = SHARD, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    if not 0 < length < 1 << 15 or not 0 < shard < 1 << 14:
        raise ValueError("length below 32768 and shard below 16384 are supported")
    held = materialise(pieces(docs, path or vocabulary_path("word_bpe_49k.json"), length, keep_ids=keep_ids), "pieces")
    loose = held.where(F.col("length") < length).select("serial", "length")
    n, done = loose.count(), []
    for level in range(LEVELS):
        shards = max(1, -(-n // shard))
        # the place of a row is hashed, so a shard has about as many pieces as asked whatever the documents are
        one = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("x"), "serial"))).alias("items")
        dealt = loose.groupBy(F.pmod(F.xxhash64(F.lit(level), F.col("serial")), F.lit(shards)).alias("shard")).agg(one)
        dealt = materialise(dealt.select("shard", F.transform("items", lambda i: (-i["x"]).cast("int")).alias("sizes"), F.col("items.serial").alias("serials")), "shards")
        best = evolve(dealt.select("shard", "sizes"), length)
        found = materialise(placed(dealt.join(best.select("shard", "elite"), "shard"), length).withColumn("level", F.lit(level)), "placed")
        back = found.where(F.col("fill") < LOOSE * length)
        m = back.count() if shards > 1 and level < LEVELS - 1 else 0
        # pieces are given back as long as some shards can be made of them, fewer than now
        if not m or -(-m // shard) >= shards:
            done.append(found)
            break
        done.append(found.where(F.col("fill") >= LOOSE * length))
        loose, n = materialise(held.select("serial", "length").join(back.select("serial"), "serial", "left_semi"), "given-back"), m
    places = done[0]
    for d in done[1:]:
        places = places.unionByName(d)
    number = (F.col("level") * F.lit(1 << 60) + F.col("shard") * F.lit(1 << 15) + F.col("bin")).alias("sequence_id")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    full = held.where(F.col("length") == length).select(*columns, (-1 - F.col("serial")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return held.where(F.col("length") < length).join(places.select("serial", number, F.col("at").alias("offset")), "serial").select(*columns, "sequence_id", "offset").unionByName(full)


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
