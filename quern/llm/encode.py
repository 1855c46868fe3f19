"""Token ids of whole texts with the tokenizers library, remembered by piece.

Byte-level BPE never merges across the edges of its pre-tokens, and in a text of Latin letters, digits and marks whose
white space is single blanks and line feeds these edges follow from the classes of the characters. So texts of that form
are cut there, each distinct piece is encoded by the library once a worker, and the ids are joined; any other text is
encoded as a whole. The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` either way
(tests compare them): a text that holds the string of an added token (``<|endoftext|>``) is encoded whole, and so is every
text if the vocabulary's pre-tokenizer isn't the one whose edges PIECE states.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts with other characters are encoded whole, and so are those with two white-space characters in a row or one at an end.
OTHER = re.compile(r"[^\n\x20-\x7eÀ-ɏ‘’“”–—…€«»¡¿°]")
#: The pre-tokens of the other texts.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\n")
#: Pieces remembered in each of two generations; what the newer one lacks is looked up, and moved up, from the older.
GENERATION = 350_000
JOINED = 64


def regular(text: str) -> bool:
    """Whether the edges of a text's pre-tokens follow from PIECE."""
    return not (
        text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or OTHER.search(text)
    )


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level(tokenizer) -> bool:
    """Whether a vocabulary's texts are cut as PIECE says, and a line feed is one id."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    state = json.loads(tokenizer.pre_tokenizer.__getstate__())
    return state.get("type") == "ByteLevel" and bool(state.get("use_regex")) and not state.get("add_prefix_space") and len(tokenizer.encode("\n", add_special_tokens=False).ids) == 1


class Encoder:
    """Encodes lists of texts to little-endian ids, two bytes an id where the vocabulary allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = byte_level(self.tokenizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0] if self.cuts else None

    def whole(self, text: str) -> bool:
        """Whether a text must not be cut into pieces."""
        return not self.cuts or not regular(text) or any(m in text for m in self.marks)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Encodes runs of letters, many in one text: a line feed between them has one id that none of them holds."""
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        size = self.dtype.itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            data, cut = ids.tobytes(), (np.flatnonzero(ids == self.feed) * size).tolist()
            for word, a, b in zip(group, [-size, *cut], [*cut, len(data)], strict=True):
                self.pieces[word] = data[a + size : b]

    def _learn(self, pieces: set[str]) -> None:
        """Encodes, or moves up from the older generation, pieces that the newer one lacks."""
        if len(self.pieces) + len(pieces) > GENERATION:
            self.older, self.pieces = self.pieces, {}
        known = pieces & self.older.keys()
        self.pieces.update((p, self.older[p]) for p in known)
        missing = pieces - known
        letters = [p for p in missing if p[-1].isalpha() and p[0] != "'"]
        others = [p for p in missing if not (p[-1].isalpha() and p[0] != "'")]
        self._words(letters)
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            self.pieces.update(zip(part, self._whole(part), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        collecting = gc.isenabled()
        gc.disable()  # millions of short strings, none in a cycle
        try:
            odd = [k for k, t in enumerate(texts) if self.whole(t)]
            out: list = [b""] * len(texts)
            for k, ids in zip(odd, self._whole([texts[k] for k in odd]), strict=True):
                out[k] = ids
            skip, get, open_, need = set(odd), self.pieces.get, [], set()
            for k, t in enumerate(texts):
                if k in skip or not t:
                    continue
                parts = PIECE.findall(t)
                ids = list(map(get, parts))
                if None in ids:
                    gaps = [i for i, x in enumerate(ids) if x is None]
                    need.update([parts[i] for i in gaps])
                    open_.append((k, ids, [(i, parts[i]) for i in gaps]))
                else:
                    out[k] = b"".join(ids)
            self._learn(need)
            for k, ids, gaps in open_:
                for i, piece in gaps:
                    ids[i] = self.pieces[piece]
                out[k] = b"".join(ids)
            return out
        finally:
            if collecting:
                gc.enable()


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def forget() -> None:
    """Gives back what this worker remembers: workers are used again by stages that need their memory for other things."""
    _kept.clear()
    release()


def release() -> None:
    """Returns freed memory to the system, where the allocators allow it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some rows, with freed memory given back between them."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
            release()


def batches_of(texts: list[str], chars: int = 1 << 18):
    """Index ranges of consecutive texts of about ``chars`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
