"""Encode whole texts by chunks that a tokenizer never looks across, each distinct chunk once.

Both vocabularies used here split a text before any blank or line feed that follows another character, and
what they make of a chunk does not depend on its left neighbour. So a text's ids are the ids of its chunks
in order, and the words of a corpus repeat enough for a dictionary of chunks to spare most of the work.
A text with any other white space is given to the tokenizer whole: there a run of mixed white space
may be cut elsewhere.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

#: A dictionary of more chunks than this is begun anew. It bounds a worker's memory and changes no result.
MAX_CHUNKS, MAX_WORDS = 500_000, 1_000_000
#: Characters of text that are looked up at a time.
SLICE_CHARS = 4_000_000

_chunk = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_other_space = re.compile(r"[^\S \n]")
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer in the file at ``path``, loaded once for each worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class ChunkEncoder:
    """Maps texts to lists of values, one for each chunk; ``value`` makes a chunk's value of its ids."""

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        self.path, self.value, self.known = path, value, {}

    def encode(self, texts: list[str | None]) -> Iterator[list[object]]:
        """One list for each text, in order; null and empty texts give an empty list."""
        for part in _slices(texts):
            cut = [[] if not t else [t] if _other_space.search(t) else _chunk.findall(t) for t in part]
            if len(self.known) > MAX_CHUNKS:
                self.known = {}
            new = set()
            for chunks in cut:
                new.update(chunks)
            new = list(new - self.known.keys())
            for lo in range(0, len(new), 20_000):
                some = new[lo : lo + 20_000]
                encoded = tokenizer(self.path).encode_batch_fast(some, add_special_tokens=False)
                self.known.update(zip(some, (self.value(e.ids) for e in encoded), strict=True))
            get = self.known.__getitem__
            for chunks in cut:
                yield list(map(get, chunks))


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if packed.itemsize != 4 or __import__("sys").byteorder != "little":
        return b"".join(i.to_bytes(4, "little") for i in ids)
    return packed.tobytes()


class WordEncoder(ChunkEncoder):
    """For vocabularies that drop white space: a text's ids are those of its words, packed as bytes.

    New words are encoded many at a time, with a separator between them whose id no word without that character has.
    """

    SEPARATOR, TOGETHER = "\0", 2_000

    def __init__(self, path: str):
        super().__init__(path, id_bytes)

    def encode(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        for part in _slices(texts):
            gc.disable()  # millions of new strings hold no cycles
            cut = [(t or "").replace("\n", " ").split(" ") for t in part]
            if len(self.known) > MAX_WORDS:
                self.known = {}
            new = set()
            for words in cut:
                new.update(words)
            self._learn(new - self.known.keys())
            gc.enable()
            get = self.known.__getitem__
            for words in cut:
                yield list(map(get, words))

    def _learn(self, new: set[str]) -> None:
        plain = [w for w in new if self.SEPARATOR not in w]
        vocabulary = tokenizer(self.path)
        between = vocabulary.encode(self.SEPARATOR, add_special_tokens=False).ids
        for lo in range(0, len(plain), self.TOGETHER):
            some = plain[lo : lo + self.TOGETHER]
            ids = np.array(vocabulary.encode_batch_fast([f" {self.SEPARATOR} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == between[0])).tolist()
            if len(between) != 1 or len(ends) != len(some) - 1:
                raise ValueError("the vocabulary does not keep the separator apart")
            packed = ids.tobytes()
            self.known.update((w, packed[a:b]) for w, a, b in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(packed)], strict=True))
        for w in new:
            if self.SEPARATOR in w:
                self.known[w] = id_bytes(vocabulary.encode(w, add_special_tokens=False).ids)


def drops_space_and_case(path: str) -> bool:
    """Whether the file normalises white space and case and keeps only what its pattern of words matches."""
    told = json.loads(Path(path).read_bytes())
    normalizers = (told.get("normalizer") or {}).get("normalizers", [])
    pre = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    lower = any(n.get("type") == "Lowercase" for n in normalizers)
    return lower and pre.get("type") == "Split" and pre.get("behavior") == "Removed" and bool(pre.get("invert"))


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """A worker's encoder for ``path``: kind ``count`` gives numbers of ids, ``bytes`` packed ids. It outlives tasks."""
    key = (path, kind)
    if key not in _encoders:
        words = kind == "bytes" and drops_space_and_case(path)
        _encoders[key] = WordEncoder(path) if words else ChunkEncoder(path, len if kind == "count" else id_bytes)
    return _encoders[key]
