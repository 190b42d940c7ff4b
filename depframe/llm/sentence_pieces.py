"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

The model file gives pieces, scores and normaliser settings. Pieces go into a double-array trie over their UTF-8 bytes: child
of node n by byte b is at base[n] + b, and check says whose child it is. The best path takes the highest sum of scores; on a tie
the piece that begins earliest. A character that no piece covers costs the least score less ``UNKNOWN_PENALTY`` and becomes byte pieces.

Pieces hold the white-space marker at their beginning only, so a text's best path is made of the best paths
of its marker-led chunks, and each distinct chunk is searched once. Texts are worked on one by one, long ones in blocks of
``BLOCK_CHUNKS`` chunks, so a worker holds little beside the model and its dictionary of chunks, which is bounded in bytes
(``KNOWN_BYTES``) and outlives tasks. The dictionary keeps ids as decimal text, from which arrays, digests and decoded texts are made.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import islice
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from depframe.llm import columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bounds of memory; neither changes a result.
KNOWN_BYTES, BLOCK_CHUNKS, BATCH_IDS = 160 << 20, 50_000, 2_000_000
#: What an entry of the dictionary takes beside its characters, about.
ENTRY_BYTES = 180
#: Fixed values. Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: integers, 4-byte strings of floats, or byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + n]
        at += n


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (-1: none) of a trie of ``words``; node 0 is the root."""
    tree: dict[int, dict] = {}
    ends: dict[int, int] = {}
    for word, value in words.items():
        node = tree
        for b in word:
            node = node.setdefault(b, {})
        ends[id(node)] = value
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    todo, free, wide = [(tree, 0)], 257, 257  # from here on every byte has room below
    check[0] = 0
    while todo:
        node, at = todo.pop()
        value[at] = ends.get(id(node), -1)
        if not node:
            continue
        keys = sorted(node)
        while check[free] >= 0:
            free += 1
        # Lone children fill the gaps; where many have no room, later ones don't look again.
        start, tries = max(1, (free if len(keys) == 1 else wide) - keys[0]), 0
        while any(check[start + k] >= 0 for k in keys):
            start, tries = start + 1, tries + 1
        if len(keys) > 1 and tries > 32:
            wide = start + keys[0]
        base[at] = start
        for k in keys:
            check[start + k] = at
            todo.append((node[k], start + k))
        if max(start, free, wide) + 1024 > len(check):
            for x, fill in ((base, 0), (check, -1), (value, -1)):
                x.extend([fill] * (1 << 16))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class PieceModel:
    """Pieces, scores and trie of a model; what tasks need is plain arrays, bounded by the vocabulary."""

    pieces: list[str]
    kinds: list[int]
    scores: np.ndarray
    dummy_prefix: bool
    squeeze: bool
    trie: tuple[np.ndarray, np.ndarray, np.ndarray]
    byte_ids: list[int]
    unknown: int
    name: str
    chunk: str
    _known: dict = field(default_factory=dict, repr=False)
    _before: dict = field(default_factory=dict, repr=False)
    _size: int = 0
    _lists: list = field(default_factory=list, repr=False)
    _written: dict = field(default_factory=dict, repr=False)
    _bytes: frozenset | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        settings = repr((self.pieces, self.kinds, self.dummy_prefix, self.squeeze, self.byte_ids, self.unknown, self.chunk)).encode()
        self.digest = hashlib.sha256(settings + np.asarray(self.scores, np.float64).tobytes()).digest()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        data = open(path, "rb").read()
        pieces, scores, kinds = [], [], []
        dummy, squeeze, charsmap = True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    piece = v.decode() if n == 1 else piece
                    score = struct.unpack("<f", v)[0] if n == 2 else score
                    kind = v if n == 3 else kind
                pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 3:
                for n, v in _fields(value):
                    dummy = bool(v) if n == 3 else dummy
                    squeeze = bool(v) if n == 4 else squeeze
                    charsmap = v if n == 2 else charsmap
        if charsmap:
            raise ValueError("a model with a character map is not supported")
        return cls.build(pieces, scores, kinds, dummy, squeeze, path)

    @classmethod
    def build(cls, pieces, scores, kinds, dummy_prefix=True, squeeze=False, name="") -> PieceModel:
        used = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (NORMAL, USER_DEFINED) and p}
        normal = [s for s, k in zip(scores, kinds) if k == NORMAL]
        high = max(normal, default=0.0)
        told = [len(p) * high - 0.1 if k == USER_DEFINED else s for p, s, k in zip(pieces, scores, kinds)]
        byte_ids = [-1] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        texts = [pieces[i] for i in used.values()]
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in texts)
        lines = any("\n" in p for p in texts)
        chunk = r"(?s).+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n"
        unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        return cls(list(pieces), list(kinds), np.array(told, np.float64), dummy_prefix, squeeze, double_array(used), byte_ids, unknown, f"{name}:{len(pieces)}", chunk)

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def best_path(self, data: bytes) -> list[int]:
        """Ids of the highest-scoring way to cut ``data``, UTF-8."""
        if not self._lists:
            self._lists = [x.tolist() for x in self.trie] + [self.scores.tolist(), float(min((s for s, k in zip(self.scores, self.kinds) if k == NORMAL), default=0.0))]
        base, check, value, scores, least = self._lists
        size, n = len(check), len(data)
        best, back, which = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here is None:
                continue
            first = data[s]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, single = 0, False
            for e in range(s, n):
                child = base[node] + data[e]
                if child >= size or check[child] != node or not child:
                    break
                node = child
                v = value[node]
                if v >= 0:
                    score = here + scores[v]
                    if best[e + 1] is None or score > best[e + 1]:
                        best[e + 1], back[e + 1], which[e + 1] = score, s, v
                    single = single or e + 1 == s + width
            if not single:
                score = here + least - UNKNOWN_PENALTY
                e = s + width
                if best[e] is None or score > best[e]:
                    best[e], back[e], which[e] = score, s, -1
        ids, at = [], n
        while at:
            s = back[at]
            if which[at] >= 0:
                ids.append(which[at])
            else:
                fallback = [self.byte_ids[b] for b in data[s:at]]
                ids.extend(reversed(fallback if min(fallback) >= 0 else [self.unknown]))
            at = s
        return ids[::-1]

    def blocks(self, text: str | None) -> Iterator[str]:
        """The ids of a text in decimal, joined by blanks, some thousands of chunks at a time; null counts as empty and has none."""
        text = text or ""
        if MARK in text or self.squeeze:
            pattern, text = self.chunk, self.normalised(text)
        else:  # blanks stand for markers, which keeps most of the dictionary's keys one byte a character
            pattern, text = self.chunk.replace(MARK, " "), (" " if self.dummy_prefix and text else "") + text
        chunks = iter(re.findall(pattern, text)) if len(text) < BLOCK_CHUNKS else (m[0] for m in re.finditer(pattern, text))
        while block := list(islice(chunks, BLOCK_CHUNKS)):
            if self._size > KNOWN_BYTES // 2:  # the last generation goes, what is still met moves over
                self._known, self._before, self._size = {}, self._known, 0
            known, before = self._known, self._before
            for chunk in {c for c in block if c not in known}:
                found = before.get(chunk)
                if found is None:
                    found = " ".join(map(str, self.best_path(chunk.replace(" ", MARK).encode())))
                known[chunk] = found
                self._size += len(chunk) + len(found) + ENTRY_BYTES
            yield " ".join(map(known.__getitem__, block))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        parts = [np.array(b.split(" "), np.int32) for b in self.blocks(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    @property
    def written(self) -> dict[str, bytes]:
        """What each id, in decimal, decodes to before markers become blanks."""
        if not self._written:
            for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
                byte = bytes([int(piece[3:5], 16)]) if kind == BYTE else b""
                self._written[str(i)] = {BYTE: byte, UNKNOWN: " ⁇ ".encode(), CONTROL: b""}.get(kind, piece.encode())
        return self._written

    def decoded_block(self, ids: Iterable[str], first: bool) -> str:
        text = b"".join(map(self.written.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if first and self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are put together, markers become blanks, the dummy prefix goes, control pieces are silent."""
        return self.decoded_block(map(str, ids), True)

    def digests(self, text: str | None) -> tuple[int, int, str, str, bool]:
        """Of one text: its ids, byte pieces among them, SHA-256 of the ids in decimal joined by blanks and of what they decode to, and whether that is the text."""
        text = text or ""
        said, read, n, n_bytes, at, same = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
        for i, block in enumerate(self.blocks(text)):
            ids = block.split(" ")
            n, n_bytes = n + len(ids), n_bytes + sum(map(self._byte_names.__contains__, ids))
            said.update((" " * (i > 0) + block).encode())
            back = self.decoded_block(ids, i == 0)
            same = same and text.startswith(back, at)
            at += len(back)
            read.update(back.encode())
        return n, n_bytes, said.hexdigest(), read.hexdigest(), same and at == len(text)

    @property
    def _byte_names(self) -> frozenset[str]:
        if self._bytes is None:
            self._bytes = frozenset(str(i) for i in self.byte_ids if i >= 0)
        return self._bytes


_models: dict[bytes, PieceModel] = {}


def _local(model: PieceModel) -> PieceModel:
    """The worker's own copy, whose dictionary outlives tasks."""
    return _models.setdefault(model.digest, model)


def _appended(df: DataFrame, model: PieceModel, column: str, make, fields: list[str]) -> DataFrame:
    """``df`` with the columns ``fields``; ``make`` yields one tuple of them, or one value, with its size for each value of ``column``."""
    names = [f.split("`")[1] for f in fields]
    keep = [c for c in df.columns if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary: about 2 MB
    inner = columns.inner(keep)
    rows = df.select(*columns.carried(keep))
    schema = ", ".join(columns.fields(rows) + fields)
    made_of = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    kinds = [made_of[f.split("` ")[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _local(shared.value)
        for batch in batches:
            made, size, lo = [], 0, 0
            for i, value in enumerate(batch.column(inner[keep.index(column)])):
                row, cost = make(m, value)
                made.append(row)
                size += cost
                if size >= BATCH_IDS or i + 1 == batch.num_rows:
                    part = batch.slice(lo, len(made))
                    new = {n: pa.array([r[j] for r in made], k) for j, (n, k) in enumerate(zip(names, kinds, strict=True))}
                    yield pa.RecordBatch.from_pydict({c: part.column(c) for c in inner} | new)
                    made, size, lo = [], 0, i + 1

    return rows.mapInArrow(run, schema).toDF(*keep, *names)


def encode_column(df: DataFrame, model: PieceModel, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with ``name``, the ids of each whole text. Null and empty texts have no ids; a column ``name`` is replaced (``text`` must be another)."""

    def make(m: PieceModel, value: pa.Scalar) -> tuple:
        ids = m.encode(value.as_py())
        return (ids,), len(ids)

    return _appended(df, model, text, make, [f"`{name}` array<int>"])


def decode_column(df: DataFrame, model: PieceModel, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with ``name``, the text of each list of ids; null counts as none and gives the empty text."""

    def make(m: PieceModel, value: pa.Scalar) -> tuple:
        found = value.values.to_numpy(zero_copy_only=False) if value.is_valid else ()
        return (m.decode(found),), len(found)

    return _appended(df, model, ids, make, [f"`{name}` string"])


def digest_columns(df: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``df`` with n_ids, n_byte_ids, ids_sha256 (decimal, joined by blanks), decoded_sha256 and round_trip of each whole text, encoded and decoded in one pass.

    Null and empty texts have no ids and decode to the empty text. Columns of the new names are replaced.
    """
    fields = ["`n_ids` long", "`n_byte_ids` long", "`ids_sha256` string", "`decoded_sha256` string", "`round_trip` boolean"]
    return _appended(df, model, text, lambda m, value: (m.digests(value.as_py()), 1), fields)
