"""Byte-level BPE encoding by a dynamic program over prefixes, and decoding.

Every prefix of a piece has one encoding, so one last token. A token that
ends a prefix is that last token if and only if it follows the last token of
the prefix before it in the encoding of their two byte strings alone: an
encoding is valid when all its neighbours are. One token per byte therefore
holds the encodings of all prefixes: walking back from any byte gives one.
More bytes at the end extend the table, and an edit leaves the table before
it as it is (``PrefixText``).

The vocabulary is a rank file (base64 of a token's bytes, blank, rank). It is
read where the job is written and broadcast: its size is that of the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._text import text_groups

REACH = 2  # characters after a match that it may depend on
SLICE = 1 << 20  # characters of a text that are split at a time
KEPT = 250_000  # short pieces and pairs whose results a task keeps; beyond, it starts over
SHORT = 64
MOST_BYTES = 1 << 28  # of a rank file


class _Kept(dict):
    """Results by key, made where missing; starts over when full."""

    def __init__(self, made, most: int = KEPT):
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.made(key)
        return value


LETTER, NUMBER = r"\p{L}", r"\p{N}"


@lru_cache(2)
def newer_characters() -> dict[str, str]:
    r"""The letters (``\p{L}``) and numbers (``\p{N}``) of a Unicode version
    newer than the tokenizer library's, which are neither there. Which these
    are, the library says."""
    every, found = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF), {}
    for kind in (LETTER, NUMBER):
        library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        known = set(bytes(library.encode_ordinary(every)).decode())
        found[kind] = "".join(c for c in regex.findall(kind, every) if c not in known)
    return found


def library_pattern(pattern: str) -> str:
    """``pattern`` for the regex module without the newer characters."""
    for kind, newer in newer_characters().items():
        if newer:
            points = np.array([ord(c) for c in newer])
            runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
            pattern = pattern.replace(kind, f"[{kind}--[{''.join(rf'\U{r[0]:08X}-\U{r[-1]:08X}' for r in runs)}]]")
    return pattern


def ascii_pattern(pattern: str) -> re.Pattern | regex.Pattern:
    """The same matches in ASCII texts, by Python's own faster module where
    it knows all that is left of the pattern."""
    inside, out = False, []
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, flags=regex.DOTALL):
        if part in (LETTER, NUMBER):
            part = {LETTER: "A-Za-z", NUMBER: "0-9"}[part]
            part = part if inside else f"[{part}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    plain = "".join(out)
    if regex.search(r"\\[pPX]|\[\[|\[\^?\]|&&|\|\||--|~~", plain):
        return regex.compile(pattern)
    return re.compile(plain, re.ASCII)


class Vocabulary:
    """Ranks of byte strings and the pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        absent = [b for b in range(256) if bytes([b]) not in ranks]
        if absent:
            raise ValueError(f"no rank for the bytes {absent[:8]}")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self._never = max(ranks.values()) + 1
        # the longest token by its last three bytes; of the other tokens none is longer than these
        self._tails: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self._tails[token[-3:]] = max(len(token), self._tails.get(token[-3:], 0))
        self._ascii, self._common, self._any = ascii_pattern(pattern), regex.compile(pattern), regex.compile(library_pattern(pattern), regex.V1)
        self._newer = frozenset("".join(newer_characters().values()))
        self._edges = _Kept(self._edges_of)
        self._pair = _Kept(self._follows)
        self._packed: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, data: bytes, pattern: str) -> Vocabulary:
        """From a rank file's content."""
        lines = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def split(self, text: str) -> re.Pattern | regex.Pattern:
        """The pattern for ``text``; three forms that match alike."""
        if text.isascii():
            return self._ascii
        return self._common if self._newer.isdisjoint(text) else self._any

    def merge(self, piece: bytes, seen: list[tuple[int, list[bytes]]] | None = None) -> list[int]:
        """The encoding by its definition, for strings of a token or two:
        of all neighbours that make a token, join the ones of the lowest rank,
        the first of equals, until none do. ``seen`` gets every step's rank
        and the parts after it."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                return [self.ranks[p] for p in parts]
            rank, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if seen is not None:
                seen.append((rank, parts[:]))

    def _edges_of(self, rank: int) -> tuple | None:
        """The token's first parts while it is merged, each with the rank at
        which it is joined on, its last parts likewise, and whether the ranks
        only rise; None if no merges lead to it."""
        token, seen = self.token[rank], []
        if self.merge(token, seen) != [rank]:
            return None
        edges = []
        for at in (0, -1):
            states = [token[:1] if at == 0 else token[-1:], *(parts[at] for _, parts in seen)]
            joined = [(step, before) for (step, _), before, after in zip(seen, states, states[1:]) if before != after]
            edges.append([*((part, step) for step, part in joined), (token, self._never)])
        return *edges, all(x <= y for (x, _), (y, _) in zip(seen, seen[1:]))

    def _follows(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of two tokens are encoded as these two: no merge
        across their border comes before those on either side of it."""
        one, two = (self._edges[rank] for rank in pair)
        if not (one[2] and two[2]):
            return self.merge(self.token[pair[0]] + self.token[pair[1]]) == [*pair]
        left, right, ranks, i, j = one[1], two[0], self.ranks, 0, 0
        while True:
            (a, until_a), (b, until_b) = left[i], right[j]
            across = ranks.get(a + b)
            if across is not None and across < until_a and across <= until_b:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int]) -> int:
        """Complete ``last``, the last tokens of the prefixes of ``piece``
        (of 1, 2, ... bytes), which holds those of the first few; the number
        of prefixes added."""
        find, edges, pair, tail, before = self.ranks.get, self._edges, self._pair, self._tails.get, len(last)
        for end in range(before + 1, len(piece) + 1):
            longest = tail(piece[end - 3:end], 2) if end > 2 else 2
            for start in range(end - longest if end > longest else 0, end):
                token = find(piece[start:end])
                if token is not None and edges[token] and (not start or pair[last[start - 1], token]):
                    last.append(token)
                    break
        return len(last) - before

    def walk(self, piece: bytes, last: list[int]) -> list[int]:
        """The encoding of the piece whose table is ``last``."""
        if piece in self.ranks:  # also a token that no merges lead to
            return [self.ranks[piece]]
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.token[ids[-1]])
        return ids[::-1]

    def _pack_all(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of pieces, in the order of their bytes: each table
        starts with the part that it shares with the one before."""
        out, before, last = {}, b"", []
        for raw, piece in sorted((p.encode("utf-8", "replace"), p) for p in pieces):
            same, most = 0, min(len(before), len(raw))
            while same < most and before[same] == raw[same]:
                same += 1
            del last[same:]
            self.extend(raw, last)
            ids = self.walk(raw, last)
            out[piece] = struct.pack(f"<{len(ids)}I", *ids)
            before = raw
        return out

    def pieces(self, text: str, at: int = 0) -> Iterator[list[str]]:
        """The pieces of ``text`` from ``at`` on, a list for each slice. A
        match is taken when the characters it may depend on are in the slice."""
        size, split = SLICE, self.split(text)
        while at < len(text):
            end = at + size
            if end >= len(text):
                yield split.findall(text, at)
                return
            found = [m.span() for m in split.finditer(text, at, end)]
            sure = [s for s in found if s[1] + REACH <= end]
            if not sure:
                size *= 2
                continue
            yield [text[a:b] for a, b in sure]
            at, size = sure[-1][1], SLICE

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, waiting, n = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            for pieces in self.pieces(text or ""):
                waiting.append((i, pieces))
                n += len(pieces)
                if n > SLICE:
                    self._finish(waiting, out)
                    waiting, n = [], 0
        self._finish(waiting, out)
        return out

    def _finish(self, waiting: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        """Append the ids of the pieces to their texts'."""
        used = set().union(*(pieces for _, pieces in waiting))
        new = used - self._packed.keys()
        if len(self._packed) + len(new) > KEPT:
            self._packed = {p: self._packed[p] for p in used - new}
        self._packed.update(self._pack_all(new))
        for i, pieces in waiting:
            out[i] += b"".join(map(self._packed.__getitem__, pieces))
        for long in [p for p in new if len(p) > SHORT]:
            del self._packed[long]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixText:
    """A text that is encoded once and then changed: its pieces and the
    prefix table of each. ``steps`` counts the prefixes worked out so far."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.steps = vocabulary, "", 0
        self._starts: list[int] = []
        self._ends: list[int] = []
        self._tables: list[tuple[bytes, list[int]]] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for the characters ``start`` to ``end``. Pieces that
        can't depend on them stay; later ones are made again until a piece
        beyond the edit starts where an old one did."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("no such part of the text")
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = bisect_right(self._ends, start - REACH)
        at = self._ends[first - 1] if first else 0
        starts, ends, tables, rest = [], [], [], len(self._starts)
        for match in self.vocabulary.split(text).finditer(text, at):
            a, b = match.span()
            if a >= start + len(new):
                old = bisect_left(self._starts, a - shift)
                if old < len(self._starts) and self._starts[old] == a - shift:
                    rest = old
                    break
            starts.append(a)
            ends.append(b)
            tables.append(self._table(match.group().encode("utf-8", "replace"), a, start))
        self._starts[first:] = starts + [s + shift for s in self._starts[rest:]]
        self._ends[first:] = ends + [e + shift for e in self._ends[rest:]]
        self._tables[first:] = tables + self._tables[rest:]
        self.text = text

    def _table(self, piece: bytes, at: int, edited: int) -> tuple[bytes, list[int]]:
        """The table of a piece at ``at``; its part before the edit is the
        table of the piece that was there."""
        last: list[int] = []
        old = bisect_left(self._starts, at)
        if at < edited and old < len(self._starts) and self._starts[old] == at:
            before, known = self._tables[old]
            same = next((i for i, (x, y) in enumerate(zip(before, piece)) if x != y), min(len(before), len(piece)))
            last = known[:same]
        self.steps += self.vocabulary.extend(piece, last)
        return piece, last

    def ids(self) -> list[int]:
        return [i for piece, last in self._tables for i in self.vocabulary.walk(piece, last)]


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def _loaded(digest: str, data, pattern: str) -> Vocabulary:
    """The broadcast vocabulary, read once in a worker."""
    if (digest, pattern) not in _LOADED:
        if len(_LOADED) >= 4:
            _LOADED.clear()
        _LOADED[digest, pattern] = Vocabulary.from_file(data.value, pattern)
    return _LOADED[digest, pattern]


def _shared(spark: SparkSession, path: str) -> tuple[str, object]:
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of the column ``text`` in ``into``, a binary of
    little-endian unsigned 32-bit integers (``unpacked`` makes an array), for
    the rank file ``path``, each match of ``pattern`` by itself, without
    special tokens.

    Null and empty texts have no ids. Rows, repeated ones too, and all other
    columns stay as they are, except an earlier column ``into``. A very long text is split in
    slices; a piece costs time in proportion to its bytes. An empty table
    gives an empty one. One map, no shuffle.
    """
    digest, data = _shared(docs.sparkSession, path)
    kept = docs.drop(into)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(digest, data, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in text_groups(texts):
                ids = pa.array(vocabulary.encode_batch(texts[a:b]), pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*batch.schema.names, into])

    return kept.mapInArrow(rows, kept.withColumn(into, F.lit(b"")).schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of the packed ``ids`` in ``into``; null
    without ids. An id that the vocabulary lacks is an error."""
    digest, data = _shared(encoded.sparkSession, path)
    kept = encoded.drop(into)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(digest, data, r"\X")
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            for a, b in text_groups(packed):
                out = pa.array([None if p is None else vocabulary.decode(np.frombuffer(p, "<u4").tolist()) for p in packed[a:b]], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*batch.schema.names, into])

    return kept.mapInArrow(rows, kept.withColumn(into, F.lit(b"")).schema)


def unpacked(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """``encoded`` with the packed ``ids`` as an array of integers."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            made = pa.array([None if p is None else np.frombuffer(p, "<u4").astype(np.int64) for p in batch.column(at).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return encoded.mapInArrow(rows, encoded.withColumn(ids, F.array().cast("array<long>")).schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the contract: ids and the bytes decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return decode(encoded, path).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
