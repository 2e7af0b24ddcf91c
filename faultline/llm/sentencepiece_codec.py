"""Exact BPE encoding of a sentencepiece model by backtracking, and decoding.

The encoder reads left to right.  At each place it takes the longest vocabulary
match (Aho-Corasick gives all matches) that may follow the token before it; two
tokens may stand together when merging their joined text gives the two back.
When no match fits, it steps back, marks the place in a bitfield as failed, and
tries the next shorter match there.  The first complete path is the encoding
that merging by score gives.

Merges never cross from a visible character to the space mark (no vocabulary
entry has the mark inside), nor two neighbours that no entry has side by side (an
unknown character, for one), so the parts between are encoded by themselves and
kept in bounded caches.  Runs of several space marks have equal
merge scores, where order and not adjacency decides: they are merged outright.

Defined results: a null or empty text is the end id alone and decodes to ""; a null
doc_id stays null; unknown characters become byte tokens; repeated rows get equal rows;
an empty table gives an empty table; texts are encoded whole, however long; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import arrow_schema

MARK = "▁"
CACHE_ENTRIES = 300_000
#: Up to this many characters a scan finds the best merge faster than a heap.
SHORT = 24


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces of a model file; only models without text normalisation are taken."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_ids = [0] * 256
        number = 0
        self.dummy_prefix, self.squeeze, self.end_id = True, True, 2
        for key, value in _fields(data):
            if key == 1:
                piece = dict(_fields(value))
                text, score, kind = piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, 1)
                if kind == 1:
                    self.ids[text], self.scores[text] = number, score
                elif kind == 6:
                    self.bytes_ids[int(text[3:5], 16)] = number
                number += 1
            elif key == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("a model with text normalisation")
                self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if self.squeeze or not self.dummy_prefix or any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a model with another treatment of spaces")


class BacktrackingEncoder:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import ahocorasick

        self.model, self.limit = PieceModel(path), cache_entries
        self.text_of = {i: t for t, i in self.model.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.model.ids.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        # no merge joins two neighbours that no vocabulary entry has side by side
        self.joined = {t[k : k + 2] for t in self.model.ids for k in range(len(t) - 1)}
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, tuple] = {}
        self.parts: dict[str, list[int]] = {}
        self.compatible: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Merging by score, ties leftmost first; every character is a vocabulary entry."""
        scores, parts = self.model.scores, list(text)
        if len(parts) <= SHORT:
            while True:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    s = scores.get(parts[k] + parts[k + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, k
                if at < 0:
                    return [self.model.ids[p] for p in parts]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        nxt, prev = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b >= 0 and (s := scores.get(joined := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, joined))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or nxt[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            nxt[a] = nxt[b]
            if nxt[a] >= 0:
                prev[nxt[a]] = a
            if prev[a] >= 0:
                offer(prev[a])
            offer(a)
        return [self.model.ids[p] for p in parts if p is not None]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 4 * self.limit:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.text_of[left] + self.text_of[right]) == [left, right]
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Longest compatible match first; ``failed`` holds places from which no path leads on."""
        size = len(text)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (length, token) in self.automaton.iter(text):
            matches[end + 1 - length].append((end + 1, token))  # ends ascend
        failed, path = 0, []  # path: (start, token, untried shorter matches)
        at, untried = 0, matches[0]
        choice = len(untried) - 1
        while at < size:
            took = False
            while choice >= 0:
                end, token = untried[choice]
                choice -= 1
                if not failed >> end & 1 and (not path or self._fits(path[-1][1], token)):
                    path.append((at, token, untried, choice))
                    at, took = end, True
                    untried = matches[at] if at < size else []
                    choice = len(untried) - 1
                    break
            if not took:
                failed |= 1 << at
                at, _, untried, choice = path.pop()
        return [token for _, token, _, _ in path]

    def _part(self, part: str) -> list[int]:
        ids = self.model.ids
        if len(part) == 1:
            return [ids[part]] if part in ids else [self.model.bytes_ids[b] for b in part.encode()]
        found = self.parts.get(part)
        if found is None:
            found = self.merge(part) if part.startswith(MARK + MARK) else self._backtrack(part)
            if len(self.parts) < self.limit:
                self.parts[part] = found
        return found

    def _segment(self, segment: str) -> tuple:
        """(ids, their decimals) of a run of marks and what follows up to the next mark."""
        joined, cuts = self.joined, [0]
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in joined:
                cuts.append(k)
        cuts.append(len(segment))
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            ids += self._part(segment[a:b])
        found = (ids, " ".join(map(str, ids)))
        if len(self.cache) < self.limit:
            self.cache[segment] = found
        return found

    def segments(self, text: str) -> list[tuple]:
        get, segment = self.cache.get, self._segment
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = self.runs.findall(MARK + text.replace(" ", MARK))
        else:
            parts = [MARK + p for p in text.split(" ")]
        return [get(p) or segment(p) for p in parts]

    def encode(self, text: str | None) -> list[int]:
        """All ids, the end id last."""
        out: list[int] = []
        for ids, _ in self.segments(text) if text else ():
            out += ids
        return [*out, self.model.end_id]


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingEncoder:
    """One per worker process; its caches are bounded."""
    return BacktrackingEncoder(path)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ``ids`` and ``decoded``."""
    import pyarrow as pa

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    schema = arrow_schema(ddl)

    def run(batches):
        import sentencepiece

        enc = encoder(path)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = enc.segments(text) if text else []
                    ids: list[int] = []
                    for x, _ in found:
                        ids += x
                    ids.append(enc.model.end_id)
                    decimal = " ".join([*[d for _, d in found], str(enc.model.end_id)])
                    decoded = library.decode(ids)
                    row = [doc_id, len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    rows.append(row + [ids, decoded] if with_ids else row)
                columns = list(zip(*rows)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
