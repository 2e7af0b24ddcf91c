"""Byte-level BPE: exact token counts at every prefix, and fast exact ids.

``PrefixCounter`` runs a dynamic programme over prefixes.  For a prefix that
ends at byte i the last token of its encoding is the one vocabulary entry that
ends at i and may stand next to the last token of the encoding that ends where
the entry begins; two tokens may stand together when merging their joined bytes
gives the two tokens back.  So ``count[i] = count[start] + 1``, and the counts
of all prefixes come out of one pass, with no prefix encoded anew.

``IdEncoder`` gives the ids themselves for packing.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import sys
from functools import lru_cache

import regex

#: Fixed value: the pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Two adjacent blanks, or a character outside the ranges on which all Unicode
#: versions agree: such texts leave the split-at-spaces path.
_BLANKS = re.compile(r"\s\s")
_LONG_RUN = re.compile(r"\s{2000}|\S{20000}")
_RARE = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
CACHE_ENTRIES = 250_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if visible, else the next code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, following = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(following))
            following += 1
    return out


class ByteVocabulary:
    """Vocabulary and merge ranks of a byte-level BPE file, as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda token: bytes(back[c] for c in token)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: lowest rank first, leftmost first."""
        parts = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.ranks), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.ranks[parts[k], parts[k + 1]][1]]
        return parts


class PrefixCounter:
    """Exact token counts of a text and of each of its prefixes.

    ``count(text)``: tokens of the whole text.  ``prefix(text)``: an index that
    answers ``count_at(chars)`` and ``truncate(budget)``.  None counts as "".
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        self.vocab = ByteVocabulary(path)
        self.path, self.limit = path, cache_entries
        self.pretokens: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.compatible: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.split_special = re.compile("|".join(map(re.escape, self.vocab.specials)) or r"(?!)")
        self._library = None

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 4 * self.limit:
                self.compatible.clear()
            known = self.compatible[key] = self.vocab.merge(self.vocab.bytes_of[left] + self.vocab.bytes_of[right]) == [left, right]
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of one pre-token, i from 0."""
        ids, longest, fits = self.vocab.ids, self.vocab.longest, self._fits
        counts, last = [0], [-1]
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (start == 0 or fits(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _pretoken(self, piece: str) -> int:
        n = self.pretokens.get(piece)
        if n is None:
            data = piece.encode()
            n = 1 if data in self.vocab.ids else self.byte_counts(data)[-1]
            if len(self.pretokens) < self.limit:
                self.pretokens[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii() or not _RARE.search(text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special.search(text):
            return sum(1 if k % 2 else self._plain(part) for k, part in enumerate(self._parts(text)))
        return self._plain(text)

    def _parts(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        out, at = [], 0
        for found in self.split_special.finditer(text):
            out += [text[at : found.start()], found.group()]
            at = found.end()
        return [*out, text[at:]]

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if _BLANKS.search(text) or not text.isascii() and _RARE.search(text):
            return sum(map(self._pretoken, self.pieces(text)))
        # single blanks only: a pre-token begins at every space
        first, *rest = text.split(" ")
        get = self.chunks.get
        total = sum(map(self._pretoken, self.pattern.findall(first)))
        for part in rest:
            n = get(part)
            if n is None:
                n = self._spaced(part)
            total += n
        return total

    def _spaced(self, part: str) -> int:
        n = sum(map(self._pretoken, self.pattern.findall(" " + part)))
        if len(self.chunks) < self.limit:
            self.chunks[part] = n
        return n

    def prefix(self, text: str | None) -> "PrefixIndex":
        return PrefixIndex(self, text or "")


class PrefixIndex:
    """Token counts at every prefix (in characters) of one text.

    A cut inside a run of blanks or inside a contraction changes how the tail is
    split, so the piece at the cut is split again; all before it stands.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.before, at, total = [], [], 0, 0
        for k, part in enumerate(counter._parts(text)):
            for piece in [part] if k % 2 else counter.pieces(part):
                self.starts.append(at)
                self.before.append(total)
                at += len(piece)
                total += 1 if k % 2 else counter._pretoken(piece)
        self.total = total

    def count_at(self, chars: int) -> int:
        if chars >= len(self.text):
            return self.total
        if chars <= 0:
            return 0
        k = bisect.bisect_left(self.starts, chars) - 1
        while k > 0 and self.text[self.starts[k - 1] : self.starts[k]].isspace():
            k -= 1
        return self.before[k] + self.counter.count(self.text[self.starts[k] : chars])

    def truncate(self, budget: int) -> int:
        """Length in characters of the longest prefix with at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        # counts at piece starts never fall; inside a piece they may
        k = bisect.bisect_right(self.before, budget) - 1
        for chars in range(self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text), self.starts[k], -1):
            if self.count_at(chars) <= budget:
                return chars
        return self.starts[k]


class IdEncoder:
    """Ids as little-endian unsigned 32-bit integers in one bytes object, as the library gives them.

    Plain texts take a byte-pair encoder built from the same vocabulary; texts with
    special strings, rare characters or very long runs go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        vocab = ByteVocabulary(path)
        order = [bytes([b]) for b in sorted(range(256), key=lambda b: vocab.ids[bytes([b])])] + [vocab.bytes_of[i] for _, i in sorted(vocab.ranks.values())]
        ranks = {b: k for k, b in enumerate(dict.fromkeys(order))}
        if any(vocab.ids[b] != k for b, k in ranks.items()):
            raise ValueError("token ids are not in merge order")
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._library = path, None  # loaded when a text first needs it
        self.specials = tuple(vocab.specials)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials) or _LONG_RUN.search(text) or not text.isascii() and _RARE.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
            ids = self._library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids = array.array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One per worker process; its caches are bounded."""
    return PrefixCounter(path)


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)
