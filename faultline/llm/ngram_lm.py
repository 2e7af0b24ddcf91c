"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Training counts words, numbers them in order of their hash, and writes every text once as
word numbers in compressed blocks (the encoded corpus), which all later passes read.
N-grams are then counted level by level.  A node is keyed by (parent node, word).  Counting
tasks merge their n-grams into sorted runs and send each range of that key as one block of
compressed differences.  Ranges are cut at equal shares of the parents' counts, within a
parent if need be, so the successors of a very frequent context are dealt to several owners.
The owner of a range merges the blocks, prunes, and keeps the result with the discounted
mass of the two contexts that may go on in a neighbouring range; a last pass adds these up
and writes one shard file for each range to the shared folder.  Nothing is gathered on the
driver but a line for each range.  A shard holds

* ``parents``: the parent nodes that have successors, a monotone sequence in
  Elias-Fano code;
* ``nodes``: successors relative to their context (rank of the parent times the
  vocabulary size, plus the word), again monotone and in Elias-Fano code;
* probabilities and back-off weights as 16-bit steps of the logarithm.

Scoring tasks map the files into memory and look nodes up by successor search
within the context, in sorted blocks of distinct n-grams.

The model interpolates: P(w | context) = (c - D) / c(context) + backoff(context) *
P(w | shorter context), down to discounted words with one class for unknown
words, so probabilities over the vocabulary and that class sum to one.  Orders
above one cover all n-grams seen ``NGRAM_MIN`` times or more, at every size of
corpus; what is pruned goes to the back-off weight.  Words are known by a 64-bit hash.

The shared folder is written and read through Arrow's file systems (local or mounted
folders, HDFS, S3, GCS); where it cannot be mapped, a worker keeps a private, unlinked copy
of the shards that it touches.

Defined results: a null text is empty, one end token; with nothing to learn from
all tokens are unknown; a null doc_id is in no fold but the training rows' (its
fold is null, so it is not held out); repeated rows count each; an empty table
gives an empty table; extra columns are ignored; texts are read whole, in blocks.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_schema, fold_of, give_back, local_temp, materialize, partitions, workspace

FOLDS, HELD_OUT = 7, 2
ORDER = 3
#: N-grams seen less often are pruned; so words seen less often are in none that stays.
NGRAM_MIN = 2
DISCOUNT = 0.75
#: Tokens that are looked up at once, and tokens of a row of the encoded corpus (a longer text is a row of its own).
BLOCK_TOKENS, ROW_TOKENS = 1_000_000, 65_536
#: Tokens of a block of texts whose words are looked up at once.
LOOKUP_TOKENS = 200_000
#: Distinct n-grams that a counting task merges before it sends them on.
RUN_NGRAMS = 3_000_000
#: Tokens for each range of a level's keys, and the most ranges of a level.
RANGE_TOKENS, MOST_RANGES = 1_000_000, 1 << 16
#: Words of a worker's look-up cache, and words whose counts it holds as one array (else they are read from the shards).
KNOWN_WORDS, DENSE_WORDS = 500_000, 4_000_000
#: Quantisation: log10 from -13 to 0 in 16 bits.
STEP = 13 / 65535


def _filesystem(uri: str):
    """Arrow's file system and the path in it; Hadoop's names for S3 are known too."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else uri)


class EliasFano:
    """A sorted sequence of unsigned 64-bit numbers: low bits packed, high bits in unary.

    ``find`` returns the index of each sorted query or -1.
    """

    def __init__(self, count: int, base: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray):
        self.count, self.base, self.low_bits, self.lows, self.highs, self.zeros = count, base, low_bits, lows, highs, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        base = int(values[0]) if n else 0
        v = values.astype(np.uint64) - np.uint64(base)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(bits)).astype(np.int64)
        place = high + np.arange(n)
        words = np.zeros((int(place[-1]) + 64) // 64 + 1 if n else 1, dtype=np.uint64)
        np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.bitwise_count(words).astype(np.int64)
        zeros = np.cumsum(64 - ones) - (64 - ones)  # zeros before each word
        lows = np.zeros((n * bits + 63) // 64 + 1, dtype=np.uint64)
        if bits:
            low = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(lows, at >> 6, low << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(lows, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        return cls(n, base, bits, lows, words, zeros)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.uint64)
        at = index * self.low_bits
        shift = (at & 63).astype(np.uint64)
        out = self.lows[at >> 6] >> shift
        over = np.flatnonzero((at & 63) + self.low_bits > 64)
        out[over] |= self.lows[(at[over] >> 6) + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero, from 0; the end of the bits if there are fewer."""
        word = np.clip(np.searchsorted(self.zeros, k, side="right") - 1, 0, len(self.highs) - 1)
        left, bits, place = k - self.zeros[word], ~self.highs[word], word << 6
        inside = left < np.bitwise_count(bits)
        left = np.where(inside, left, 0)
        for half in (32, 16, 8):  # into the half that holds it
            below = np.bitwise_count(bits & np.uint64((1 << half) - 1))
            upper = left >= below
            left = left - below * upper
            bits = np.where(upper, bits >> np.uint64(half), bits)
            place = place + half * upper
        return np.where(inside, place + _SELECT[(bits & np.uint64(255)).astype(np.int64), np.minimum(left, 7)], len(self.highs) << 6)

    def _between(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the elements with these high bits: the ones between two neighbouring zeros."""
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        first = start - high
        word = np.minimum(start >> 6, len(self.highs) - 1)
        shift = (start & 63).astype(np.uint64)
        ended = ~(self.highs[word] >> shift)  # zeros are shifted in, so an end beyond the word shows as its end
        ones = np.bitwise_count((ended & (~ended + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        last = first + ones
        over = np.flatnonzero((start & 63) + ones >= 64)
        if len(over):
            last[over] = self._zero(high[over]) - high[over]
        return np.minimum(first, self.count), np.minimum(last, self.count)

    def find(self, queries: np.ndarray) -> np.ndarray:
        out = np.full(len(queries), -1, dtype=np.int64)
        if not self.count or not len(queries):
            return out
        q = queries.astype(np.uint64)
        inside = np.flatnonzero(q >= np.uint64(self.base))
        v = q[inside] - np.uint64(self.base)
        high = v >> np.uint64(self.low_bits)
        near = high < np.uint64(len(self.highs) << 6)  # beyond the last bit there is nothing
        inside, v, high = inside[near], v[near], high[near].astype(np.int64)
        first, last = self._between(high)
        low = v & np.uint64((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(v), dtype=np.uint64)
        open_ = np.flatnonzero(first < last)
        while len(open_):  # binary search among the elements with the same high bits
            inside, first, last, low = inside.take(open_), first.take(open_), last.take(open_), low.take(open_)
            middle = (first + last) >> 1
            found = self._low(middle)
            less, same = found < low, found == low
            out[inside[same]] = middle[same]
            first, last = np.where(less, middle + 1, first), np.where(less, last, middle)
            open_ = np.flatnonzero((first < last) & ~same)
        return out


def _select_table() -> np.ndarray:
    """Place of the k-th set bit of each byte."""
    out = np.zeros((256, 8), dtype=np.int64)
    for byte in range(256):
        for k, bit in enumerate(b for b in range(8) if byte >> b & 1):
            out[byte, k] = bit
    return out


_SELECT = _select_table()


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 / STEP), 0, 65535).astype(np.uint16)


def write_shard(path: str, meta: dict, sequences: dict[str, EliasFano], arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON header, then the arrays at multiples of 64 bytes.  Renamed into place, so retries are safe."""
    import uuid

    for name, s in sequences.items():
        meta[name] = {"count": s.count, "base": str(s.base), "low_bits": s.low_bits}
        arrays |= {f"{name}.lows": s.lows, f"{name}.highs": s.highs, f"{name}.zeros": s.zeros}
    at, layout = 0, {}
    for name, a in arrays.items():
        layout[name] = (str(a.dtype), len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(meta | {"layout": layout}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    system, where = _filesystem(path)
    part = f"{where}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 64))
    system.move(part, where)


def _private_copy(system, where: str) -> np.ndarray:
    import os
    import shutil

    local = local_temp(".trie")
    with system.open_input_stream(where) as source, open(local, "wb") as target:
        shutil.copyfileobj(source, target)
    data = np.memmap(local, dtype=np.uint8, mode="r")
    os.unlink(local)
    return data


@lru_cache(maxsize=4096)
def _mapped(path: str) -> tuple[dict, np.ndarray]:
    from pyarrow import fs

    system, where = _filesystem(path)
    if not isinstance(system, fs.LocalFileSystem):  # a shared store that cannot be mapped: a private copy, unlinked once open
        data = _private_copy(system, where)
    else:
        data = np.memmap(where, dtype=np.uint8, mode="r")
    data = data.view(np.ndarray)  # slices of a memmap are slow to make
    size = int.from_bytes(data[:8].tobytes(), "little")
    return json.loads(data[8 : 8 + size].tobytes()), data[8 + size :]


class Shard:
    def __init__(self, path: str):
        self.meta, data = _mapped(path)
        self.arrays = {n: data[at : at + np.dtype(t).itemsize * size].view(t) for n, (t, size, at) in self.meta["layout"].items()}

    def sequence(self, name: str) -> EliasFano:
        m, a = self.meta[name], self.arrays
        return EliasFano(m["count"], int(m["base"]), m["low_bits"], a[f"{name}.lows"], a[f"{name}.highs"], a[f"{name}.zeros"])


_shard = lru_cache(maxsize=4096)(Shard)


class _Known(dict):
    """Word numbers by word; a new word gets the next number below -1 until it is looked up."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = -1 - len(self.new)
        return -1 - len(self.new)


class Level:
    """All shards of a level.  ``shards``: (first key, path, nodes, first node number, sum of counts) in order of key."""

    def __init__(self, shards: list[tuple], words: int):
        self.shards, self.words = shards, words
        self.firsts = np.array([s[0] for s in shards], dtype=np.uint64)
        self.numbers = np.array([s[3] for s in shards], dtype=np.int64)

    @property
    def nodes(self) -> int:
        return self.shards[-1][2] + self.shards[-1][3] if self.shards else 0

    def gather(self, name: str, nodes: np.ndarray) -> np.ndarray:
        """Values of an array by sorted node number."""
        out = np.zeros(len(nodes), dtype=np.float64)
        edges = np.searchsorted(nodes, [*self.numbers, self.nodes])
        for k in np.flatnonzero(np.diff(edges)):
            own = slice(edges[k], edges[k + 1])
            out[own] = _shard(self.shards[k][1]).arrays[name][nodes[own] - self.numbers[k]]
        return out

    def _spread(self, keys: np.ndarray, look) -> np.ndarray:
        """Node numbers by shard; keys are sorted, so each shard's are neighbours."""
        out = np.full(len(keys), -1, dtype=np.int64)
        edges = np.r_[0, np.searchsorted(keys, self.firsts[1:]), len(keys)] if self.shards else np.zeros(1, int)
        for k in np.flatnonzero(np.diff(edges)):
            own = slice(edges[k], edges[k + 1])
            found = look(_shard(self.shards[k][1]), own)
            out[own] = np.where(found >= 0, found + self.numbers[k], -1)
        return out

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted unsigned hashes -> word numbers or -1."""
        return self._spread(hashes, lambda s, own: s.sequence("nodes").find(hashes[own]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, log10 back-off of the parent or 0) for sorted keys (parent times ``words``, plus the word)."""
        back, wide = np.zeros(len(keys)), np.uint64(self.words)

        def look(s: Shard, own: slice) -> np.ndarray:
            parent = keys[own] // wide
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            where = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(parent)]))
            rank = s.sequence("parents").find(parent[first])
            back[own] = np.where(rank >= 0, -STEP * s.arrays["backoff"][np.maximum(rank, 0)].astype(float) if len(s.arrays["backoff"]) else 0.0, 0.0)[where]
            rank = rank[where]
            out = np.full(len(rank), -1, dtype=np.int64)
            known = rank >= 0
            out[known] = s.sequence("nodes").find(rank[known] * self.words + (keys[own] - parent * wide)[known].astype(np.int64))
            return out

        return self._spread(keys, look), back


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted order, where each distinct key begins in it, which distinct key each place in it has)."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(keys) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class Trie:
    """The model: its levels and the three numbers of the unigram level."""

    def __init__(self, levels: list[Level], tokens: int, words: int, discount: float, ngram_min: int = NGRAM_MIN):
        self.levels, self.tokens, self.words, self.discount, self.ngram_min = levels, tokens, words, discount, ngram_min

    def log10_word(self, count: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(count - self.discount, 1e-9) / self.tokens)

    def log10_unknown(self) -> float:
        return float(np.log10(max(self.discount * self.words, 1) / max(self.tokens, 1))) if self.words else 0.0

    def number(self, words: list[bytes], known: _Known) -> np.ndarray:
        """Word number or -1 of every token; ``known`` keeps what was looked up, up to KNOWN_WORDS."""
        import xxhash

        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if known.new:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known.new), dtype=np.uint64, count=len(known.new))
            order = np.argsort(hashes)
            found = np.empty(len(hashes), dtype=np.int64)
            found[order] = self.levels[0].find_words(hashes[order])
            known.update(zip(known.new, found.tolist()))
            known.new = []
            late = np.flatnonzero(out < -1)
            out[late] = found[-2 - out[late]]
            if len(known) > KNOWN_WORDS:
                known.clear()
        return out

    def counts(self, word: np.ndarray) -> np.ndarray:
        """Training count of every word number (0 for -1)."""
        if self.words <= DENSE_WORDS:
            return _dense_counts(tuple(s[1] for s in self.levels[0].shards))[word]
        order, first, which = distinct(word)
        values = word[order][first]
        known = values >= 0
        count = np.zeros(len(values), dtype=np.int64)
        count[known] = self.levels[0].gather("count", values[known]).astype(np.int64)
        out = np.empty(len(word), dtype=np.int64)
        out[order] = count[which]
        return out

    def walk(self, word: np.ndarray, count: np.ndarray, begins: np.ndarray, depth: int):
        """Log10 probability of every token under levels 1..depth, and its node at the last (-1 if none)."""
        prob = np.full(len(word), self.log10_unknown())
        known = word >= 0
        if self.words:
            prob[known] = self.log10_word(count[known])
        usable = known & (count >= self.ngram_min)
        node = np.where(usable, word, -1)
        # a word outside the higher orders still pays the back-off
        successor = np.where(usable, word, self.words).astype(np.uint64)
        for level in self.levels[1:depth]:
            parent = parents_of(node, begins)
            node = np.full(len(word), -1, dtype=np.int64)
            at = np.flatnonzero(parent >= 0)
            keys = parent[at].astype(np.uint64) * np.uint64(level.words) + successor[at]
            order, first, which = distinct(keys)
            found, back = level.find(keys[order][first])
            hit = found >= 0
            stored = np.zeros(len(found))
            by_number = np.flatnonzero(hit)  # keys are sorted, so numbers are
            stored[by_number] = -STEP * level.gather("prob", found[by_number])
            at = at[order]
            prob[at] = np.where(hit[which], stored[which], prob[at] + back[which])
            node[at] = found[which]
        return prob, node


@lru_cache(maxsize=1)
def _dense_counts(paths: tuple) -> np.ndarray:
    """All words' counts by number, and a 0 at the end for -1."""
    return np.concatenate([*(Shard(p).arrays["count"].astype(np.int64) for p in paths), np.zeros(1, np.int64)])


def parents_of(node: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The node before each token; none at the begin of a text."""
    parent = np.r_[-1, node[:-1]]
    parent[begins] = -1
    return parent


# ---- words and the encoded corpus ----


def token_blocks(batches, text: int, most: int):
    """(batch, first row, words of texts, sizes with the end token) in blocks of about ``most`` tokens."""
    for batch in batches:
        words, sizes, first = [], [], 0
        for row, data in enumerate(batch.column(text).to_pylist()):
            own = (data or b"").lower().split()
            own.append(b"")  # the end token
            words += own
            sizes.append(len(own))
            if len(words) >= most:
                yield batch, first, words, sizes
                words, sizes, first = [], [], row + 1
        if sizes:
            yield batch, first, words, sizes


def _word_counts(docs: DataFrame) -> DataFrame:
    """hash (signed and flipped, so signed order is hash order), count."""
    import pyarrow as pa

    schema = arrow_schema("hash long, count long")

    def run(batches):
        import xxhash

        seen: Counter = Counter()

        def flush():
            words = list(seen)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
            counts = np.fromiter(seen.values(), dtype=np.int64, count=len(words))
            seen.clear()
            flipped = (hashes ^ np.uint64(1 << 63)).view(np.int64)
            for k in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(flipped[k : k + 100_000]), pa.array(counts[k : k + 100_000])], schema=schema)

        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen.update((data or b"").lower().split())
                seen[b""] += 1  # the end token
                if len(seen) > 500_000:
                    yield from flush()
        if seen:
            yield from flush()
        give_back()

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count"))


def _train_words(docs: DataFrame, spark: SparkSession, ngram_min: int) -> Trie:
    """The word level: words are numbered in order of their hash, shards are ranges of it."""
    import pyarrow as pa

    counts = materialize(_word_counts(docs), "word-counts")
    row = counts.agg(F.sum("count"), F.count("*"), F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).first()
    tokens, words, once, twice = row[0] or 0, row[1], row[2], row[3]
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    folder = _new_folder(spark, "trie-1")
    lines = arrow_schema("first string, path string, nodes long, mass long")

    def write(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        hashes = table["hash"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        count = table["count"].to_numpy().astype(np.uint64)
        path = f"{folder}/{int(hashes[0]):020d}"
        write_shard(path, {}, {"nodes": EliasFano.build(hashes)}, {"count": count})
        yield pa.RecordBatch.from_arrays([pa.array([str(hashes[0])]), pa.array([path]), pa.array([len(count)], "int64"), pa.array([int(count.sum())], "int64")], schema=lines)

    dealt = counts.repartitionByRange(partitions(spark), "hash").sortWithinPartitions("hash")
    rows = sorted((int(r["first"]), r["path"], r["nodes"], r["mass"]) for r in dealt.mapInArrow(write, "first string, path string, nodes long, mass long").collect())
    return Trie([Level(_numbered(rows), words)], tokens, words, discount, ngram_min)


def _new_folder(spark: SparkSession, label: str) -> str:
    folder = workspace(spark, label)
    system, where = _filesystem(folder)
    system.create_dir(where)
    return folder


def _numbered(rows: list[tuple]) -> list[tuple]:
    """(first key, path, nodes, mass) -> with the number of each shard's first node."""
    shards, number = [], 0
    for start, path, nodes, mass in rows:
        shards.append((start, path, nodes, number, mass))
        number += nodes
    return shards


def encode(docs: DataFrame, trie: Trie, learned: Column) -> DataFrame:
    """The encoded corpus: rows of many texts with their ids, whether they are learned from, sizes and word numbers."""
    import pyarrow as pa

    ddl = "ids array<long>, learned array<boolean>, sizes array<long>, words binary"
    schema = arrow_schema(ddl)
    wide = np.int32 if trie.words < 2**31 else np.int64

    def run(batches):
        known, waiting, words = _Known(), [], []

        def flush():
            at, number = 0, trie.number(words, known).astype(wide)
            for ids, learned, sizes, count in waiting:
                row = [ids, learned, sizes, _packed(number[at : at + count])]
                at += count
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema)], schema=schema)

        for batch, first, own, sizes in token_blocks(batches, 2, ROW_TOKENS):
            waiting.append((*(batch.column(k).slice(first, len(sizes)).to_pylist() for k in (0, 1)), sizes, len(own)))
            words += own
            if len(words) >= LOOKUP_TOKENS:  # a look-up in each shard for several rows at once
                yield from flush()
                waiting, words = [], []
        if waiting:
            yield from flush()
        give_back()

    texts = docs.select(F.col("doc_id").cast("long"), learned.alias("learned"), F.col("text").cast("binary"))
    return materialize(texts.mapInArrow(run, ddl), "encoded")


def encoded_blocks(batches, trie: Trie, learned_only: bool):
    """(ids, sizes, word numbers) of about BLOCK_TOKENS tokens."""
    wide = np.int32 if trie.words < 2**31 else np.int64
    ids, sizes, words, held = [], [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            size = batch.column(2)[k].values.to_numpy()
            word = _unpacked(batch.column(3)[k].as_py(), wide).astype(np.int64)
            own = batch.column(0)[k].values
            if learned_only:
                keep = batch.column(1)[k].values.to_numpy(zero_copy_only=False).astype(bool)
                size, word = size[keep], word[np.repeat(keep, size)]
            ids.append(own)
            sizes.append(size)
            words.append(word)
            held += len(word)
            if held >= BLOCK_TOKENS:
                yield ids, np.concatenate(sizes), np.concatenate(words)
                ids, sizes, words, held = [], [], [], 0
    if held:
        yield ids, np.concatenate(sizes), np.concatenate(words)


# ---- levels above the words ----


def _packed(values: np.ndarray) -> bytes:
    """Count and compressed byte planes: the upper planes of small numbers are zeros."""
    import pyarrow as pa

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    import pyarrow as pa

    n, wide = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * wide, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, n).T).view(dtype).ravel()


class _Run:
    """Counts of n-grams by key, as one sorted run and what came since; merged when that outgrows the run."""

    def __init__(self, least: int):
        self.least, self.size, self.waiting = least, 0, 0
        self.parts: list[tuple] = []

    def add(self, key: np.ndarray, count: np.ndarray, lower: np.ndarray | None) -> None:
        self.parts.append((key, count, lower))
        self.waiting += len(key)
        if self.waiting > max(self.least, self.size):
            self.merged()

    def merged(self) -> tuple:
        if len(self.parts) > 1:
            key, count = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
            lower = None if self.parts[0][2] is None else np.concatenate([p[2] for p in self.parts])
            self.parts = []
            order, first, _ = distinct(key)
            count = np.add.reduceat(count[order], first) if len(key) else count
            order = order[first]
            self.parts = [(key[order], count, None if lower is None else lower[order])]
        self.waiting, self.size = 0, len(self.parts[0][0]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), None)


def _cuts(spark: SparkSession, below: Level, vocabulary: int, ranges: int) -> np.ndarray:
    """First key of each range: equal shares of the parents' counts; a parent with more than a share is cut by word."""
    import pyarrow as pa

    mass = np.cumsum([0, *(s[4] for s in below.shards)])
    wanted = mass[-1] * np.arange(1, ranges) / ranges
    schema = arrow_schema("place int, key string")

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = np.flatnonzero((wanted >= mass[k]) & (wanted < mass[k + 1]))
                if not len(own):
                    continue
                count = Shard(below.shards[k][1]).arrays["count"].astype(np.float64)
                upto = np.cumsum(count)
                at = np.minimum(np.searchsorted(upto, wanted[own] - mass[k], side="right"), len(count) - 1)
                share = np.clip((wanted[own] - mass[k] - (upto[at] - count[at])) / count[at], 0, 1)
                # a parent within its share is not cut: the range begins with it
                share = np.where(count[at] > mass[-1] / ranges, share, 0)
                keys = [(int(a) + below.numbers[k].item()) * vocabulary + int(f * vocabulary) for a, f in zip(at, share)]
                yield pa.RecordBatch.from_arrays([pa.array(own, "int32"), pa.array([str(x) for x in keys])], schema=schema)

    shards = len(below.shards)
    rows = spark.range(0, shards, 1, max(1, min(shards, partitions(spark)))).mapInArrow(run, "place int, key string").collect()
    return np.unique(np.array([0, *(int(r["key"]) for r in rows)], dtype=np.uint64))


def _add_level(encoded: DataFrame, spark: SparkSession, trie: Trie) -> Trie:
    """One level more: counts (parent node, word), prunes, and writes the shards."""
    import pyarrow as pa

    depth, below, vocabulary = len(trie.levels), trie.levels[-1], trie.words + 1
    if below.nodes * vocabulary >= 2**64:
        raise OverflowError(f"{below.nodes} contexts of {vocabulary} words do not fit in 64-bit keys")
    if not below.nodes:
        return Trie([*trie.levels, Level([], vocabulary)], trie.tokens, trie.words, trie.discount, trie.ngram_min)
    cuts = _cuts(spark, below, vocabulary, min(MOST_RANGES, max(partitions(spark), trie.tokens // RANGE_TOKENS)))
    ranges, wide = len(cuts), np.uint64(vocabulary)
    owners = min(ranges, partitions(spark))
    ddl = "range int, keys binary, counts binary, lower binary"
    schema = arrow_schema(ddl)

    def send(run: _Run):
        key, count, lower = run.merged()
        edges = np.r_[np.searchsorted(key, cuts), len(key)]
        for k in np.flatnonzero(np.diff(edges)):
            own = slice(edges[k], edges[k + 1])
            blocks = [_packed(np.r_[key[own][:1], np.diff(key[own])]), _packed(count[own]), None if lower is None else _packed(lower[own])]
            yield pa.RecordBatch.from_arrays([pa.array([k], "int32"), *[pa.array([b], "binary") for b in blocks]], schema=schema)

    def count_up(batches):
        run = _Run(RUN_NGRAMS)
        for _, sizes, word in encoded_blocks(batches, trie, True):
            begins = np.cumsum(sizes) - sizes
            count = trie.counts(word)
            prob, node = trie.walk(word, count, begins, depth)
            parent = parents_of(node, begins)
            at = np.flatnonzero((parent >= 0) & (word >= 0) & (count >= trie.ngram_min))
            key = parent[at].astype(np.uint64) * wide + word[at].astype(np.uint64)
            order, first, _ = distinct(key)
            times = np.diff(np.r_[first, len(key)]).astype(np.uint64)
            order = order[first]
            # the probability by the shorter context goes along, quantised; of words it is known from their counts
            run.add(key[order], times, quantise(prob[at[order]]) if depth > 1 else None)
            if run.size + run.waiting >= RUN_NGRAMS:
                yield from send(run)
                run = _Run(RUN_NGRAMS)
        yield from send(run)
        give_back()

    raw, folder = _new_folder(spark, f"merged-{depth + 1}"), _new_folder(spark, f"trie-{depth + 1}")
    edge_ddl = "range int, nodes long, mass long, first double, last double"
    edge_schema = arrow_schema(edge_ddl)
    #: The contexts that a range's first and last key belong to; they may go on in the neighbours.
    first_of = (cuts // wide).astype(np.int64)
    last_of = np.r_[((cuts[1:] - np.uint64(1)) // wide).astype(np.int64), below.nodes - 1] if ranges else first_of

    def keep(number: int, run: _Run):
        key, count, lower = run.merged()
        kept = count >= trie.ngram_min
        key, count = key[kept], count[kept]
        lower = np.zeros(0, np.uint16) if lower is None else lower[kept]
        parent = (key // wide).astype(np.int64)
        mass = [float((count[parent == c] - DISCOUNT).sum()) for c in (first_of[number], last_of[number])]
        write_shard(f"{raw}/{number:010d}", {}, {}, {"key": key, "count": count, "lower": lower})
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((number, len(key), int(count.sum()), *mass), edge_schema)], schema=edge_schema)

    def merge(batches):
        number, run = -1, None
        for batch in batches:
            for k in range(batch.num_rows):
                own, keys, counts, lower = (c[k].as_py() for c in batch.columns)
                if own != number:
                    if run is not None:
                        yield from keep(number, run)
                    number, run = own, _Run(RANGE_TOKENS)
                run.add(np.cumsum(_unpacked(keys, np.uint64), dtype=np.uint64), _unpacked(counts, np.uint64), None if lower is None else _unpacked(lower, np.uint16))
        if run is not None:
            yield from keep(number, run)
        give_back()

    counted = encoded.mapInArrow(count_up, ddl)
    dealt = counted.repartitionById(owners, F.col("range") % owners).sortWithinPartitions("range")
    kept = {r["range"]: r for r in dealt.mapInArrow(merge, edge_ddl).collect()}  # a line a range

    # the discounted mass of contexts that several ranges share
    shared: dict[int, float] = {}
    for k, r in kept.items():
        for c, m in {int(first_of[k]): r["first"], int(last_of[k]): r["last"]}.items():
            shared[c] = shared.get(c, 0.0) + m

    def finish(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                arrays = Shard(f"{raw}/{k:010d}").arrays if k in kept else {}
                key, count = arrays.get("key", np.zeros(0, np.uint64)), arrays.get("count", np.zeros(0, np.uint64)).astype(np.float64)
                parent, word = (key // wide).astype(np.int64), (key % wide).astype(np.int64)
                # a shared context is known in all its ranges, for its back-off
                edges = [c for c in {int(first_of[k]), int(last_of[k])} if shared.get(c, 0.0) > 0]
                context = np.unique(np.r_[parent, np.array(edges, dtype=np.int64)])
                rank = np.searchsorted(context, parent)
                own = np.bincount(rank, weights=count - DISCOUNT, minlength=len(context)).astype(float)  # of no rows numpy makes whole numbers
                own[np.searchsorted(context, edges)] = [shared[c] for c in edges]
                total = np.maximum(below.gather("count", context), 1)
                back = np.clip(1 - own / total, 1e-9, 1.0)
                if depth > 1:
                    lower = -STEP * arrays["lower"].astype(float) if len(key) else np.zeros(0)
                else:
                    lower = trie.log10_word(trie.counts(word))
                prob = np.clip((count - DISCOUNT) / total[rank] + back[rank] * 10.0**lower, 1e-13, 1.0)
                sequences = {"parents": EliasFano.build(context), "nodes": EliasFano.build(rank * vocabulary + word)}
                narrow = count.astype(np.min_scalar_type(int(count.max()))) if len(count) else count.astype(np.uint8)
                write_shard(f"{folder}/{k:010d}", {}, sequences, {"prob": quantise(np.log10(prob)), "backoff": quantise(np.log10(back)), "count": narrow})
                yield pa.RecordBatch.from_arrays([pa.array([k], "int32")], schema=done)

    done = arrow_schema("range int")
    wanted = spark.range(0, ranges, 1, owners).select(F.col("id").cast("int").alias("range"))
    wanted.mapInArrow(finish, "range int").count()
    rows = [(int(cuts[k]), f"{folder}/{k:010d}", *((kept[k]["nodes"], kept[k]["mass"]) if k in kept else (0, 0))) for k in range(ranges)]
    return Trie([*trie.levels, Level(_numbered(rows), vocabulary)], trie.tokens, trie.words, trie.discount, trie.ngram_min)


def train(docs: DataFrame, learned: Column | None = None, order: int = ORDER, ngram_min: int = NGRAM_MIN) -> tuple[Trie, DataFrame]:
    """Fits on the rows of ``docs`` where ``learned`` holds (default: all); the model and the encoded corpus of all rows."""
    spark, learned = docs.sparkSession, F.lit(True) if learned is None else learned
    trie = _train_words(docs.filter(learned), spark, ngram_min)
    encoded = encode(docs, trie, learned)
    while len(trie.levels) < order:
        trie = _add_level(encoded, spark, trie)
    return trie, encoded


def score(encoded: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every text of an encoded corpus."""
    import pyarrow as pa

    ddl = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        for ids, sizes, word in encoded_blocks(batches, trie, False):
            begins = np.cumsum(sizes) - sizes
            count = trie.counts(word)
            prob, _ = trie.walk(word, count, begins, len(trie.levels))
            base = np.log10((count + 1) / (trie.tokens + trie.words + 1))
            sums = [np.add.reduceat(v, begins) for v in ((count > 0).astype(np.int64), base, prob)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array(c, f.type) for c, f in zip([sizes, *sums], list(schema)[1:])]], schema=schema)
        give_back()

    return encoded.mapInArrow(run, ddl)


def score_held_out(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Learns from the other folds and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    is_held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    trie, encoded = train(docs, ~is_held, order)
    found = score(encoded, trie)
    return found.select("doc_id", is_held.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
