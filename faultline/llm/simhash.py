"""SimHash near-duplicates by anchor-point covering.

Anchors are pairs of words of the binary Golay code, one over bits 0-22 and one
over bits 23-45 of the fingerprint.  The code is perfect: every 23-bit block has
exactly one code word within 3 bits (the covering radius).  So each fingerprint
has one home anchor.  A fingerprint at distance d1 and d2 in the two blocks from
another is within 3 + d1 and 3 + d2 of the other's home; hence, copied to all
anchors whose excess over the radius sums to at most the threshold, it meets
every partner at the partner's home.  Pairs are compared there on all 64 bits.

``near_duplicates`` links fingerprints of shingles, as its contract says.  Texts whose
five-word shingles overlap by 0.8 differ by about ten such bits, too many for any
covering code, so ``similar_documents`` takes fingerprints that move less - word counts,
damped, in several independent tables of 46 bits - finds close pairs in the same way, and
keeps the pairs whose shingle sets pass an exact comparison.

Documents with equal fingerprints are one node, so copies never multiply; a node
has at most 64 + 2016 others within two bits, whatever the number of documents.

Defined results: a null, empty or blank text has fingerprint 0, linked like any
other; repeated rows share a fingerprint; a null doc_id has its text's fingerprint and
component, which is null only if no member has an id, and is never the one that a group
keeps; texts are read whole, in blocks; an empty table gives an empty table; extra columns
are ignored, and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, give_back, materialize
from .components import components

THRESHOLD = 2
WIDTH = 3
#: For similar documents: overlap of five-word shingle sets, and independent fingerprint tables.
SIMILARITY = 0.8
TABLES = 4
#: Minima of shingles that a table's open cells are dealt by.
DRAWS = 2
BLOCK, PARITY, RADIUS = 23, 11, 3
#: Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
TEXT_BLOCK = 1 << 20
BROADCAST_IDS = 1_000_000
#: Two ends of each group that is compared anew, about 60 bytes each.
BROADCAST_ENDS = 200_000


def word_blocks(data: bytes, size: int = TEXT_BLOCK):
    """Lists of words of the text; blocks end at white space."""
    import re

    if len(data) <= size:
        yield data.split()
        return
    blank, at = re.compile(rb"[\x20\x09-\x0D]"), 0
    while at < len(data):
        found = blank.search(data, min(at + size, len(data)))
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash (signed) of lower-cased text: a bit is 1 if set in over half the shingles' XXH64."""
    import numpy as np
    import xxhash

    digest, ones, total, carry = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = carry + words
        carry = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            carry = words
            continue
        joined = b" ".join(words)
        edges = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *edges[: len(words) - width].tolist()]
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (edges[width - 1 :] - 1).tolist())], dtype="<u8")
        total += len(hashes)
        ones += _bit_counts(hashes)
    if not total:
        if not carry:
            return 0
        total = 1
        ones = _bit_counts(np.array([digest(b" ".join(carry), 42)], dtype="<u8"))
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _bit_counts(hashes):
    import numpy as np

    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 128:
        return np.unpackbits(columns, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return np.concatenate([np.bincount(columns[:, k], minlength=256).astype(np.int64) @ bits for k in range(8)])


@lru_cache(maxsize=4)
def _cosets(threshold: int):
    """For each excess over the radius: (first, count, patterns) of the error patterns by syndrome."""
    import numpy as np

    patterns = [0]
    for weight in range(1, RADIUS + threshold + 1):
        patterns += [sum(1 << i for i in c) for c in combinations(range(BLOCK), weight)]
    patterns = np.array(patterns, dtype=np.int64)
    excess, syndromes = np.maximum(0, _popcount(patterns) - RADIUS), _syndrome(patterns)
    out = []
    for e in range(threshold + 1):
        own = excess == e
        order = np.argsort(syndromes[own], kind="stable")
        count = np.bincount(syndromes[own], minlength=1 << PARITY)
        out.append((np.cumsum(count) - count, count, patterns[own][order]))
    return out


def _popcount(values):
    import numpy as np

    return np.bitwise_count(values).astype(np.int64)


def _syndrome(values):
    """Remainder by the generator polynomial."""
    values = values.copy()
    for bit in range(BLOCK - 1, PARITY - 1, -1):
        values ^= ((values >> bit) & 1) * (GENERATOR << (bit - PARITY))
    return values


def anchors(prints, threshold: int):
    """(row, anchor) arrays: every anchor that each fingerprint is copied to (of its 46 low bits)."""
    import numpy as np

    cosets = _cosets(threshold)
    prints = np.asarray(prints, dtype=np.int64)
    mask = (1 << BLOCK) - 1
    blocks = [prints & mask, (prints >> BLOCK) & mask]
    syndromes = [_syndrome(b) for b in blocks]
    rows, out = [], []
    for one in range(threshold + 1):
        for two in range(threshold + 1 - one):
            (f1, c1, p1), (f2, c2, p2) = cosets[one], cosets[two]
            n1, n2 = c1[syndromes[0]], c2[syndromes[1]]
            each = n1 * n2
            row = np.repeat(np.arange(len(prints)), each)
            place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            a = blocks[0][row] ^ p1[f1[syndromes[0]][row] + place // n2[row]]
            b = blocks[1][row] ^ p2[f2[syndromes[1]][row] + place % n2[row]]
            rows.append(row)
            out.append((a >> PARITY) << (BLOCK - PARITY) | b >> PARITY)  # a code word is known by its upper bits
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, print (signed 64-bit)."""
    import pyarrow as pa

    ddl = "doc_id long, print long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                prints = [fingerprint(t, width) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), pa.array(prints, "int64")], schema=schema)
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, ddl)


def close_pairs(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``table``, ``print`` (distinct) -> ``table``, ``a`` < ``b``: all pairs of a table that differ in 1 to ``threshold`` bits."""
    import pyarrow as pa

    ddl = "table int, anchor int, print long"
    schema = arrow_schema(ddl)

    def deal(limit):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    tables, prints = (batch.column(k).slice(at, 4096).to_numpy() for k in (0, 1))
                    row, anchor = anchors(prints, limit)
                    for k in range(0, len(row), 100_000):
                        some = row[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(tables[some]), pa.array(anchor[k : k + 100_000], "int32"), pa.array(prints[some], "int64")], schema=schema)

        return run

    nodes = nodes.select("table", "print")
    home = nodes.mapInArrow(deal(0), ddl).withColumnRenamed("print", "a")
    copies = nodes.mapInArrow(deal(threshold), ddl).withColumnRenamed("print", "b")
    # an unordered pair meets at the home of its smaller print, so it comes out once
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # the planner takes the copies for as small as the nodes' files, and would send all of them through the driver
    return home.join(copies.hint("merge"), (home["table"] == copies["table"]) & (home["anchor"] == copies["anchor"]) & near).select(home["table"], "a", "b")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    prints = materialize(fingerprints(docs, width), "prints")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "print-nodes")
    roots = components(close_pairs(nodes.withColumn("table", F.lit(0)), threshold).select("a", "b"))
    labelled = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    labelled = materialize(labelled, "print-roots")
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = labelled.join(least, "root").select("print", "component_id")
    return prints.join(found, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


# ---- similar documents: damped word counts, several tables, exact comparison of shingle sets ----


def word_prints(data: bytes, tables: int) -> list[int]:
    """One fingerprint of ``2 * BLOCK`` bits a table; words weigh the root of their count."""
    from collections import Counter

    import numpy as np
    import xxhash

    seen: Counter = Counter()
    for words in word_blocks(data.lower()):
        seen.update(words)
    if not seen:
        return [0] * tables
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), dtype=np.uint64, count=len(seen))
    weight = np.sqrt(np.fromiter(seen.values(), dtype=np.float64, count=len(seen)))
    out = []
    for t in range(tables):
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * (t + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones = weight @ np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits = 2 * ones > weight.sum()
        bits[2 * BLOCK :] = False
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def shingle_set(data: bytes, width: int):
    """Distinct 64-bit hashes of the shingles of lower-cased text (fewer words: the whole; none: nothing)."""
    import numpy as np
    import xxhash

    found, carry, any_full = [], [], False
    for words in word_blocks(data.lower()):
        words = carry + words
        carry = words[-(width - 1) :] if width > 1 else []
        if len(words) < width:
            carry = words
            continue
        any_full = True
        found.append(np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + width])) for k in range(len(words) - width + 1)], dtype=np.uint64)))
    if not any_full and carry:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(carry))], dtype=np.uint64))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def _word_print_table(docs: DataFrame, tables: int) -> DataFrame:
    import pyarrow as pa

    ddl = "id long, prints array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                prints = [word_prints(t or b"", tables) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), pa.array(prints, schema.field(1).type)], schema=schema)
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, ddl)


def _shingle_table(docs: DataFrame, width: int) -> DataFrame:
    import pyarrow as pa

    ddl = "id long, shingles array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t or b"", width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast("int64"), pa.array(sets, schema.field(1).type)], schema=schema)
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, ddl)


def _passing(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets overlap by ``similarity`` or more."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - shared
    return both.filter((either == 0) | (shared >= similarity * either)).select("a", "b")


def _second_look(members: DataFrame, close: DataFrame, passed: DataFrame, sets: DataFrame, draws: int) -> DataFrame:
    """``a`` < ``b``: further pairs to compare, where equal and close fingerprints are not one component yet.

    Fingerprints of a table that are linked by closeness are one cell.  The members of a cell that has several
    components are dealt by minima of hashed shingles: sets that overlap by s agree on a draw with probability s.
    Who agrees is paired with two of them, drawn anew each time: at most two pairs for each member, table and draw.
    """
    key = lambda c: F.xxhash64("table", c)
    cells = components(close.select(key("a").alias("a"), key("b").alias("b")))
    roots = components(passed)
    placed = members.withColumn("cell", key("print")).join(cells.toDF("cell", "top"), "cell", "left").withColumn("cell", F.coalesce("top", "cell"))
    placed = placed.join(roots.toDF("id", "root"), "id", "left").select("table", "cell", "id", F.coalesce("root", "id").alias("root"))
    placed = materialize(placed, "word-cells")
    # members of two have been compared
    mixed = placed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi and n > 2").select("cell")
    open_ = placed.join(mixed, "cell", "left_semi")
    least = lambda k: F.array_min(F.transform("shingles", lambda x: F.xxhash64(x, F.col("table") * draws + k)))
    minima = F.posexplode(F.array(*[least(k) for k in range(draws)])).alias("draw", "least")
    dealt = materialize(open_.join(sets, "id").select("cell", "id", "root", minima), "word-minima")
    drawn = F.struct(F.xxhash64("id", "draw", "least"), "id", "root")
    ends = dealt.groupBy("cell", "draw", "least").agg(F.min(drawn).alias("one"), F.max(drawn).alias("two"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    ends = materialize(ends.select("cell", "draw", "least", F.explode(F.array("one", "two")).alias("end")), "word-ends")
    if ends.count() <= BROADCAST_ENDS:  # no shuffle by cell then, so a large group is not one task
        ends = F.broadcast(ends)
    pairs = dealt.join(ends, ["cell", "draw", "least"]).filter("end.root <> root")
    return pairs.select(F.least("end.id", "id").alias("a"), F.greatest("end.id", "id").alias("b")).distinct()


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = 5, tables: int = TABLES, threshold: int = THRESHOLD) -> DataFrame:
    """``a`` < ``b``: linked documents whose shingle sets overlap (intersection over union) by ``similarity`` or more.

    Documents with one fingerprint are compared with the smallest of them, and close
    fingerprints through their smallest documents, so a group of copies gives as many
    pairs as it has members.  Where that leaves documents of equal or close fingerprints
    in different components, these are dealt anew by minima of their shingles and compared
    again, twice a table.  Rows without a doc_id are left out; rows that repeat one are taken as one.
    """
    prints = materialize(_word_print_table(docs.filter(F.col("doc_id").isNotNull()), tables), "word-prints")
    members = prints.select("id", F.posexplode("prints").alias("table", "print"))
    nodes = materialize(members.groupBy("table", "print").agg(F.min("id").alias("first"), F.max("id").alias("last")), "word-nodes")
    inside = members.join(nodes.filter("first < last"), ["table", "print"]).select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a < b")
    close = materialize(close_pairs(nodes.select("table", "print"), threshold), "word-close")
    one = nodes.select("table", F.col("print").alias("a"), F.col("first").alias("d1"))
    two = nodes.select("table", F.col("print").alias("b"), F.col("first").alias("d2"))
    across = close.join(one, ["table", "a"]).join(two, ["table", "b"]).select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).filter("a < b")
    pairs = materialize(inside.unionByName(across).distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("wanted")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted, "candidate-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    some = docs.join(wanted, docs["doc_id"] == wanted["wanted"], "left_semi")
    sets = materialize(_shingle_table(some, width), "shingles").dropDuplicates(["id"])
    passed = materialize(_passing(pairs, sets, similarity), "similar")
    again = _second_look(members.join(wanted, members["id"] == wanted["wanted"], "left_semi").distinct(), close, passed, sets, DRAWS)
    more = materialize(again.join(pairs, ["a", "b"], "left_anti"), "more-candidates")
    return passed if more.isEmpty() else passed.unionByName(_passing(more, sets, similarity))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, similarity: float | None = SIMILARITY) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns of ``docs``.

    Groups are the components of close fingerprints and, with ``similarity``, of similar
    documents; rows without a doc_id stay.
    """
    found = near_duplicates(docs, width, threshold).filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    if similarity is not None:
        found = materialize(found, "near-links").unionByName(similar_documents(docs, similarity))
    # a root is its component's smallest id, so every other member is a node
    gone = materialize(components(found).select(F.col("node").alias("__gone")).distinct(), "near-gone")
    # ids only: a table up to this size goes to every task, a larger one is joined by shuffle
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
