"""Removal of repeated substrings by bucket-pointer refinement.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller doc_id.

1. Texts are written once, bucketed by a hash of the doc_id into small groups;
   later passes read the groups in place, so text crosses the network once.
   Texts that equal one of a smaller doc_id go whole and take no further part.
2. Initial q-gram buckets: of every window of ``length`` bytes the q-gram with the
   least hash is its anchor, so equal windows have equal anchors, and about one
   position in sixteen is one.  A group sends each anchor gram once, however often
   it has it; owners of gram ranges tell the groups which grams other documents
   have too.
3. Anchors with shared grams are sent with the bytes around them.  Equal
   surroundings within a group are settled there and sent once.  A gram in very
   many documents is split by its windows, each of which is a bucket of its own.
4. The owner of a bucket refines it: positions are sorted into buckets by 8-grams, and
   buckets by the bucket pointers of later offsets.  Refined pointers take effect at once,
   so buckets refined later in the same pass build on them.  Positions alone in their
   bucket drop out.  The least doc_id of those that start equal windows decides.
5. Runs go back to the groups and are cut from the texts.

Bytes are compared, never only hashes (whole texts by SHA-256).  Defined results: a null text is empty; a
null doc_id counts as larger than any other; rows with the same doc_id do not
remove from each other; texts shorter than ``length`` stay; an empty table gives
an empty table; ``remove_repeats`` returns all columns, with text bytes that no
longer form a character left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_schema, give_back, materialize, partitions, workspace

LENGTH = 50
GRAM = 20
#: Texts of one group, in bytes; a longer text is a group of its own at most.
GROUP_BYTES = 1 << 20
#: Documents that make a gram's bucket one that is split by windows: below it a bucket's
#: surroundings take about half a megabyte at most.
HOT_DOCS = 5_000
LAST_ID = (1 << 63) - 1
BLOCK = 1 << 21
#: Bytes around anchors that are refined at once; one bucket may exceed it.
REFINE_BYTES = 1 << 19
#: Members of buckets that are refined at once; later blocks of a pass build on them.
BLOCK_MEMBERS = 1 << 16
#: Surroundings that a task holds as Python objects at once; one bucket may exceed it.
OWNER_ROWS = 20_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    """256 well spread 64-bit numbers."""
    z = np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def gram_hashes(x: np.ndarray, q: int = GRAM) -> np.ndarray:
    """Hash of the q bytes from each position, by joining halves of doubling size."""
    power, size, h = _MULTIPLIER, 1, _byte_codes()[x]
    out, done = None, 0
    with np.errstate(over="ignore"):
        while size <= q:
            if q & size:
                piece = h[done:]
                out = piece if out is None else out[: len(piece)] * power + piece
                done += size
            if 2 * size > q:
                break
            h = h[: len(h) - size] * power + h[size:]
            power = power * power * np.uint64(2) + np.uint64(1)
            size *= 2
        out = out[: max(0, len(x) - q + 1)]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    """least (or greatest) of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a = least(a[: len(a) - size], a[size:])
        size *= 2
    return least(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of all windows that lie within one text of the joined ``data``."""
    places, grams, width = [], [], length - q + 1
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        x = data[at : at + BLOCK + length - 1]
        h = gram_hashes(x, q)
        low = _sliding(h, width, np.minimum)  # by window
        start = np.arange(at, at + len(low))
        inside = start + length <= ends[np.searchsorted(ends, start, side="right")]
        padded = np.zeros(len(low) + 2 * (width - 1), dtype=np.uint64)
        padded[width - 1 : width - 1 + len(low)] = np.where(inside, low, 0)
        found = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
        places.append(found + at)
        grams.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, gram = np.concatenate(places), np.concatenate(grams)
    place, first = np.unique(place, return_index=True)  # blocks overlap
    return place, gram[first].view(np.int64)


def _joined(table, copies) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, bytes]:
    """Ids and texts in order of id, without copies, the joined bytes and each text's end."""
    gone = set(zip(copies["id"].to_pylist(), copies["tag"].to_pylist()))
    rows = sorted((r for r in zip(table["id"].to_pylist(), table["body"].to_pylist()) if (r[0], zlib.crc32(r[1])) not in gone), key=lambda r: r[0])
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    whole = b"".join(texts)
    return ids, texts, np.frombuffer(whole, dtype=np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64), whole


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of possibly overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def refine(x: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket numbers of the ``starts``: equal exactly if the ``length`` bytes from there are; -1 if alone.

    ``starts`` must leave ``length`` bytes.  Positions are sorted into buckets by their first 8 bytes; a position's
    bucket pointer is where its bucket begins in sorted order, and a bucket knows how many bytes its members share.
    Buckets are refined in blocks by the pointers of the positions that many bytes on.  New pointers and shared
    lengths take effect at once: later blocks of the same pass compare by them, and so reach further than a step
    of 8.  In the end equal windows are neighbours, and neighbours are compared byte for byte.
    """
    size = len(x)
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.r_[x, np.zeros(7, np.uint8)], 8)).view(">u8")[:, 0].astype(np.uint64)
    live = np.flatnonzero(np.cumsum(np.bincount(starts, minlength=size + 1) - np.bincount(starts + length, minlength=size + 1))[:size] > 0)
    ordered = live[np.argsort(grams[live])]
    new = np.r_[True, grams[ordered[1:]] != grams[ordered[:-1]]]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(ordered)])
    pointer, shared = np.full(size + length, -1, dtype=np.int64), np.zeros(size + length, dtype=np.int64)
    pointer[ordered], shared[ordered] = np.repeat(first, count), 8
    open_ = first[count > 1], count[count > 1]
    while len(open_[0]):
        begins, sizes = open_
        parts, found = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_MEMBERS, prepend=-1)), []
        for lo, hi in zip(parts, [*parts[1:], len(begins)]):
            begin, many = begins[lo:hi], sizes[lo:hi]
            place = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
            members = ordered[place]
            known = shared[members]
            ahead = pointer[members + known]  # -1 beyond all windows: such members need no more than is known
            order = np.argsort(np.repeat(begin * (size + 1), many) + ahead)  # buckets stay where they are
            members, ahead, own = members[order], ahead[order], np.repeat(begin, many)
            edge = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
            n = np.diff(np.r_[edge, len(members)])
            reach = np.where(ahead >= 0, shared[members] + shared[members + shared[members]], length)
            ordered[place] = members
            pointer[members], shared[members] = np.repeat(place[edge], n), reach
            more = (n > 1) & (reach[edge] < length)
            found.append((place[edge][more], n[more]))
        open_ = tuple(np.concatenate(c) for c in zip(*found))
    rank = np.argsort(pointer[starts], kind="stable")
    p, q = starts[rank[:-1]], starts[rank[1:]]
    same = pointer[p] == pointer[q]
    apart = np.flatnonzero(~same)
    for at in [*range(0, length - 8, 8), length - 8]:
        apart = apart[grams[p[apart] + at] == grams[q[apart] + at]]
    same[apart] = True
    bucket = np.cumsum(np.r_[True, ~same]) - 1
    out = np.empty(len(starts), dtype=np.int64)
    out[rank] = np.where(np.bincount(bucket)[bucket] > 1, bucket, -1)
    return out


def _refined_runs(shared: list[tuple[int, bytes]], least: list[int], length: int) -> dict[int, list[tuple[int, int]]]:
    """Runs by class (relative to its bytes) that also start in a smaller document of another class."""
    x = np.frombuffer(b"".join(b for _, b in shared), dtype=np.uint8)
    sizes = np.array([len(b) for _, b in shared])
    first = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(shared)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
    bucket = refine(x, starts, length)
    some = np.flatnonzero(bucket >= 0)
    if not len(some):
        return {}
    doc = np.array([least[c] for c, _ in shared], dtype=np.int64)[owner[some]]
    lowest = np.full(int(bucket[some].max()) + 1, LAST_ID, dtype=np.int64)
    np.minimum.at(lowest, bucket[some], doc)
    repeated = some[doc > lowest[bucket[some]]]
    own, at = owner[repeated], starts[repeated] - first[owner[repeated]]
    # windows that follow each other make one run
    edge = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(at) > length)]) if len(own) else own
    runs: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(own)] if len(own) else []):
        runs.setdefault(shared[own[a]][0], []).append((int(at[a]), int(at[b - 1]) + length))
    return runs


def resolve(keys: list[int], docs: list[int], lefts: list[int], bodies: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each occurrence the runs, relative to its bytes, that also start in a smaller document."""
    classes: dict[tuple, int] = {}
    own = [classes.setdefault(k, len(classes)) for k in zip(keys, lefts, bodies)]
    least = [LAST_ID] * len(classes)
    for c, d in zip(own, docs):
        least[c] = min(least[c], d)
    by_key: dict[int, int] = {}
    for key, _, _ in classes:
        by_key[key] = by_key.get(key, 0) + 1
    # buckets with one class are settled; the others are refined, whole buckets at a time
    shared = sorted((key, c, body) for (key, _, body), c in classes.items() if by_key[key] > 1)
    runs: dict[int, list[tuple[int, int]]] = {}
    block: list[tuple[int, bytes]] = []
    size = 0
    for place, (key, c, body) in enumerate(shared):
        block.append((c, body))
        size += len(body)
        if place + 1 == len(shared) or size >= REFINE_BYTES and shared[place + 1][0] != key:
            runs |= _refined_runs(block, least, length)
            block, size = [], 0
    return [[(0, len(b))] if d > least[c] else runs.get(c, []) for c, d, b in zip(own, docs, bodies)]


def _groups(docs: DataFrame, columns: list[str], group_bytes: int) -> tuple[DataFrame, int]:
    """Bucketed table of ``id``, ``body``, ``group`` and ``columns``, and how many groups there are."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(partitions(spark), -(-total // group_bytes))
    key = F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).cast("long")
    held = [F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]
    rows = docs.select(key.alias("id"), body.alias("body"), F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("group"), *held)
    name, parts = f"faultline_texts_{uuid.uuid4().hex}", partitions(spark)
    rows.repartition(parts, "group").write.bucketBy(parts, "group").option("path", workspace(spark, "texts", name)).saveAsTable(name)
    return spark.table(name), count


def _copies(texts: DataFrame) -> DataFrame:
    """group, id, tag, n: texts that equal one of a smaller id.  ``tag`` tells rows of one id apart."""
    keys = texts.select("group", "id", F.crc32("body").alias("tag"), F.octet_length("body").cast("long").alias("n"), F.sha2("body", 256).alias("sha")).filter(F.col("n") >= LENGTH)
    keys = materialize(keys, "text-keys")
    firsts = keys.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    return keys.join(firsts, "sha").filter("id > first").select("group", "id", "tag", "n")


def _shared_grams(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """group, gram, hot: anchor grams of a group that two or more documents have."""
    import pyarrow as pa

    sent, back = arrow_schema("group int, gram long, docs int"), arrow_schema("group int, gram long, hot boolean")

    def grams_of(key, table, gone):
        ids, _, x, ends, _ = _joined(table, gone)
        place, gram = anchors(x, ends)
        doc = np.searchsorted(ends, place, side="right")
        # rows of one id are one document here
        number = np.unique(np.array(ids, dtype=np.int64), return_inverse=True)[1][doc] if len(doc) else doc
        order = np.lexsort((number, gram))
        gram, number = gram[order], number[order]
        new_gram = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)
        new_doc = new_gram | np.r_[True, number[1:] != number[:-1]] if len(gram) else new_gram
        first = np.flatnonzero(new_gram)
        docs = np.add.reduceat(new_doc, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32)
        return pa.table([pa.array(np.full(len(first), key[0].as_py(), np.int32)), pa.array(gram[first]), pa.array(docs, "int32")], schema=sent)

    def owners(batches):
        columns = [[], [], []]
        for batch in batches:
            for k in range(3):
                columns[k].append(batch.column(k).to_numpy())
        if not columns[0]:
            return
        group, gram, docs = (np.concatenate(c) for c in columns)
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
        total = np.add.reduceat(docs[order], first, dtype=np.int64)
        each = np.repeat(total, np.diff(np.r_[first, len(order)]))
        keep = order[each >= 2]
        hot = each[each >= 2] >= HOT_DOCS
        for k in range(0, len(keep), 100_000):
            some = keep[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(group[some]), pa.array(gram[some]), pa.array(hot[k : k + 100_000])], schema=back)

    sums = texts.select("group", "id", "body").groupBy("group").cogroup(copies.groupBy("group")).applyInArrow(grams_of, "group int, gram long, docs int")
    return sums.repartition(partitions(texts.sparkSession), "gram").mapInArrow(owners, "group int, gram long, hot boolean")


def _surroundings(texts: DataFrame, copies: DataFrame, shared: DataFrame) -> DataFrame:
    """key, id, tag, start, left, body: bytes around shared anchors; body is null for a run settled in its group (of ``left`` bytes)."""
    import pyarrow as pa

    ddl = "key long, id long, tag long, start long, left int, body binary"
    schema = arrow_schema(ddl)
    # grams and copies of a group come as one side: a copy has an id and no gram
    known = shared.select("group", "gram", "hot", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("tag"))
    known = known.unionByName(copies.select("group", F.lit(None).cast("long").alias("gram"), F.lit(False).alias("hot"), "id", "tag"))

    def run(key, table, side):
        import pyarrow.compute as pc
        import xxhash

        is_gram = pc.is_valid(side["gram"])
        grams = side.filter(is_gram)
        ids, texts_, x, ends, whole = _joined(table, side.filter(pc.invert(is_gram)))
        tags = [zlib.crc32(t) for t in texts_]
        known, order = np.unique(grams["gram"].to_numpy(), return_index=True)
        hot_of = grams["hot"].to_numpy(zero_copy_only=False)[order] if len(order) else np.zeros(0, bool)
        place, gram = anchors(x, ends) if len(known) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
        take = known[at] == gram if len(known) else np.zeros(0, bool)
        place, gram, hot = place[take], gram[take], hot_of[at[take]]
        doc = np.searchsorted(ends, place, side="right")
        out: list[tuple] = []
        seen: dict = {}
        settled: dict[int, list] = {}

        def send(k: int, d: int, base: int, start: int, left: int, body: bytes) -> None:
            first = seen.setdefault((left, body), ids[d])
            if first == ids[d]:
                out.append((k, ids[d], tags[d], start - base, left, body))
                return
            # a smaller document of this group has the same bytes; anchors come in order, so runs grow at their end
            runs = settled.setdefault(d, [])
            if runs and runs[-1][0] <= start - base <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], start - base + len(body))
            else:
                runs.append([start - base, start - base + len(body)])

        bases = ends - np.array([len(t) for t in texts_], dtype=np.int64) if len(ends) else ends
        after = 0  # windows of a hot gram before this place have been sent for the gram before
        for p, g, h, d, base, end in zip(place.tolist(), gram.tolist(), hot.tolist(), doc.tolist(), bases[doc].tolist(), ends[doc].tolist()):
            start, stop = max(base, p - (LENGTH - GRAM)), min(end, p + LENGTH)
            if not h:
                send(g, d, base, start, p - start, whole[start:stop])
                continue
            for s in range(max(start, after), stop - LENGTH + 1):
                window = whole[s : s + LENGTH]
                send(xxhash.xxh64_intdigest(window) - (1 << 63), d, base, s, -1, window)
            after = max(after, stop - LENGTH + 1)
        del seen
        for d, runs in settled.items():
            out += [(hash((ids[d], a)), ids[d], tags[d], a, b - a, None) for a, b in _merged(runs)]
        columns = list(zip(*out)) or [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return texts.select("group", "id", "body").groupBy("group").cogroup(known.groupBy("group")).applyInArrow(run, ddl)


def _runs(around: DataFrame) -> DataFrame:
    """id, tag, start, stop: removed runs; may overlap."""
    import pyarrow as pa

    ddl = "id long, tag long, start long, stop long"
    schema = arrow_schema(ddl)

    def owners(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        # buckets of a task are worked on in turn, so that few rows are Python objects at once
        turn = np.mod(table["key"].to_numpy(), -(-table.num_rows // OWNER_ROWS))
        for k in range(int(turn.max()) + 1):
            yield from settle(table.filter(pa.array(turn == k)))
        del table
        give_back()

    def settle(table):
        keys, docs, tags, starts, lefts, bodies = [], [], [], [], [], []
        spans: dict[tuple, list] = {}
        for k, d, t, s, left, body in zip(*(c.to_pylist() for c in table.columns)):
            if body is None:
                spans.setdefault((d, t), []).append((s, s + left))
            else:
                keys.append(k), docs.append(d), tags.append(t), starts.append(s), lefts.append(left), bodies.append(body)
        for d, t, s, found in zip(docs, tags, starts, resolve(keys, docs, lefts, bodies)):
            if found:
                spans.setdefault((d, t), []).extend((s + a, s + b) for a, b in found)
        out = [(*d, a, b) for d, found in spans.items() for a, b in _merged(found)]
        for k in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, "int64") for c in zip(*out[k : k + 50_000])], schema=schema)

    return around.repartition(partitions(around.sparkSession), "key").mapInArrow(owners, ddl)


def _cut(docs: DataFrame, columns: list[str], out: str | T.StructType, make) -> DataFrame:
    """``make(body, runs, kept bytes)`` for every row, after its held columns."""
    import pyarrow as pa

    texts, count = _groups(docs, columns, GROUP_BYTES)
    copies = materialize(_copies(texts), "text-copies")
    shared = materialize(_shared_grams(texts, copies), "shared-grams")
    runs = _runs(_surroundings(texts, copies, shared))
    runs = materialize(runs.unionByName(copies.select("id", "tag", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))), "runs")
    runs = runs.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    schema = arrow_schema(out)

    def apply(key, table, found):
        spans: dict[tuple, list] = {}
        for d, t, a, b in zip(*(found[c].to_pylist() for c in ("id", "tag", "start", "stop"))):
            spans.setdefault((d, t), []).append((a, b))
        rows = []
        for d, body in zip(table["id"].to_pylist(), table["body"].to_pylist()):
            own = _merged(spans.get((d, zlib.crc32(body)), []))
            edges = [0, *(e for s in own for e in s), len(body)]
            rows.append(make(body, own, b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))))
        made = list(zip(*rows)) or [[] for _ in range(len(schema) - len(columns))]
        held = [table[f"c{k}"].combine_chunks() for k in range(len(columns))]
        new = [pa.array(c, f.type) for c, f in zip(made, list(schema)[len(columns) :])]
        return pa.table([*[h.cast(f.type) for h, f in zip(held, schema)], *new], schema=schema)

    return texts.groupBy("group").cogroup(runs.groupBy("group")).applyInArrow(apply, out)


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _cut(docs.select("doc_id", "text"), ["doc_id"], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda body, runs, kept: (len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; texts without any stay as they are, null ones null."""
    others = [c for c in docs.columns if c != "text"]
    missing = f"{uuid.uuid4().hex}_null"  # no column of docs is named so
    held = docs.withColumn(missing, F.col("text").isNull())
    out = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in others] + [T.StructField(missing, T.BooleanType()), T.StructField("text", T.StringType())])
    made = _cut(held, [*others, missing], out, lambda body, runs, kept: ((kept if runs else body).decode("utf-8", "ignore"),))
    return made.withColumn("text", F.when(~F.col(missing), F.col("text"))).select(*docs.columns)
