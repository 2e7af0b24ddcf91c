"""Best-fit packing improved by swap-based local search.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt by their
place in the written table into groups of about ``group_items``; a group is packed best fit, largest
first, and then improved: pieces of the emptiest bins are moved, exchanged one
for one, two for one or one for two into fuller bins.  Every step raises the sum
of squared fills, so bins empty and the search ends.  Bins that stay underfull
give their pieces back, and these are dealt into fewer groups for the next
round, until one group holds what is left.  A round handles a small fraction of
the rows of the one before; no task ever holds more than a group.

Defined results: a null or empty text is one piece, its end token; a null doc_id
stays null, and other ids stay what they are; equal rows are separate pieces; a piece of full length is a sequence of its own; an empty
table gives an empty table; extra columns are ignored by ``pieces_of`` and kept
by ``pack``, whose own columns (``sequence_id``, ``offset``) replace any so named.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import id_encoder
from .common import arrow_schema, give_back, materialize

END_ID = 2
CAPACITY = 1024
GROUP_ITEMS = 8192
#: A bin with less free space than this part of its capacity is closed as it is.
CLOSED_PART = 64
#: Rounds over what stays open; the one after closes all.
MOST_ROUNDS = 8


class Bins:
    """Bins of one group: item lengths by bin, all at most ``capacity``."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin with room (a bitset holds the free sizes)."""
        by_slack: dict[int, list[int]] = {}
        free = 0
        for item in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            size = self.lengths[item]
            room = free >> size
            if room:
                slack = (room & -room).bit_length() - 1 + size
                at = by_slack[slack].pop()
                if not by_slack[slack]:
                    free &= ~(1 << slack)
            else:
                at, slack = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[at].append(item)
            self.fill[at] += size
            if left := slack - size:
                by_slack.setdefault(left, []).append(at)
                free |= 1 << left

    def improve(self, sweeps: int = 64) -> int:
        """Local search among underfull bins; returns how many bins it emptied.

        Each sweep works on the emptiest bins in turn.  It ends when no exchange is
        left, or when the free space of all other bins is less than the emptiest
        bin holds: then no sequence of exchanges can empty another.
        """
        emptied = 0
        for _ in range(sweeps):
            order = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (self.fill[b], b))
            room = sum(self.capacity - self.fill[b] for b in order)
            changed = False
            for place, source in enumerate(order):
                if room - (self.capacity - self.fill[source]) < self.fill[source]:
                    break
                # only bins at least as full: then each step raises the sum of squares
                for target in reversed(order[place + 1 :]):
                    while self.fill[target] >= self.fill[source] > 0 and self._step(source, target):
                        changed = True
                    if not self.items[source]:
                        emptied += 1
                        room -= self.capacity
                        break
            if not changed:
                break
        return emptied

    def _step(self, source: int, target: int) -> bool:
        """The one exchange that fills ``target`` most, if there is any."""
        slack = self.capacity - self.fill[target]
        if not slack:
            return False
        size, ours, theirs = self.lengths, self.items[source], self.items[target]
        best, found = 0, None
        give = [((a,), size[a]) for a in ours] + [((a, b), size[a] + size[b]) for k, a in enumerate(ours) for b in ours[k + 1 :]]
        for out, s in give:
            if best < s <= slack:
                best, found = s, (out, ())
            if s > best:
                for b in theirs:
                    if best < s - size[b] <= slack:
                        best, found = s - size[b], (out, (b,))
        for a in ours:
            if size[a] > best:
                for k, b in enumerate(theirs):
                    for c in theirs[k + 1 :]:
                        if best < size[a] - size[b] - size[c] <= slack:
                            best, found = size[a] - size[b] - size[c], ((a,), (b, c))
        if not found:
            return False
        out, back = found
        self.items[source] = [i for i in ours if i not in out] + list(back)
        self.items[target] = [i for i in theirs if i not in back] + list(out)
        self.fill[source] -= best
        self.fill[target] += best
        return True


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item indexes) of one group, full-length items on their own."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    return [b for b in bins.items if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` from 1 to ``capacity``."""
    rest = materialize(pieces.drop("sequence_id", "offset"), "packing-rows")
    columns = rest.columns
    open_, group_of = (f"{uuid.uuid4().hex}_{n}" for n in ("open", "group"))  # no column of the rows is named so
    out_type = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(open_, T.BooleanType())])
    done, level, final = None, 0, False
    count = rest.count()
    while True:
        groups = max(1, -(-count // group_items))
        # by place in the written table, not by content: repeated rows spread over all groups
        # in turn within a partition, from another group on in each, so groups are of a size
        place, part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.xxhash64(F.lit(level), F.spark_partition_id())
        grouped = rest.withColumn(group_of, F.pmod(place + F.pmod(part, F.lit(groups)), F.lit(groups)))
        packer = _group_packer(columns, group_of, arrow_schema(out_type), capacity, level, final or groups == 1)
        packed = materialize(grouped.groupBy(group_of).applyInArrow(packer, out_type), "packing")
        closed = packed.filter(~F.col(open_)).drop(open_)
        done = closed if done is None else done.unionByName(closed)
        rest = packed.filter(open_).select(*columns)
        left = 0 if final or groups == 1 else rest.count()
        if not left:
            return done
        level += 1
        # when a round closes little, what is left does not fit together: the next round closes all
        final = left > 0.9 * count or level >= MOST_ROUNDS
        count = left


def _group_packer(columns: list[str], group_of: str, schema, capacity: int, level: int, last: bool):
    """The function of one round; bins with room stay open unless it is the last round."""

    def pack_group(rows):
        import pyarrow as pa
        import pyarrow.types as kinds

        group = rows[group_of][0].as_py()
        plain = [c for c in columns if c != "length" and (kinds.is_integer(rows.schema.field(c).type) or kinds.is_string(rows.schema.field(c).type))]
        # a fixed order, so a task that runs again gives the same result
        rows = rows.select(columns).sort_by([("length", "descending"), *[(c, "descending") for c in plain]])
        lengths = rows["length"].to_pylist()
        number, offset, still = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for k, items in enumerate(pack_lengths(lengths, capacity)):
            is_open = not last and capacity - sum(lengths[i] for i in items) >= max(1, capacity // CLOSED_PART)
            at = 0
            for i in items:
                number[i], offset[i], still[i] = level << 56 | group << 24 | k, at, is_open
                at += lengths[i]
        return pa.table([*rows.columns, pa.array(number, "int64"), pa.array(offset, "int64"), pa.array(still, "bool")], names=schema.names).cast(schema)

    return pack_group


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids`` as little-endian bytes if asked for).

    A document is the ids of its text, then ``end_id``; only documents over
    ``capacity`` are cut, into full pieces with the short one first.
    """
    import pyarrow as pa

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    schema = arrow_schema(ddl)
    names = schema.names

    def cut(batches):
        encoder = id_encoder(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = {c: [] for c in names}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(text) + end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        row = (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
                        for c, v in zip(names, row):
                            out[c].append(v)
                        if with_ids:
                            out["ids"].append(ids[4 * a : 4 * b])
                yield pa.RecordBatch.from_pydict(out, schema=schema)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, ddl)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(pieces_of(docs, path, capacity), capacity)
