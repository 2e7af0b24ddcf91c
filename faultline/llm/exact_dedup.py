"""Exact deduplication through an extendible-hash index kept in shared files.

1. Every row gives an entry: the lowest ``HASH_BITS`` bits of a 64-bit hash (its key) and
   the SHA-256 of its text (A-Z lower-cased).  Entries are written once to the shared folder
   and summed by key, so copies are one key before anything is dealt out.
2. The directory starts at the depth that the number of keys asks for at least.  While a
   bucket holds more than ``capacity`` keys the directory doubles: the keys of overfull
   buckets, and no others, are dealt by one bit more.  A bucket that fits keeps its local
   depth, and all slots that end in its bits point to it.
3. Keys are placed through the directory, and owner tasks write the pages, each a range of
   (bucket, key).  A key with one entry is a chain of one link.  For a key with more the
   texts are read again and probe the pages for their bucket; owners chain them by bytes,
   so texts that share a hash become separate links.  A page row is a link: its key, digest,
   the doc_id that stays and how many entries it has.
4. Every entry probes the directory for its bucket and the bucket's page for its link, and
   takes doc_id and size from there.  There is no other way to a verdict.

Copies are aggregated before every shuffle, and the probing joins let Spark split skewed
partitions, so a text that a third of all rows hold costs no task more than its share.
DataFrame operations only.

Defined results: a null text counts as empty; a null doc_id is smaller than any
other; rows that repeat both doc_id and text are one document and share its
verdict; an empty table gives an empty table; extra columns are ignored, or kept
as they are by ``drop_exact_duplicates``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, materialize, text_or_empty

BUCKET_CAPACITY = 4096
HASH_BITS = 62
#: Directory slots (24 bytes each) or links (about 150 bytes each) that go to every task; more are joined by shuffle.
BROADCAST_SLOTS, BROADCAST_LINKS = 100_000, 20_000
#: Ids to drop (a long and a digest each) that go to every task.
BROADCAST_KEYS = 100_000


def _low(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << bits) - 1))


def _key(normal: Column, hash_bits: int) -> Column:
    return _low(F.xxhash64(normal), hash_bits)


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a broadcast side if it has so few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def entries_of(docs: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """doc_id, key (low bits of a 64-bit hash), text_sha256 of the normalised text."""
    normal = docs.select("doc_id", lower_ascii(text_or_empty("text")).alias("normal"))
    return normal.select("doc_id", _key(F.col("normal"), hash_bits).alias("key"), F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"))


def directory_of(keys: DataFrame, total: int, capacity: int = BUCKET_CAPACITY, hash_bits: int = HASH_BITS) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) rows and the global depth, by doubling while a bucket is overfull.

    A bucket's number is its bits below a leading one, so numbers differ at every depth.
    """
    depth = min(hash_bits, max(0, (total // max(1, capacity)).bit_length() - 1))
    counted = materialize(keys.groupBy(_low(F.col("key"), depth).alias("prefix")).agg(F.count("*").alias("n")), "directory")
    buckets = counted.filter(F.col("n") <= capacity).select("prefix", F.lit(depth).alias("local_depth"))
    overfull = counted.filter(F.col("n") > capacity).select("prefix")
    while depth < hash_bits and not overfull.isEmpty():
        split = keys.withColumn("prefix", _low(F.col("key"), depth)).join(_bounded(overfull, BROADCAST_SLOTS), "prefix", "left_semi")
        depth += 1
        counted = materialize(split.groupBy(_low(F.col("key"), depth).alias("prefix")).agg(F.count("*").alias("n")), "directory")
        buckets = buckets.unionByName(counted.filter(F.col("n") <= capacity).select("prefix", F.lit(depth).alias("local_depth")))
        overfull = counted.filter(F.col("n") > capacity).select("prefix")
    # out of bits: what is still overfull stays so, and its owner chains more keys
    buckets = buckets.unionByName(overfull.select("prefix", F.lit(depth).alias("local_depth")))
    # a bucket of local depth l owns every slot that ends in its l bits
    upper = F.explode(F.expr(f"sequence(0L, shiftleft(1L, {depth} - local_depth) - 1L)"))
    slots = buckets.select("prefix", "local_depth", upper.alias("upper"))
    return slots.select(F.expr("prefix + shiftleft(upper, local_depth)").alias("slot"), F.expr("prefix + shiftleft(1L, local_depth)").alias("bucket"), "local_depth"), depth


class Index:
    """Directory and pages of an extendible-hash index."""

    def __init__(self, directory: DataFrame, depth: int, pages: DataFrame):
        self.directory, self.depth, self.pages = directory, depth, pages

    def locate(self, rows: DataFrame) -> DataFrame:
        """Adds ``bucket`` to rows that have a ``key``."""
        return rows.withColumn("slot", _low(F.col("key"), self.depth)).join(_bounded(self.directory, BROADCAST_SLOTS), "slot").drop("slot", "local_depth")

    def probe(self, rows: DataFrame, most: int = BROADCAST_LINKS) -> DataFrame:
        """Rows with ``key`` and ``text_sha256`` and their link's ``keep_id`` and ``group_size``."""
        links = self.pages.select("bucket", "key", "text_sha256", "keep_id", "group_size")
        return self.locate(rows).join(_bounded(links, most), ["bucket", "key", "text_sha256"])


def index_of(docs: DataFrame, entries: DataFrame, capacity: int = BUCKET_CAPACITY, hash_bits: int = HASH_BITS) -> Index:
    """Builds directory and pages; a page row: bucket, key, text_sha256, keep_id, group_size."""
    keys = entries.groupBy("key").agg(F.count("*").alias("copies"), F.max("doc_id").alias("keep_id"), F.max("text_sha256").alias("text_sha256"))
    keys = materialize(keys, "index-keys")
    directory, depth = directory_of(keys, keys.count(), capacity, hash_bits)
    index = Index(materialize(directory, "index-directory"), depth, keys)
    placed = materialize(index.locate(keys), "index-placed")
    alone = placed.filter("copies = 1").select("bucket", "key", "text_sha256", "keep_id", F.lit(1).cast("long").alias("group_size"))
    # owners chain the texts of a key that several entries share, byte for byte
    chained = _bounded(placed.filter("copies > 1").select("bucket", "key"), BROADCAST_SLOTS)
    texts = docs.select("doc_id", lower_ascii(text_or_empty("text")).alias("normal")).withColumn("key", _key(F.col("normal"), hash_bits))
    links = index.locate(texts).join(chained, ["bucket", "key"], "left_semi").groupBy("bucket", "key", "normal").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    links = links.select("bucket", "key", F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    pages = alone.unionByName(links).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    index.pages = materialize(pages, "index-pages")
    return index


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_CAPACITY, hash_bits: int = HASH_BITS, broadcast_links: int = BROADCAST_LINKS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    entries = materialize(entries_of(docs, hash_bits), "index-entries")
    found = index_of(docs, entries, capacity, hash_bits).probe(entries, broadcast_links)
    # a lone row without a doc_id stays; in a group an id is larger than none
    kept = F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of rows that repeat a doc_id and text, one.

    Dropped doc_ids are taken out by an anti join, which leaves rows with a null
    doc_id in place; rows repeating an id are told apart by their text's digest.
    """
    verdicts = exact_duplicates(docs)
    own, gone_id, gone_digest = (f"{uuid.uuid4().hex}_{n}" for n in ("digest", "id", "digest"))  # no column of docs is named so
    gone = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_digest))
    gone = _bounded(materialize(gone, "exact-gone"), BROADCAST_KEYS)
    left = docs.withColumn(own, F.sha2(lower_ascii(text_or_empty("text")).cast("binary"), 256))
    left = left.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_digest)), "left_anti")
    repeats = verdicts.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeats.isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
