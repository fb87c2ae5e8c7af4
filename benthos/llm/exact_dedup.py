"""Exact duplicates through an extendible-hash index on shared files (DataFrame operations only).

Keys are 64-bit hashes of the texts without white space. The directory is addressed by the
leading bits of a key. It starts with one bucket; a bucket that holds more than ``capacity``
distinct keys is split in two, and the directory doubles when the split bucket used all of
its bits. How far that goes depends only on how many keys each prefix has, so it is computed
from the prefix counts: a bucket is a prefix that is not overfull below one that is. The
directory doubles until no bucket is overfull (or all 64 bits are used).

Rows are dealt to owner tasks by ranges of (bucket, key), so a bucket's rows meet in one
task or in neighbouring ones. The owner chains texts that collide on a key and compares them
byte by byte (they are its grouping keys). A key that repeats more often than ``hot`` of all
rows is dealt to several owners by a salt, each of which hands on one entry per text; the
entries meet by the text's digest. Owners write their buckets as files, sorted by key, and
each row looks its text up in the bucket that the directory names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.session import materialize

WHITE = r"[\x20\x09-\x0D]+"
#: A directory or a list of hot keys of this many rows at most (16 bytes each) is sent to all tasks.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that an owner task takes.
OWNER_BYTES = 32 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _prefix(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for each directory slot with keys, and the global depth.

    ``keys`` has the distinct ``key`` of all rows. A slot is a prefix of global depth; a bucket is
    named by the first slot that points to it.
    """
    n = keys.count()
    depth = min(62, max(1, (max(1, n) // capacity).bit_length() + 2))
    while True:
        counts = materialize(keys.groupBy(_prefix("key", depth).alias("slot")).agg(F.count("*").alias("n")), "exact-counts")
        if depth >= 62 or not (counts.agg(F.max("n")).first()[0] or 0) > capacity:
            break
        depth = min(62, depth + 4)  # hashes that crowd under one prefix: double on
    each = counts.select("n", "slot", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    sizes = each.groupBy("depth", F.expr(f"shiftrightunsigned(slot, {depth} - depth)").alias("prefix")).agg(F.sum("n").alias("keys"))
    above = sizes.where(F.col("keys") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = sizes.where((F.col("keys") <= capacity) | (F.col("depth") == depth)).withColumn("parent", F.shiftrightunsigned("prefix", 1))
    buckets = fits.join(above, ["depth", "parent"]).unionByName(fits.where("depth = 0").select("depth", "parent", "prefix", "keys"))
    named = buckets.select(F.col("depth").alias("local_depth"), F.expr(f"shiftleft(prefix, {depth} - depth)").alias("bucket"))
    slots = named.select("local_depth", "bucket", F.explode(F.sequence("bucket", F.expr(f"bucket + shiftleft(1L, {depth} - local_depth) - 1"))).alias("slot"))
    return slots.select("slot", "bucket", "local_depth"), depth


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is known to be short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def exact_duplicates(docs: DataFrame, capacity: int = 100_000, hot: float = 0.001) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth) per row of ``docs``.

    Texts are equal when identical after white space [\\x20\\x09-\\x0D] is deleted; null counts
    as empty, and all empty texts are one group. Of equal texts the row with the most code
    points stays, then the smallest doc_id (null last). Repeated rows with one doc_id share
    its fate. Columns other than doc_id and text are not read. Empty in, empty out.
    """
    norm = normalised(F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"), norm.alias("norm"))
    keyed = keyed.withColumn("key", F.xxhash64("norm"))
    rows = materialize(keyed.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("bytes")), "exact-rows")
    total, size = rows.agg(F.count("*"), F.sum("bytes")).first()
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    slots, depth = directory(keys.select("key"), capacity)
    slots = _small(materialize(slots, "exact-directory"))
    # fewer than 1 / hot keys, by their definition
    often = F.broadcast(materialize(keys.where(F.col("n") > F.greatest(F.lit(1000), F.lit(total * hot))).select("key", F.lit(True).alias("often")), "exact-hot"))

    # one number orders rows by size, then by smallest doc_id (a null one last); both parts can be read back
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    rank = F.coalesce(number(2**63) - F.col("doc_id").cast("decimal(20,0)"), number(0)).cast("decimal(20,0)")
    order = (F.col("size").cast("decimal(12,0)") * number(2**65) + rank).cast("decimal(38,0)")
    placed = keyed.withColumn("slot", _prefix("key", depth)).join(slots, "slot").join(often, "key", "left")
    salted = placed.select("bucket", "local_depth", "key", F.when(F.col("often"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(64))).otherwise(-1).alias("salt"), "norm", order.alias("order"))
    owners = max(8, -(-(size or 0) // OWNER_BYTES))
    owned = salted.repartitionByRange(owners, "bucket", "key", "salt")
    chained = owned.groupBy("bucket", "local_depth", "key", "salt", "norm").agg(F.count("*").alias("group_size"), F.max("order").alias("best"))
    entries = chained.select("bucket", "local_depth", "key", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best")
    entries = entries.groupBy("bucket", "local_depth", "key", "text_sha256").agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
    low = (F.col("best") % number(2**65)).cast("decimal(20,0)")
    keep = F.when(low > 0, (number(2**63) - low).cast("long"))
    index = entries.select("bucket", "local_depth", "key", "text_sha256", "group_size", keep.alias("keep_id"))
    index = materialize(index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "exact-index")

    asked = rows.withColumn("slot", _prefix("key", depth)).join(slots.select("slot", "bucket"), "slot").join(often, "key", "left").drop("slot", "bytes")
    found = asked.where("often is null").join(index, ["bucket", "key", "text_sha256"])
    hottest = index.join(often, "key", "left_semi")
    found = found.unionByName(asked.where("often").join(_small(hottest), ["bucket", "key", "text_sha256"]))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256", "bucket", "local_depth")
