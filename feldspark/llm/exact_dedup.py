"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions alone.

Texts are equal when they are identical without the characters of `SPACE`. Every row has an entry of the index: the hash
of its normalised text (the key), a digest, and what decides which row stays. The directory begins with one bucket and
doubles while a bucket holds more keys than a page: an overfull bucket of local depth d is split by the next bit of its
keys, the others are pointed to by twice as many slots. Buckets are ranges of keys, and tasks own ranges of buckets: their
files hold the links of each key's chain. A chain has one link for each different text of a key, so keys that collide are
parted; that the texts of a link are equal is found by comparing their bytes, the least with the greatest of them.

Copies are combined before each shuffle (sums, least and greatest), so a text's rows cost a task one row of each task before
it. Rows of the largest groups, of which there can be no more than `HOT`, find theirs in a broadcast table, the others by a
shuffled join.

Defined cases: a null text is empty; a null key comes after all others; of rows that are repeated with key and length one
stays, the first as the table is read; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Characters that normalisation deletes, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: Different keys of a bucket, at the least, and doublings of the directory at most (its slots are broadcast: 4 MB).
PAGE, MOST_DEPTH = 256, 18
#: A group with over one in HOT of all rows is hot, so that there are fewer than HOT such groups (80 bytes each).
HOT = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def hashed(text: Column, bits: int = 64) -> Column:
    """The key of a normalised text, of which the first bits count: few of them make texts collide."""
    return F.xxhash64(text).bitwiseAND(F.lit(-1 << (64 - bits)))


def prefix(key: Column, depth: Column | int) -> Column:
    """The first bits of a key, as many as depth says."""
    at = F.lit(depth) if isinstance(depth, int) else depth
    # 64 places would be none
    return F.when(at == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(64) - at).cast("int")))


def directory(keys: DataFrame, page: int = PAGE, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, int]:
    """((slot, bucket, first), depth): the bucket that each slot of a directory of 2 ** depth slots points to, for a table of different keys.

    A bucket is split as long as it holds over a page of keys, and its half is as full at most; so the buckets of the
    doubled directory are those half-open ranges of keys that hold a page at most while the range they were split from
    holds more. `bucket` tells a bucket's prefix and local depth, `first` is its first slot. Pages grow beyond `page`
    where keys would need a directory of over most_depth doublings; keys that the last doubling can't part share a bucket.
    """
    n = keys.count()
    page = max(page, n >> (most_depth - 2))
    finest = min(most_depth, max(1, (n // page).bit_length() + 3))
    fine = keys.groupBy(prefix(F.col("key"), finest).alias("slot")).count()
    ranges = fine.select(F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"), "slot", "count")
    loads = stored(ranges.groupBy("depth", F.call_function("shiftright", F.col("slot"), F.lit(finest) - F.col("depth")).alias("prefix")).agg(F.sum("count").alias("load")), "dedup_loads")
    depth = min(finest, loads.where(F.col("load") > page).agg(F.coalesce(F.max("depth") + 1, F.lit(0)).alias("d")).first()["d"])
    split = loads.where((F.col("load") > page) & (F.col("depth") < depth)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("of"))
    whole = loads.where((F.col("load") <= page) | (F.col("depth") == depth)).where(F.col("depth") <= depth).withColumn("of", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    buckets = whole.join(F.broadcast(split), ["depth", "of"], "left_semi").unionByName(whole.where("depth = 0"))
    span = F.lit(depth) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), span)
    slots = F.explode(F.sequence(first, F.call_function("shiftleft", F.col("prefix") + 1, span) - 1))
    return stored(buckets.select(slots.alias("slot"), (F.col("prefix") * 64 + F.col("depth")).alias("bucket"), first.alias("first")), "dedup_directory"), depth


def index(documents: DataFrame, key: str = "doc_id", text: str = "text", page: int = PAGE, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(entries, links) of a table's texts, both stored.

    entries: (row, key column, n_chars, key, digest) for each row; links: (bucket, key, digest, group_size, n_chars, keep_id,
    keep_row) for each different text, in files by ranges of buckets.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = documents.select(F.col(key).alias("__id"), F.length(raw).alias("n_chars"), normalised(F.col(text)).alias("norm"))
    keyed = texts.withColumns({"key": hashed(F.col("norm"), bits), "digest": F.unhex(F.sha2("norm", 256))})
    entries = stored(keyed.select(F.monotonically_increasing_id().alias("row"), "__id", "n_chars", "key", "digest"), "dedup_entries")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("row").alias("row")))
    groups = stored(entries.groupBy("key", "digest").agg(F.count("*").alias("group_size"), best.alias("best")), "dedup_groups")
    slots, depth = directory(groups.select("key").distinct(), page)
    placed = keyed.select("key", "digest", "norm", prefix(F.col("key"), depth).alias("slot")).join(F.broadcast(slots), "slot")
    chains = placed.groupBy("bucket", "first", "key", "digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    compared = chains.select("bucket", "first", "key", "digest", (F.col("low") == F.col("high")).alias("same"))
    # a digest of two texts would be one of SHA-256 and of the key at once
    sized = F.when(F.col("same"), F.col("group_size")).otherwise(F.raise_error(F.lit("different texts of one digest")).cast("long"))
    found = compared.join(groups, ["key", "digest"]).select("bucket", "first", "key", "digest", sized.alias("group_size"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    return entries, stored(found.repartitionByRange("first").sortWithinPartitions("first", "key", "digest"), "dedup_links")


def mark_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", page: int = PAGE, bits: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row: which row of its group stays, how many rows it has, and the normalised text's digest."""
    entries, links = index(documents, key, text, page, bits)
    own = links.select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), "group_size", "keep_id", "keep_row")
    hot = own.where(F.col("group_size") > F.lit(entries.count() // HOT))
    same = (F.col("key") == F.col("__key")) & (F.col("digest") == F.col("__digest"))
    told = entries.join(F.broadcast(hot), same, "left")
    rest = told.where("__key IS NULL").select(*entries.columns).join(own.where(F.col("group_size") <= F.lit(entries.count() // HOT)), same)
    found = told.where("__key IS NOT NULL").unionByName(rest)
    return found.select(F.col("__id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents that stay, all their columns; keys must be unique."""
    kept = mark_duplicates(documents, key, text).where("kept").select(F.col(key).alias("__kept"))
    return documents.join(kept, F.col(key).eqNullSafe(F.col("__kept"))).select(*[F.col(f"`{c}`") for c in documents.columns])
