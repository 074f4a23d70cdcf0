"""Stupid-backoff scores of documents, with n-gram counts of the whole corpus.

Documents are packed into blocks. A block asks for each of its distinct n-grams once, with its own count: these rows
are the exploded n-grams, combined on the map side. They are dealt by hash into the partitions of the count tables, one
table for each order, which add the counts up and tell each block how often others have them; blocks and answers are joined, and the scores are summed for each document. An n-gram, however frequent, is one
entry for each block, so no key is hot. Blocks are a bucketed table, so the join moves the answers only.

A block's n-grams go to every partition of the count tables. Blocks and partitions both grow with the root of the
corpus, once it is large, so that what a block sends to a partition is SLICE n-grams at least (about): the rows that
are shuffled stay in proportion to the corpus. A partition holds the entries of its hashes alone, one for each block at
most of any n-gram.

The score of a word after its context is the count of both over the count of the context; where that is 0, ALPHA times
the score with a shorter context; at last count over words in the corpus, and for words met nowhere else ALPHA / words.
With leave_one_out, a document's own n-grams don't count for its score, which would else be that of a text seen before.

Words are parted by ASCII white space, A-Z in lower case; n-grams are identified by 64-bit hashes. Defined cases: texts
without words have 0 tokens, logprob 0 and no mean; a corpus of one document scores every word ALPHA ** order / 1;
repeated rows are documents of their own; a text is in one block, however long; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint_dir, small_batches, take_worker
from ._words import codes, forget, runs

#: Weight of a shorter context; words of an n-gram in production.
ALPHA, ORDER = 0.4, 3
#: Bytes of text in a block, entries in a partition of the count tables (about, at least); entries that a block sends to a partition (about, at least).
BLOCK_BYTES, BUCKET, SLICE = 8 << 20, 1_500_000, 64
#: Bytes of text to a word, for the size of blocks before words are counted.
WORD_BYTES = 6


def _side(words: float, order: int) -> float:
    """Entries of a block and of a partition at which each pair of them shares SLICE."""
    return math.sqrt(SLICE * order * max(words, 1))


def pack(documents: DataFrame, order: int, key: str, text: str) -> DataFrame:
    """(block, keys, sizes, words, body): blocks of whole texts, compressed; a table of the shared folder, bucketed by block."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema[key].dataType.simpleString()
    source = documents.select(F.col(key), F.col(text).cast("string").alias("__text"))
    size = source.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    most = max(BLOCK_BYTES, int(_side(size / WORD_BYTES, order) / order * WORD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        held: list[bytes] = []
        total, press = 0, zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            body = b"".join(held)
            ids = pa.concat_arrays(keys)
            one = [0, len(ids)]
            block = xxhash.xxh3_64_intdigest(body + repr(ids[0]).encode()) >> 1
            sizes = pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.array([len(x) for x in held], pa.int64()))
            made = pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array(one, pa.int32()), ids), sizes, pa.array([sum(len(x.split()) for x in held)], pa.int64()), pa.array([press.compress(body)], pa.binary())],
                names=["block", "keys", "sizes", "words", "body"],
            )
            keys.clear(), held.clear()
            return made

        for b in batches:
            start = 0
            for i, t in enumerate(b.column(1).to_pylist()):
                held.append((t or "").encode("utf-8"))
                total += len(held[-1])
                if total >= most:
                    keys.append(b.column(0).slice(start, i + 1 - start))
                    start, total = i + 1, 0
                    yield out()
            if start < b.num_rows:
                keys.append(b.column(0).slice(start))
        if held:
            yield out()

    packed = source.mapInArrow(run, f"block long, keys array<{kind}>, sizes array<long>, words long, body binary")
    name = f"text_blocks_{uuid.uuid4().hex}"
    files = max(spark.sparkContext.defaultParallelism, min(100_000, 1 + size // (4 * most)))
    packed.write.bucketBy(files, "block").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    table = spark.table(name)
    # the plan knows files and buckets; the name is needed no more
    spark.sql(f"DROP TABLE {name}")
    return table


def _unpack(sizes: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, number of its document) of a block."""
    whole = zstandard.ZstdDecompressor().decompress(body)
    found: list[np.ndarray] = []
    at = 0
    for size in sizes.tolist():
        found.append(codes(whole[at : at + size].lower().split()))
        at += size
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.repeat(np.arange(len(found)), [len(x) for x in found])


def _grams(code: np.ndarray, document: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the last word) of the n-grams that lie in one document."""
    every = runs(code, n)
    inside = document[: len(every)] == document[n - 1 :] if len(every) else np.zeros(0, bool)
    return every[inside], np.flatnonzero(inside) + n - 1


def _ends(every: np.ndarray, bits: int) -> np.ndarray:
    """Where the slices of sorted hashes begin and end; a hash's partition is its first `bits` bits."""
    if not bits:
        return np.array([0, len(every)])
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(every, borders), [len(every)]])


def _elsewhere(asked: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (hashes, counts) how often the others have them."""
    counts = np.concatenate([c for _, c in asked])
    every, inverse = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
    sums = np.bincount(inverse, counts.astype(np.float64), len(every)).astype(np.int64)[inverse] - counts
    return np.split(sums, np.cumsum([len(h) for h, _ in asked])[:-1])


def score_block(code: np.ndarray, document: np.ndarray, documents: int, order: int, alpha: float, leave_one_out: bool, corpus: int, elsewhere) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log10 scores) of a block's documents; elsewhere gives, for an order and all the block's distinct hashes of it, sorted, the counts outside the block."""
    n = len(code)
    size = np.bincount(document, minlength=documents)
    if not n:
        return size, np.zeros(documents)
    total = np.maximum(float(corpus) - (size[document] if leave_one_out else np.zeros(n)), 1)
    # counts of the n-gram that ends at a word, by order; -1 where the document has none
    counts = [total]
    for k in range(1, order + 1):
        h, last = _grams(code, document, k)
        every, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        count = (elsewhere(k, every) + times)[inverse].astype(np.float64)
        if leave_one_out:
            # what the block has once, its document has once
            count -= 1
            more = np.flatnonzero(times[inverse] > 1)
            _, own, often = np.unique(document[last[more]] * np.int64(len(every)) + inverse[more], return_inverse=True, return_counts=True)
            count[more] -= often[own] - 1
        counts.append(np.full(n, -1.0))
        counts[k][last] = count
    score = np.full(n, np.nan)
    weight = np.ones(n)
    for k in range(order, 0, -1):
        # the context of an n-gram ends one word before
        context = total if k == 1 else np.concatenate([[0.0], counts[k - 1][:-1]])
        hit = np.isnan(score) & (counts[k] > 0)
        score[hit] = weight[hit] * counts[k][hit] / context[hit]
        weight[np.isnan(score) & (counts[k] == 0)] *= alpha
    score = np.where(np.isnan(score), weight / total, score)
    return size, np.bincount(document, np.log10(score), documents).astype(np.float64)


def score_documents(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_one_out: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, logprob, mean_logprob) of every row; logarithms to base 10, rounded to 6 digits."""
    blocks = pack(documents, order, key, text)
    corpus = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, corpus / max(BUCKET, _side(corpus, order))))))
    kind = documents.schema[key].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(forget)
        for b in batches:
            for block, sizes, body in zip(b.column("block").to_pylist(), b.column("sizes"), b.column("body"), strict=True):
                code, document = _unpack(sizes.values.to_numpy(), body.as_py())
                for k in range(1, order + 1):
                    every, times = np.unique(_grams(code, document, k)[0], return_counts=True)
                    ends = _ends(every, bits)
                    used = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
                    slices = [slice(ends[j], ends[j + 1]) for j in used]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k << bits | j for j in used], pa.int64()), pa.array([block] * len(used), pa.int64()), pa.array([_put(every[x], j, bits) for j, x in zip(used, slices, strict=True)], pa.binary()), pa.array([_small(times[x] - 1) for x in slices], pa.binary())],
                        names=["part", "block", "grams", "times"],
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            found = _elsewhere([(_got(g, now & (1 << bits) - 1, bits), _large(t) + 1) for _, g, t in held])
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([now] * len(held), pa.int64()), pa.array([_small(x) for x in found], pa.binary())], names=["block", "part", "elsewhere"])
            held.clear()
            return made

        for b in batches:
            for part, block, grams, times in zip(*(b.column(k).to_pylist() for k in ("part", "block", "grams", "times")), strict=True):
                if part != now and held:
                    yield out()
                now = part
                held.append((block, grams, times))
        if held:
            yield out()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        take_worker(forget)
        found: list[pa.Table] = []
        answers = dict(zip(right.column("part").to_pylist(), right.column("elsewhere").to_pylist(), strict=True))
        # blocks of equal texts and keys may share a number; they get equal answers
        parts = sorted(answers)

        def told(k: int, _: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(_large(answers[p]) for p in parts if p >> bits == k)])

        for i in range(left.num_rows):
            keys = left.column("keys")[i].values
            code, document = _unpack(left.column("sizes")[i].values.to_numpy(), left.column("body")[i].as_py())
            n, log = score_block(code, document, len(keys), order, alpha, leave_one_out, corpus, told)
            mean = pa.array(np.round(log / np.maximum(n, 1), 6), mask=n == 0)
            found.append(pa.table([keys, pa.array(n, pa.int64()), pa.array(np.round(log, 6)), mean], names=[key, "n_tokens", "logprob", "mean_logprob"]))
        return pa.concat_tables(found)

    asked = blocks.select("block", "sizes", "body").mapInArrow(ask, "part long, block long, grams binary, times binary")
    told = asked.repartition("part").sortWithinPartitions("part").mapInArrow(add, "block long, part long, elsewhere binary")
    return blocks.drop("words").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"{key} {kind}, n_tokens long, logprob double, mean_logprob double")


#: Low bytes of a difference of hashes, which are evenly spread: stored as they are. The high ones are nearly all alike.
LOW = 5


def _put(h: np.ndarray, part: int, bits: int) -> bytes:
    """Sorted hashes of a partition as their differences, the bytes of a rank together."""
    first = np.uint64(part << 64 - bits if bits else 0)
    planes = np.ascontiguousarray(np.diff(h, prepend=first).view(np.uint8).reshape(-1, 8).T)
    return len(h).to_bytes(4, "little") + planes[:LOW].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[LOW:].tobytes())


def _got(raw: bytes, part: int, bits: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(raw[4 : 4 + LOW * n] + zstandard.ZstdDecompressor().decompress(raw[4 + LOW * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(part << 64 - bits if bits else 0)


def _small(x: np.ndarray) -> bytes:
    """Counts in bytes, those from 255 on in eight more each at the end; compressed."""
    large = x >= 255
    return zstandard.ZstdCompressor(level=1).compress(np.minimum(x, 255).astype(np.uint8).tobytes() + x[large].astype(np.int64).tobytes() + int(large.sum()).to_bytes(4, "little"))


def _large(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    many = int.from_bytes(raw[-4:], "little")
    head = np.frombuffer(raw, np.uint8, len(raw) - 4 - 8 * many).astype(np.int64)
    head[head == 255] = np.frombuffer(raw, np.int64, many, len(head))
    return head
