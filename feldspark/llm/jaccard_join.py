"""Exact Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

Shingles are ordered by their hash. A pair at the threshold shares at least l of the first n - o + l shingles of each
document, where n is the size of its set and o = ceil(threshold * n), for any l up to its overlap. A longer prefix asks
for more shared shingles: each document gets the level l of the least estimated cost, from the frequencies of its
prefix's shingles. Shingles in over HOT documents' prefixes give no candidates; a document's level must be larger than
the number of such shingles in its prefix, so that a pair still shares others. Documents for which no level will do are
*saturated*: nearly all of their set is shared by many, as in large groups of near copies. Pairs of two saturated
documents are found through hubs: all that share a hot shingle of the plain prefix are linked to one of them.

Candidate links make clusters by connected components, and every cluster is verified on whole texts, each document
shipped once: a search from document to document compares each with those not yet reached, on inverted lists, so a group
of near copies costs no more than its links. Clusters over a bound on documents or shingles are verified in blocks of
one class of sizes, since sizes of linked sets are of one class or of neighbouring ones: first every block against the
first ones of its class and of the class below, which a group of near copies comes out of as one component, at a cost in
proportion to its size; then what isn't in a cluster's largest component yet against all blocks of those classes. No
pair of documents is ever output; links come as spanning links.

Copies (equal sets) are one class from the start. Shingles and sets are identified by 64-bit hashes, and a class's text
is found by the key and the hash of a text, so null and repeated keys are as good as others. Defined cases: null, empty
and blank texts have an empty set and are linked with nothing; a text of fewer words than a shingle is one shingle; rows
with a null key belong to their text's class, and it links as any other, but a component's id is its least key that isn't
null (null if all are); repeated rows each give a row; other columns are ignored, whatever their names; of documents at
equal similarity none is preferred, as links are all that counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, stored, take_worker
from ._words import codes, forget, runs, words
from .components import components

#: Documents whose prefixes share a shingle before it is hot; tokens of a bucket of the index.
HOT, BUCKET = 12, 400_000
#: Shingles so frequent that their lists are never gathered: over HEAVY documents in the prefixes of one batch each; how many are told to all (8 bytes each).
HEAVY, MOST_HEAVY = 20_000, 200_000
#: Verification: documents and shingles of a block; rows of the table of members that may be broadcast (24 bytes each).
BLOCK_ROWS, BLOCK_SHINGLES, BROADCAST_ROWS = 2000, 1_500_000, 1_000_000
#: Prefix shingles of a task that are counted together, before those met once are forgotten.
COUNTED = 2_000_000
#: Cost of verifying a candidate, in prefix matches.
VERIFY = 20


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(runs(codes(found), min(width, len(found))))


def signature(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0


def overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of n shares with any of its links, at least."""
    return (percent * n + 99) // 100


def top_level(n: np.ndarray | int, percent: int):
    """The highest level that a set of n may get in its prefix."""
    return np.minimum(overlap(n, percent), 8 + n // 16)


def shingle_sets(documents: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, sig, th, prefix) of every row: size and signature of the set, the text's hash, and the set's prefix at the highest level, as longs. Stored in the shared folder."""
    small_batches(documents.sparkSession)
    schema = documents.select(key).schema.add("n", "long").add("sig", "long").add("th", "long").add("prefix", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(forget)
        for b in batches:
            sizes, sigs, prefixes, lengths = [], [], [], [0]
            for t in b.column(1).to_pylist():
                found = shingles(t, width)
                n = len(found)
                sizes.append(n), sigs.append(signature(found))
                prefixes.append(found[: n - overlap(n, percent) + int(top_level(n, percent))] if n else found)
                lengths.append(len(prefixes[-1]))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), b.column(2), lists], names=schema.names)

    return stored(_texts(documents, key, text).mapInArrow(run, schema), "shingle-sets")


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __text, __th)."""
    return documents.select(F.col(key), F.col(text).cast("string").alias("__text")).withColumn("__th", F.xxhash64("__text"))


def _distinct(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, sig, n, position) of a batch's prefixes, each set once."""
    sig = b.column("sig").to_numpy()
    _, first = np.unique(sig, return_index=True)
    n = b.column("n").to_numpy()
    first = first[n[first] > 0]
    lists = b.column("prefix").take(pa.array(first))
    length = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(first)), length)
    position = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    return flat, sig[first][row], n[first][row], position


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each run of equal values."""
    if not len(values):
        return []
    at = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(values)], strict=True))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by keys, cut so that rows of one key come together (several keys a batch)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        start = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        # rows before `start` end a key; those from it may go on
        if start:
            held.append(b.slice(0, start))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [b.slice(start)]
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles whose lists would be too long for a task. A lone occurrence among COUNTED shingles doesn't count, so what is left has a small share of all at most."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merge() -> None:
            tok, inverse = np.unique(np.concatenate(held[0]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate(held[1]), len(tok)).astype(np.int64)
            held[0][:], held[1][:] = [tok[count > 1]], [count[count > 1]]

        size = 0
        for b in batches:
            tok, count = np.unique(_distinct(b)[0], return_counts=True)
            held[0].append(tok), held[1].append(count)
            size += len(tok)
            if size > COUNTED:
                merge()
                size = len(held[0][0]) // 2
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[1][0])], names=["tok", "c"])

    counts = sets.select("n", "sig", "prefix").mapInArrow(local, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c")).where(F.col("c") > HEAVY)
    return np.array(sorted(r["tok"] for r in counts.orderBy(F.desc("c"), "tok").limit(MOST_HEAVY).collect()), np.int64)


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(sig, n, pos, tok, df) of the prefixes' shingles that several sets have; df is 0 for those of _frequent()."""
    heavy = _frequent(sets)
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(12, total // BUCKET)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok, sig, n, pos = _distinct(b)
            bucket = (tok.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            if len(heavy):
                bucket[np.isin(tok, heavy)] = -1
            order = np.lexsort((tok, bucket))
            runs = _runs(bucket[order])
            columns = [x[order] for x in (tok, sig, n.astype(np.int32), pos.astype(np.int32))]
            packed = [[x[s:e].tobytes() for s, e in runs] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][[s for s, _ in runs]]), *(pa.array(x, pa.binary()) for x in packed)], names=["bucket", "tok", "sig", "n", "pos"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _grouped(batches, ["bucket"]):
            bucket = b.column("bucket").to_numpy()
            for s, e in _runs(bucket):
                part = b.slice(s, e - s)
                tok, sig, n, pos = (np.frombuffer(b"".join(part.column(k).to_pylist()), t) for k, t in (("tok", np.int64), ("sig", np.int64), ("n", np.int32), ("pos", np.int32)))
                order = np.lexsort((sig, tok))
                tok, sig, n, pos = tok[order], sig[order], n[order], pos[order]
                new = np.ones(len(tok), bool)
                new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
                tok, sig, n, pos = tok[new], sig[new], n[new], pos[new]
                _, inverse, count = np.unique(tok, return_inverse=True, return_counts=True)
                df = count[inverse]
                if bucket[s] == -1:
                    df[:] = 0
                keep = df != 1
                yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (sig, n, pos, tok, df)], names=["sig", "n", "pos", "tok", "df"])

    packed = sets.select("n", "sig", "prefix").mapInArrow(deal, "bucket long, tok binary, sig binary, n binary, pos binary")
    # the bucket of heavy shingles isn't gathered: its rows are dealt by their content
    spread = packed.withColumn("salt", F.when(F.col("bucket") == -1, F.xxhash64("sig")).otherwise(F.lit(0)))
    return spread.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").drop("salt").mapInArrow(match, "sig long, n long, pos long, tok long, df long")


def choose_levels(shared: DataFrame, percent: int) -> DataFrame:
    """(tok, sig, n, level, need, hub): the shingles of each set by which candidates are sought, at its level.

    need is how many of them a candidate must share. hub marks the hot shingles of a saturated set's plain prefix.
    """
    names = ["tok", "sig", "n", "level", "need", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _grouped(batches, ["sig"]):
            sig, n, pos, tok, df = (b.column(k).to_numpy() for k in ("sig", "n", "pos", "tok", "df"))
            out: list[list[np.ndarray]] = []
            for s, e in _runs(sig):
                # rows of a heavy shingle may come twice
                p, first = np.unique(pos[s:e], return_index=True)
                t, d, size = tok[s:e][first], df[s:e][first], int(n[s])
                hot = (d == 0) | (d > HOT)
                plain = size - overlap(size, percent)
                # levels that every possible partner's prefix has too
                levels = np.arange(1, int(top_level(overlap(size, percent), percent)) + 1)
                ends = np.searchsorted(p, plain + levels)
                hots = np.concatenate([[0], np.cumsum(hot)])[ends]
                matches = np.concatenate([[0], np.cumsum(np.where(hot, 0, d - 1))])[ends]
                fits = np.flatnonzero(hots < levels)
                if len(fits):
                    needs = (levels - hots)[fits]
                    best = fits[np.argmin(matches[fits] + VERIFY * matches[fits] / needs)]
                    level, need, hub = int(levels[best]), int(levels[best] - hots[best]), np.zeros(len(p), bool)
                else:
                    level, need = int(top_level(size, percent)), 1
                    hub = hot & (p < plain + 1)
                use = (~hot & (p < plain + level)) | hub
                k = int(use.sum())
                if k:
                    out.append([t[use], *(np.full(k, x, np.int64) for x in (sig[s], size, level, need)), hub[use].astype(np.int64)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(6)], names=names)

    return shared.repartition("sig").sortWithinPartitions("sig", "pos").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def candidates(chosen: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets that may be linked: enough shared shingles, or one hub."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _grouped(batches, ["tok"]):
            tok, sig, n, level, need = (b.column(k).to_numpy() for k in ("tok", "sig", "n", "level", "need"))
            for d in range(1, HOT):
                at = np.flatnonzero(tok[d:] == tok[:-d])
                if not len(at):
                    break
                x, y = at, at + d
                near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                x, y = x[near], y[near]
                least = np.where(level[x] < level[y], need[x], np.where(level[x] > level[y], need[y], np.maximum(need[x], need[y])))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[x], sig[y])), pa.array(np.maximum(sig[x], sig[y])), pa.array(least)], names=["a", "b", "need"])

    found = chosen.where("hub = 0").repartition("tok").sortWithinPartitions("tok").mapInArrow(pairs, "a long, b long, need long")
    enough = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    hubs = chosen.where("hub = 1").select("tok", "sig")
    first = stored(hubs.groupBy("tok").agg(F.min("sig").alias("b")), "hubs")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    return enough.unionByName(hubs.join(first, "tok").where("sig <> b").select(F.col("sig").alias("a"), "b").distinct())


def link_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links (index, index) of the components of sets at the threshold, exactly."""
    n = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    own = [code[e - k : e] for e, k in zip(ends, n, strict=True)]

    def index(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = keep[row]
        c, r = code[inside], row[inside]
        order = np.argsort(c, kind="stable")
        return r[order], np.searchsorted(c[order], np.arange(code.max() + 2))

    left = np.ones(len(sets), bool)
    rows, starts = index(left)
    indexed, links = len(sets), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            remaining = int(left.sum())
            if not remaining:
                break
            if remaining * 2 < indexed:
                rows, starts = index(left)
                indexed = remaining
            a = queue.pop()
            s, e = starts[own[a]], starts[own[a] + 1]
            total = int((e - s).sum())
            at = np.repeat(s - np.concatenate([[0], np.cumsum(e - s)[:-1]]), e - s) + np.arange(total)
            common = np.bincount(rows[at], minlength=len(sets))
            near = np.flatnonzero(left & (100 * common >= percent * (n[a] + n - common)) & (common > 0))
            left[near] = False
            links += [(a, int(x)) for x in near]
            queue += near.tolist()
    return links


def verified_links(documents: DataFrame, members: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """Spanning links (a, b) of the sets that members (member, th, sig, cluster, task) bring together, from whole texts."""
    small = members.count() <= BROADCAST_ROWS
    source = _texts(documents, key, text).withColumnRenamed(key, "__key")
    same = (F.col("__th") == F.col("th")) & F.col("__key").eqNullSafe(F.col("member"))
    dealt = source.join(F.broadcast(members) if small else members, same).select("cluster", "task", "sig", "__text")
    keys = ["cluster", "task"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(forget)
        found: list[tuple[int, int]] = []
        now: tuple | None = None
        held: dict[int, np.ndarray] = {}

        def flush() -> None:
            if len(held) > 1:
                names = list(held)
                found.extend((names[x], names[y]) for x, y in link_within(list(held.values()), percent))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return made

        for b in batches:
            for c, task, sig, t in zip(*(b.column(k).to_pylist() for k in (*keys, "sig", "__text")), strict=True):
                if now != (c, task):
                    flush()
                    held.clear()
                    now = c, task
                if sig not in held:
                    got = shingles(t, width)
                    if signature(got) == sig:  # equal hashes may be of other texts too
                        held[sig] = got
            yield out()
        flush()
        yield out()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "sig").mapInArrow(link, "a long, b long")


#: The columns of members by which a text is found.
_MEMBER = ("member", "th", "sig", "cluster")


def _in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """members (member, th, sig, cluster, n) with their class of sizes c (-1 in clusters of one block), the blocks of their cluster's class, and their own."""
    totals = members.groupBy("cluster").agg(((F.count("*") <= BLOCK_ROWS) & (F.sum("n") <= BLOCK_SHINGLES)).alias("one"))
    # a little wider than the ratio of sizes of linked sets, for rounding
    size = F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    classed = members.join(totals, "cluster").withColumn("c", F.when(F.col("one"), F.lit(-1)).otherwise(size)).drop("one")
    blocks = classed.groupBy("cluster", "c").agg(_blocks().alias("blocks"))
    return classed.join(blocks, ["cluster", "c"]).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _each(of: Column, named: str) -> Column:
    return F.explode(F.sequence(F.lit(0), of - 1)).alias(named)


def _against_first(placed: DataFrame) -> DataFrame:
    """Members dealt to tasks: each block with the first one of its class and the first one of the class below."""
    own = placed.select(*_MEMBER, "c", "block")
    large = placed.where("c >= 0")
    classes = large.groupBy("cluster", "c").agg(F.first("blocks").alias("blocks"))
    first = large.where("block = 0").select(*_MEMBER, "c", F.explode(F.array("c", F.col("c") + 1)).alias("to"))
    told = first.join(classes.select("cluster", F.col("c").alias("to"), F.col("blocks").alias("other")), ["cluster", "to"])
    sent = told.select(*_MEMBER, "c", "to", _each(F.col("other"), "block")).where("c <> to OR block <> 0").select(*_MEMBER, F.col("to").alias("c"), "block")
    return own.unionByName(sent).select(*_MEMBER, F.xxhash64("c", "block").alias("task"))


def _against_all(placed: DataFrame, rest: DataFrame) -> DataFrame:
    """Members dealt to tasks: blocks of the rest with all blocks of their class and the neighbouring ones."""
    counts = rest.groupBy("cluster", "c").agg(_blocks().alias("parts"))
    parted = rest.join(counts, ["cluster", "c"]).withColumn("part", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("parts")).cast("int"))
    near = F.explode(F.array(*[F.col("c") + d for d in (-1, 0, 1)]))
    classes = placed.where("c >= 0").groupBy("cluster", "c").agg(F.first("blocks").alias("other")).withColumnRenamed("c", "to")
    left = parted.select(*_MEMBER, "c", "part", near.alias("to")).join(classes, ["cluster", "to"]).select(*_MEMBER, "c", "part", "to", _each(F.col("other"), "block"))
    told = placed.where("c >= 0").select(*_MEMBER, F.col("c").alias("to"), "block", near.alias("near")).join(counts.withColumnRenamed("c", "near"), ["cluster", "near"])
    right = told.select(*_MEMBER, F.col("near").alias("c"), "to", "block", _each(F.col("parts"), "part"))
    return left.unionByName(right).select(*_MEMBER, F.xxhash64("c", "part", "to", "block").alias("task"))


def _roots(documents: DataFrame, classes: DataFrame, clusters: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """(sig, root) of the sets that are linked with others, from candidate clusters (node, root)."""
    own = classes.select("sig", "n", F.col("first.k").alias("member"), F.col("first.th").alias("th"))
    members = clusters.select(F.col("node").alias("sig"), F.col("root").alias("cluster")).join(own, "sig")
    placed = stored(_in_blocks(members, percent), "blocks")
    links = stored(verified_links(documents, stored(_against_first(placed), "members"), width, percent, key, text), "links")
    found = components(links)
    large = placed.where("c >= 0")
    if not large.isEmpty():
        named = large.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        most = named.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root"))["root"].alias("most"))
        rest = stored(named.join(most, "cluster").where("root <> most").select(*_MEMBER, "n", "c"), "rest")
        if not rest.isEmpty():
            dealt = stored(_against_all(placed, rest), "members")
            found = components(links.unionByName(verified_links(documents, dealt, width, percent, key, text)))
    return found.select(F.col("node").alias("sig"), "root")


def _labelled(documents: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """(key, th, n, component_id, first_key, first_th) of every row; first is the row of a component with the least key (nulls last), null for an empty set."""
    sets = shingle_sets(documents, width, percent, key, text)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "th"))
    classes = sets.where("n > 0").groupBy("sig").agg(F.max("n").alias("n"), first.alias("first"))
    chosen = stored(choose_levels(shared_tokens(sets), percent), "prefixes")
    found = _roots(documents, classes, components(candidates(chosen, percent)), width, percent, key, text)
    named = classes.join(found, "sig", "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    labels = named.join(least, "root").select(F.col("sig").alias("__sig"), F.col("least.k").alias("first_key"), F.col("least.th").alias("first_th"))
    own = sets.select(F.col(key), "th", "n", F.when(F.col("n") > 0, F.col("sig")).alias("__own"))
    joined = own.join(labels, F.col("__own") == F.col("__sig"), "left")
    return joined.select(key, "th", "n", F.coalesce("first_key", key).alias("component_id"), "first_key", "first_th")


def jaccard_components(documents: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the least key that links reach, its own for an empty set.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of shingles of `width` words.
    """
    return _labelled(documents, width, percent, key, text).select(key, F.col("n").alias("n_shingles"), "component_id")


def keep_representatives(documents: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without those of a component that aren't its first, the least key (nulls last); of rows with equal key and text one stays.

    A document is a key with a text, so of a key with two texts each is judged by itself. Rows of null key and an empty
    set all stay. What goes is broadcast while it is little (16 bytes each, BROADCAST_ROWS at most), and joined by
    shuffle beyond.
    """
    found = stored(_labelled(documents, width, percent, key, text).select(F.col(key).alias("__k"), F.col("th").alias("__h"), "n", "first_key", "first_th"), "components")
    first = F.col("__k").eqNullSafe(F.col("first_key")) & (F.col("__h") == F.col("first_th"))
    gone = found.where((F.col("n") > 0) & ~first).select("__k", "__h")
    source = documents.withColumn("__th", F.xxhash64(F.col(f"`{text}`").cast("string")))
    same = F.col(f"`{key}`").eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__h"))

    def without(df: DataFrame, rows: DataFrame) -> DataFrame:
        return df.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same, "left_anti")

    repeated = stored(found.where(F.col("__k").isNotNull() | (F.col("n") > 0)).groupBy("__k", "__h").count().where("count > 1").select("__k", "__h"), "repeated")
    if repeated.isEmpty():
        return without(source, gone).select(*[f"`{c}`" for c in documents.columns])
    once = without(source, gone.unionByName(repeated))
    more = without(source.join(repeated, same, "left_semi"), gone).dropDuplicates([key, text])
    return once.unionByName(more).select(*[f"`{c}`" for c in documents.columns])
