"""Collocations of a corpus: phrases by how much oftener they occur than their parts, by position bitmaps of words.

Texts are dealt into shards of positions. A shard has a compressed bitmap of the positions of each word: bytes of eight
positions, those without a bit left out; a position without a word lies between pieces, so that no phrase passes their
border. A phrase's bitmap (of where it ends) is extended by shifting it by one position and combining it by AND with the
bitmaps of the words that share its bytes; what is left are the bitmaps of the longer phrases, and their population counts
are the shard's numbers of occurrences. Phrases are extended depth-first, the phrases of some first words after the other,
and counts are summed over all shards. There is a pass over the corpus for each length, in which a branch is followed only
where the counts of the pass before say that its phrases can be frequent.

What a shard knows of those counts is a bit table of fixed size at most (`MOST_BITS`), the same for all. It lets some rare
phrases through, never holds back a frequent one, and all that is counted is counted exactly; in a corpus for which the
table is too small more rare phrases reach the sums, nothing else.

Words stand as 64-bit hashes of language and word while phrases are counted; that no two have the same hash is checked over
all words (`collisions`), and other seeds are taken if some do.

Defined cases: null texts are empty, null languages are `und`; repeated rows are texts of their own; ties are ordered by
the phrase; a corpus without words gives an empty result; other columns aren't read. A piece is never cut, so a shard
holds as many positions as its longest piece, at the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import small_batches, stored
from ._words import ODD, mix

#: Least occurrences of a candidate, words of the longest, percent of its occurrences that a longer one takes over, and how many are given for a language.
LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
#: Positions of a shard, about; entries that are extended at a time; bits of a table for each phrase, and of a table at most (32 MB).
POSITIONS, CHUNK, BITS, MOST_BITS = 1 << 20, 1 << 16, 16, 1 << 28
#: Parts of a language that are ranked before all of it is.
PARTS = 64
#: Ends of pieces become one mark, tabs become spaces.
GAP = b"."
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", GAP * 10 + b" ")


class _Vocabulary(dict):
    """Numbers of a language's words in a shard; all languages' words are numbered together."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        self.lang, self.words = lang, words
        self[GAP] = -1

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append((self.lang, word))
        return n


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in lower case, with a mark after each piece."""
    return text.lower().translate(_MARKS).replace(GAP, b" . ").split() + [GAP]


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[tuple[str, bytes]]]]:
    """(number of the word at each position, -1 for none; the words) for each shard of a partition; batches have lang and text as bytes."""
    words: list[tuple[str, bytes]] = []
    known: dict[str, _Vocabulary] = {}
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            own = known.get(lang)
            if own is None:
                own = known[lang] = _Vocabulary(lang, words)
            found = tokens(text.as_py())
            held.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
            n += len(found)
            if n >= size:
                yield np.concatenate(held), words
                words, known, held, n = [], {}, [], 0
    if held:
        yield np.concatenate(held), words


def hashes(words: list[tuple[str, bytes]], seed: int) -> np.ndarray:
    """64-bit hashes of language and word; the language's length parts the two."""
    return np.fromiter((xxhash.xxh3_64_intdigest(b"%d:%s%s" % (len(lang), lang.encode(), word), seed) for lang, word in words), np.uint64, len(words))


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of a phrase's words."""
    return reduce(lambda a, b: mix(a * ODD + b), columns)


class Told:
    """Which phrases may be frequent: a table of bits, two for each phrase."""

    def __init__(self, words: np.ndarray):
        self.words, self.size = words, np.uint64(len(words) * 64)

    @staticmethod
    def places(hashed: np.ndarray, size: int) -> list[np.ndarray]:
        return [hashed & np.uint64(size - 1), (hashed >> np.uint64(32)) & np.uint64(size - 1)]

    def may(self, hashed: np.ndarray) -> np.ndarray:
        first, second = ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) for p in self.places(hashed, int(self.size)))
        return (first & second).astype(bool)


class Bitmaps:
    """The compressed bitmaps of a shard's words, by byte and by word."""

    def __init__(self, ids: np.ndarray, keep: np.ndarray):
        at = np.flatnonzero(ids >= 0)
        at = at[keep[ids[at]]]
        key = (at >> 3) << 32 | ids[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        bits = (1 << (at[order] & 7)).astype(np.uint8)
        self.mask = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        self.byte, self.word = key[first] >> 32, (key[first] & 0xFFFFFFFF).astype(np.int32)
        # where the entries of a byte begin; a carry may lie beyond the last
        self.start = np.searchsorted(self.byte, np.arange((len(ids) >> 3) + 3))
        self.by_word = np.argsort(self.word, kind="stable")

    def firsts(self, size: int) -> Iterator[np.ndarray]:
        """Entries of some words at a time, all of a word together."""
        word = self.word[self.by_word]
        begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        at = 0
        while at < len(word):
            k = np.searchsorted(begins, at + size)
            end = int(begins[k]) if k < len(begins) else len(word)
            yield self.by_word[at:end]
            at = end

    def extended(self, byte: np.ndarray, mask: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, word, byte, mask) of what is left of each bitmap, shifted by one position, in those of the words after it."""
        shifted = mask.astype(np.uint16) << 1
        over = np.flatnonzero(shifted >> 8)
        rows = np.r_[np.arange(len(mask)), over]
        bytes_ = np.r_[byte, byte[over] + 1]
        masks = np.r_[shifted & 0xFF, shifted[over] >> 8].astype(np.uint8)
        for i in range(0, len(rows), size):
            own, to = rows[i : i + size], bytes_[i : i + size]
            begin, n = self.start[to], self.start[to + 1] - self.start[to]
            ends = np.cumsum(n)
            each = np.repeat(np.arange(len(own)), n)
            entry = np.arange(len(each)) + np.repeat(begin - (ends - n), n)
            both = masks[i : i + size][each] & self.mask[entry]
            hit = np.flatnonzero(both)
            yield own[each[hit]], self.word[entry[hit]], to[each[hit]], both[hit]


def counted(ids: np.ndarray, hashed: np.ndarray, told: list[Told], chunk: int = CHUNK) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(hashes of the words, occurrences) of a shard's phrases of len(told) + 1 words, of which all parts may be frequent; told: by length, from 1."""
    length = len(told) + 1
    maps = Bitmaps(ids, told[0].may(hashed))

    def deeper(phrase: list[np.ndarray], row: np.ndarray, byte: np.ndarray, mask: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """phrase: the words of each phrase, by place; row, byte, mask: its bitmap's entries."""
        parts = list(maps.extended(byte, mask, chunk))
        if not parts:
            return
        at, word, byte, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = row[at].astype(np.int64) << 32 | word
        distinct, row = np.unique(key, return_inverse=True)
        longer = [*(p[distinct >> 32] for p in phrase), (distinct & 0xFFFFFFFF).astype(np.int32)]
        if len(longer) == length:
            n = np.bincount(row, np.bitwise_count(mask), len(distinct)).astype(np.int64)
            own = np.flatnonzero(told[-1].may(folded([hashed[p] for p in longer[1:]])))
            yield [hashed[p[own]] for p in longer], n[own]
            return
        may = told[len(longer) - 1].may(folded([hashed[p] for p in longer]))
        number = np.cumsum(may) - 1
        own = np.flatnonzero(may[row])
        yield from deeper([p[may] for p in longer], number[row[own]], byte[own], mask[own])

    for entries in maps.firsts(chunk):
        words, row = np.unique(maps.word[entries], return_inverse=True)
        yield from deeper([words], row, maps.byte[entries], maps.mask[entries])


def _texts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(documents.sparkSession)
    return documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def word_counts(texts: DataFrame, seed: int, size: int = POSITIONS) -> DataFrame:
    """(lang, word, h1, n) of all words, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in shards(batches, size):
            n = np.bincount(ids[ids >= 0], minlength=len(words))
            langs, texts = zip(*words, strict=True) if words else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary()), pa.array(hashes(words, seed).view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "h1", "n"])

    rows = texts.mapInArrow(run, "lang string, word binary, h1 long, n long")
    return stored(rows.groupBy("lang", "word", "h1").agg(F.sum("n").alias("n")), "collocation_words")


def collisions(words: DataFrame) -> bool:
    """Whether two words have one hash."""
    return not words.groupBy("h1").count().where("count > 1").isEmpty()


def phrase_counts(texts: DataFrame, told: list[Told], seed: int, least: int, size: int = POSITIONS) -> DataFrame:
    """(h1, ..., hk, n) of the phrases of k = len(told) + 1 words that occur least times or oftener, stored."""
    names = [f"h{i + 1}" for i in range(len(told) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in shards(batches, size):
            for columns, n in counted(ids, hashes(words, seed), told):
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], names=[*names, "n"])

    rows = texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return stored(rows.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "collocation_phrases")


def told_of(phrases: DataFrame, most: int = MOST_BITS) -> Told:
    """The table of bits of some phrases, made on the executors; what reaches the driver is bounded by most."""
    names = [c for c in phrases.columns if c.startswith("h")]
    size = 1 << min(most.bit_length() - 1, max(10, (phrases.count() * BITS).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = folded([b.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in names])
            places = np.unique(np.concatenate(Told.places(own, size)))
            at, first = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(first) else places
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    rows = phrases.select(*names).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(size // 64, np.uint64)
    for b in rows.toArrow().to_batches():
        words[b.column("at").to_numpy()] = b.column("bits").to_numpy().view(np.uint64)
    return Told(words)


def count_all(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, size: int = POSITIONS) -> tuple[DataFrame, list[DataFrame]]:
    """(all words with their counts; for each length from 1 the phrases that occur least times or oftener)."""
    texts = _texts(documents, text, lang)
    seed = 0
    while collisions(words := word_counts(texts, seed, size)):
        seed += 1
    frequent = [words.where(F.col("n") >= least)]
    told: list[Told] = []
    for _ in range(1, longest):
        told.append(told_of(frequent[-1]))
        frequent.append(phrase_counts(texts, told, seed, least, size))
    return words, frequent


def _floored(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)).cast("long")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, size: int = POSITIONS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words, as the module says.

    A phrase of a occurrences is cut where its score, floor(1000000 * a * a / (l * r)) by the occurrences l and r of its
    parts, is lowest, after the fewest words if several are. Phrases that lie in a longer candidate with `share` percent of
    their occurrences or more are dropped.
    """
    words, frequent = count_all(documents, text, lang, least, longest, size)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    named = frequent[0].select("h1", "lang", F.col("word").cast("string").alias("word"))
    out = []
    for k in range(2, longest + 1):
        names = [f"h{i + 1}" for i in range(k)]
        own = frequent[k - 1].withColumnRenamed("n", "a")
        for cut in range(1, k):
            for side, part in (("l", names[:cut]), ("r", names[cut:])):
                other = frequent[len(part) - 1].select(*[F.col(f"h{i + 1}").alias(c) for i, c in enumerate(part)], F.col("n").alias(f"{side}{cut}"))
                own = own.join(other, part)
        cuts = [F.struct(_floored(F.col("a"), F.col(f"l{i}"), F.col(f"r{i}")).alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in range(1, k)]
        own = own.select(*names, "a", F.array_min(F.array(*cuts)).alias("c"))
        for j in range(k + 1, longest + 1):
            inside = [F.struct(*[F.col(f"h{at + i + 1}").alias(names[i]) for i in range(k)], "n") for at in range(j - k + 1)]
            most = frequent[j - 1].select(F.inline(F.array(*inside))).groupBy(*names).agg(F.max("n").alias("__most"))
            own = own.join(most, names, "left").where(F.coalesce(100 * F.col("__most") < share * F.col("a"), F.lit(True))).drop("__most")
        for i, c in enumerate(names):
            own = own.join(named.select(F.col("h1").alias(c), F.col("word").alias(f"w{i}"), *([F.col("lang")] if not i else [])), c)
        out.append(own.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(k)]).alias("phrase"), "a", "c.l", "c.r", "c.score"))
    every = reduce(DataFrame.unionByName, out)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    # the best of each part first, so that no task ranks all of a language
    some = best(every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part")
    return best(some, "lang").join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
