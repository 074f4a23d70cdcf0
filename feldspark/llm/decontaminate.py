"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts are sequences of words, numbers and unit signs; in scripts without spaces every character is a word. A capitalised
word is a name slot, a number a number slot, a unit a unit slot; every other word is literal, in lower case. Windows of
WINDOW tokens of the documents are hash-joined with those of the benchmark's items, twice: on their templates where a
literal word is in them, so that slots alone never match; and in any letter case, with slots for numbers and units alone
(a window without a word: on its plain tokens), so that questions in capitals and nouns that are always capitalised are
found with other numbers too. An item of fewer tokens than a window is one window. Matching windows of a document and an
item that lie on one diagonal are put together, and their slots checked: within it, an item's value must always stand
for one value of the document, and two names never for the same one. Where this fails, only the windows that are equal
in plain tokens count. A document is contaminated by an item if the item's tokens so covered number at least ENOUGH, or
the whole of a shorter item, and half of these tokens at least (three quarters in items shorter than a window) say the
same in both: slots of other values aren't evidence by themselves, however many there are. An item under ENOUGH + WINDOW
tokens also counts if a window of it is found and, on that diagonal, the whole of it agrees but for one token.

The benchmark's items, those of equal tokens being one (the least id), are dealt into blocks of a bounded number of
windows; what matches doesn't depend on the blocks. A block is broadcast and all documents are read against it, without a
shuffle; what one block found is written before the next one is made, so no worker holds more than one. Defined cases:
null or empty texts, and null item ids count as clean or are left out; items without a token match nothing; an item of
one token is in every document that has the token; a document's row is judged by itself, so repeated rows are repeated
in the result; whole texts are searched, at any length; a column of the name of the result's replaces the one in the
documents; an empty benchmark matches nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, stored
from ._words import ODD, mix

#: Tokens of a window, literal words it needs to be joined as a template, covered tokens of a contamination.
WINDOW, LITERALS, ENOUGH = 6, 1, 12
#: Keys of windows of the benchmark in a block (16 bytes each, and the tokens of their items), about.
BLOCK_WINDOWS = 1_000_000
# Words for units of measure and number words.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards g kg mg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "tonne tonnes l ml liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars "
    "cent cents euro euros yen percent degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons kmh mph".split()
)
NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())

# Characters of scripts that are written without spaces (Thai to Tibetan, Myanmar, Khmer, kana, Han).
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
# the first alternative is a faster way to the same runs of letters
_TOKEN = re.compile(rf"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?![^\W\d_])|(?:(?![{_UNSPACED}])[^\W\d_])+|(?=[{_UNSPACED}])[^\W\d_]|\d+(?:[.,]\d+)*|[%$€£¥°]")
LITERAL, NAME, NUMBER, UNIT = range(4)


def kind_of(token: str) -> int:
    first = token[0]
    if first.islower():
        return NUMBER if token in NUMBERS else UNIT if token in UNITS else LITERAL
    if not first.isalpha():
        return NUMBER if first.isdigit() else UNIT
    return LITERAL if not first.isupper() else NUMBER if token.lower() in NUMBERS else NAME


#: Numbers of tokens that the benchmark doesn't have in any letter case, by kind (the last: a capitalised unit, which is a
#: name, but a unit without its capitals); its own come after, in five kinds each.
OWN = 5
_AS_WRITTEN = np.array([LITERAL, NAME, NUMBER, UNIT, NAME])
_WITHOUT_CASE = np.array([LITERAL, LITERAL, NUMBER, UNIT, UNIT])


def _place(token: str, folded: str) -> int:
    kind = kind_of(token)
    return OWN - 1 if kind == NAME and folded in UNITS else kind


class _Ids(dict):
    """Numbers of tokens, by what they are without letter case and by kind; only the benchmark's spellings are stored."""

    def __init__(self, tokens: Sequence[str]):
        self.folded = {f: OWN * (i + 1) for i, f in enumerate(sorted({t.casefold() for t in tokens}))}
        super().__init__({t: self.folded[t.casefold()] + _place(t, t.casefold()) for t in tokens})

    def __missing__(self, token: str) -> int:
        folded = token.casefold()
        return self.folded.get(folded, 0) + _place(token, folded)


class Table:
    """The windows of a block of items, sorted by key."""

    def __init__(self, items: list[tuple[int, str]]):
        seen: dict[tuple[str, ...], int] = {}
        for item, text in sorted(items, key=lambda x: x[0]):
            tokens = tuple(_TOKEN.findall(text))
            if tokens:
                seen.setdefault(tokens, item)
        self.items = [(item, tokens) for tokens, item in seen.items()]
        self.ids = _Ids({t for _, tokens in self.items for t in tokens})
        self.plain = np.repeat(np.array([0] + [xxhash.xxh3_64_intdigest(f.encode()) for f in self.ids.folded], np.uint64), OWN)
        places = np.arange(len(self.plain)) % OWN
        self.literal, self.word = _AS_WRITTEN[places] == LITERAL, _WITHOUT_CASE[places] == LITERAL
        self.template = np.where(self.literal, self.plain, _AS_WRITTEN[places].astype(np.uint64))
        self.caseless = np.where(self.word, self.plain, _WITHOUT_CASE[places].astype(np.uint64))
        self.sizes = sorted({min(WINDOW, len(tokens)) for _, tokens in self.items})
        keys = [self.windows(tokens, [min(WINDOW, len(tokens))]) for _, tokens in self.items]
        flat = np.concatenate([k for _, k in keys]) if keys else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(keys)), [len(k) for _, k in keys])
        where = np.concatenate([w for w, _ in keys]) if keys else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.which, self.where = flat[order], which[order].astype(np.int32), where[order].astype(np.int32)

    def _ids(self, tokens: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))

    @staticmethod
    def _key(tag: int, size: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Hashes of the `size` values from each place."""
        key = np.full(len(places), tag, np.uint64)
        for k in range(size):
            key = mix(key * ODD + values[places + k])
        return key

    def windows(self, tokens: Sequence[str], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of each window of these sizes that can match: by its template, where literal words are enough and all the benchmark's; in any letter case, where all words are; by its plain tokens, where it has no word and all are."""
        ids = self._ids(tokens)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        foreign, literal, word = ids < OWN, self.literal[ids], self.word[ids]
        # numbers of such tokens before each place
        unknown = np.concatenate([[0], np.cumsum(foreign & literal)])
        able = [(size, np.flatnonzero(unknown[size:] == unknown[:-size])) for size in sizes]
        if not any(len(at) for _, at in able):
            return found[0]
        values = self.template[ids], self.caseless[ids], self.plain[ids]
        capital, strange, literals, words = (np.concatenate([[0], np.cumsum(x)]) for x in (foreign & word, foreign, literal, word))
        for size, at in able:
            known = at[capital[at + size] == capital[at]]
            worded = words[known + size] > words[known]
            wordless = known[~worded]
            for tag, places in enumerate((at[literals[at + size] - literals[at] >= LITERALS], known[worded], wordless[strange[wordless + size] == strange[wordless]])):
                if len(places):
                    found.append((places, self._key(3 * size + tag, size, places, values[tag])))
        return np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])

    def matches(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """(item, covered tokens, tokens of the item, whether one of them differs) of each item that contaminates the text."""
        if not text or not len(self.keys):
            return []
        tokens = _TOKEN.findall(text)
        places, keys = self.windows(tokens, self.sizes)
        first = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == keys)
        if not len(hit):
            return []
        diagonals: dict[tuple[int, int], set[int]] = defaultdict(set)
        last = np.searchsorted(self.keys, keys[hit], "right")
        for at, s, e in zip(places[hit].tolist(), first[hit].tolist(), last.tolist(), strict=True):
            for k in range(s, e):
                diagonals[int(self.which[k]), at - int(self.where[k])].add(int(self.where[k]))
        covered: dict[int, set[int]] = defaultdict(set)
        same: dict[int, set[int]] = defaultdict(set)
        changed: dict[int, bool] = defaultdict(bool)
        for (which, shift), starts in diagonals.items():
            item = self.items[which][1]
            size = min(WINDOW, len(item))
            every = {p for s in starts for p in range(s, s + size)}
            equal = {p for p in every if item[p].casefold() == tokens[p + shift].casefold()}
            if len(equal) < len(every) and not _consistent(item, tokens, shift, every):
                every = equal = {p for s in starts if equal.issuperset(range(s, s + size)) for p in range(s, s + size)}
            covered[which] |= every
            same[which] |= equal
            changed[which] |= len(equal) < len(every)
        shifts: dict[int, list[int]] = defaultdict(list)
        for which, shift in sorted(diagonals):
            shifts[which].append(shift)
        found = []
        for which, own in sorted(covered.items()):
            item, all_ = self.items[which]
            if _enough(len(own), len(same[which]), len(all_), len(all_)):
                found.append((item, len(own), len(all_), changed[which]))
            elif WINDOW < len(all_) < ENOUGH + WINDOW:
                for shift in shifts[which]:
                    places = _all_but_one(all_, tokens, shift)
                    equal = {p for p in places if all_[p].casefold() == tokens[p + shift].casefold()}
                    if _enough(len(places), len(equal), len(all_), len(all_) - 1):
                        found.append((item, len(places), len(all_), True))
                        break
        return found


def _enough(covered: int, same: int, size: int, whole: int) -> bool:
    """Whether so many covered tokens, so many of them the same, of an item of so many tokens contaminate; whole: how many count as all of it."""
    part, of = (1, 2) if size >= WINDOW else (3, 4)
    least = min(ENOUGH, whole) if whole == size else whole
    return covered >= least and of * same >= part * covered


def _agree(token: str, other: str) -> bool:
    a, b = token.casefold(), other.casefold()
    return a == b or kind_of(token) == kind_of(other) != LITERAL or kind_of(a) == kind_of(b) != LITERAL


def _all_but_one(item: tuple[str, ...], tokens: list[str], shift: int) -> set[int]:
    """The places of the item where the text agrees, if it lies in the text as a whole and that is in all places but one; else none."""
    if shift < 0 or shift + len(item) > len(tokens):
        return set()
    places = {p for p, t in enumerate(item) if _agree(t, tokens[p + shift])}
    return places if len(places) >= len(item) - 1 and _consistent(item, tokens, shift, places) else set()


def _consistent(item: tuple[str, ...], tokens: list[str], shift: int, places: set[int]) -> bool:
    """Whether slots of the item stand for one value each, and names for different ones."""
    to: dict[tuple[int, str], str] = {}
    back: dict[str, str] = {}
    for p in sorted(places):
        value, other = item[p].casefold(), tokens[p + shift].casefold()
        kind = kind_of(item[p])
        if kind != LITERAL and to.setdefault((kind, value), other) != other:
            return False
        if kind == NAME and back.setdefault(other, value) != value:
            return False
    return True


def _distinct_items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(t, i, n): the tokens of an item, put together again, the least id of the items that have them, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_TOKEN.findall(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(t) for t in found], pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["i", "t", "n"])

    small_batches(benchmark.sparkSession)
    own = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    return own.mapInArrow(run, "i long, t string, n long").where("n > 0").groupBy("t").agg(F.min("i").alias("i"), F.min("n").alias("n"))


def tables(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Table]:
    """The benchmark's windows in tables of a bounded number of windows, one after the other."""
    own = _distinct_items(benchmark, item, text)
    # a token begins a window at most, and a window has two keys
    blocks = 1 + 2 * (own.agg(F.sum("n")).first()[0] or 0) // BLOCK_WINDOWS
    if blocks > 1:
        own = stored(own, "items")
    for k in range(blocks):
        yield Table([(r["i"], r["t"]) for r in own.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).select("i", "t").collect()])


MATCH = T.ArrayType(T.StructType().add("item_id", "long").add("n_covered", "long").add("n_item", "long").add("reparameterised", "boolean"))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_covered", pa.int64()), ("n_item", pa.int64()), ("reparameterised", pa.bool_())]))


def with_matches(documents: DataFrame, table: Table, text: str = "text", into: str = "matches") -> DataFrame:
    """documents with the array of the items of a block that contaminate each row's text (empty for clean ones)."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(table)
    kept = [c for c in documents.columns if c != into]
    schema = documents.select(*[f"`{c}`" for c in kept]).schema.add(into, MATCH)
    names = [f.name for f in MATCH.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(names, m, strict=True)) for m in shared.value.matches(t)] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, _ARROW)], names=[*kept, into])

    return documents.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, n_covered, n_item, reparameterised) for every document and item that contaminates it."""
    own = documents.select(F.col(key), F.col(text).alias("__t"))
    parts: list[DataFrame] = []
    for table in tables(benchmark):
        # before another block is made, what the last one found is written
        parts[-1:] = [stored(p, "matches") for p in parts[-1:]]
        parts.append(with_matches(own, table, "__t", "__m").select(key, F.explode("__m").alias("m")))
    return reduce(DataFrame.unionByName, parts).select(key, "m.item_id", "m.n_covered", "m.n_item", "m.reparameterised")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no item contaminates; what one block leaves is written before the next."""
    left = None
    for table in tables(benchmark):
        left = with_matches(documents if left is None else stored(left, "clean"), table, text, "__m").where(F.size("__m") == 0).drop("__m")
    return left
