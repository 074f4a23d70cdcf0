"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded by its code point. An n-gram's vector
binds (multiplies) those of its letters, each permuted (rotated) by its place; a document's profile bundles (adds)
the vectors of its n-grams, and a language's prototype those of its training documents, each at unit length. A
document gets the language whose prototype has the largest cosine with its profile.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the first language by name;
the score is the cosine, 0 at least. With no training row, everything is `und`. Whole texts are profiled, at any length,
and alike. Repeated rows are repeated. Columns of the names of the result's two replace those of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, take_worker

#: Dimensions of a vector, letters of an n-gram, documents of a language that a prototype is learned from (about).
DIMENSIONS, GRAM, SAMPLE = 1024, 3, 3000
#: Vectors of n-grams that a worker keeps, and n-grams of a long text that are counted at a time.
KEPT, CHUNK = 20_000, 1 << 20
#: Languages whose prototypes (8 kB each) are sent to all; more are an error.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"

_LETTERS: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    if code not in _LETTERS:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        _LETTERS[code] = np.random.default_rng([20_240_501, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
    return _LETTERS[code]


class Profiles:
    """Profiles of texts, with a table of the n-gram vectors met so far."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((KEPT, DIMENSIONS), np.float32)

    def _vector(self, key: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, np.int8)
        for k in range(GRAM):
            out = out * np.roll(letter(key >> 21 * k & 0x1FFFFF), k)
        return out.astype(np.float32)

    def _grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the text's n-grams and their counts: lower case, every stretch of other characters one space. Pieces overlap, so that they have every n-gram once."""
        keys, counts = [], []
        folded = _letters(text)
        for i in range(0, max(1, len(folded) - GRAM + 1), CHUNK):
            codes = np.frombuffer(folded[i : i + CHUNK + GRAM - 1].encode("utf-32-le"), np.uint32).astype(np.int64)
            grams = codes[: len(codes) - GRAM + 1].copy()
            for k in range(1, GRAM):
                grams |= codes[k : len(codes) - GRAM + 1 + k] << 21 * k
            k, c = np.unique(grams, return_counts=True)
            keys.append(k), counts.append(c)
        if len(keys) == 1:
            return keys[0], counts[0]
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

    def profile(self, text: str) -> np.ndarray:
        keys, counts = self._grams(text)
        if len(self.rows) + len(keys) > KEPT:
            self.rows.clear()
        if len(keys) > KEPT:  # more n-grams than the table holds: bundle them one by one
            out = np.zeros(DIMENSIONS, np.float32)
            for key, c in zip(keys.tolist(), counts.tolist(), strict=True):
                out += c * self._vector(key)
            return out
        at = []
        for key in keys.tolist():
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                self.table[row] = self._vector(key)
            at.append(row)
        return counts.astype(np.float32) @ self.table[at]


class _Fold(dict):
    """For str.translate: letters stay, all else becomes a space."""

    def __missing__(self, code: int) -> int:
        value = self[code] = code if chr(code).isalpha() else 32
        return value


_FOLD = _Fold()


def _letters(text: str) -> str:
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_PROFILES: list[Profiles] = []


def _forget() -> None:
    _PROFILES.clear()
    _LETTERS.clear()


def _profiles() -> Profiles:
    if not _PROFILES:
        _PROFILES.append(Profiles())
    return _PROFILES[0]


def held_out(key: Column) -> Column:
    """Whether a row may not be learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of unit length by language, from rows that are not held out and have a language.

    Of a language with more than `sample` such rows, those are taken whose hash of the key is small, about `sample` of
    them: the bound on the sample grows with the number of languages alone, and what comes to the driver is one vector
    for each language and partition of the sample, summed by language before.
    """
    spark = documents.sparkSession
    small_batches(spark)
    own = documents.where(~held_out(F.col(key)) & F.col(lang).isNotNull()).select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang"))
    counts = {r["__lang"]: r["count"] for r in own.groupBy("__lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("__key"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(min(1.0, sample / n) * (1 << 30)))])
    taken = own.where(place < share[F.col("__lang")]).select("__text", "__lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_forget)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    p = _profiles().profile(t)
                    sums[k] = sums.get(k, 0) + p / max(np.linalg.norm(p), 1e-9)
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * DIMENSIONS), "at": pa.array(range(DIMENSIONS), pa.int32()), "v": pa.array(v.astype(np.float64))})

    parts = taken.mapInArrow(bundle, "lang string, at int, v double").groupBy("lang", "at").agg(F.round(F.sum("v"), 4).alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["v"]
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(out.items())}


def identify(documents: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents with the predicted language and its cosine in two more columns, which replace such columns."""
    small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in into]
    schema = documents.select(*[f"`{c}`" for c in kept]).schema.add(into[0], "string").add(into[1], "double")
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_forget)
        for b in batches:
            langs, scores = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                best, cosine = UNKNOWN, 0.0
                if names and has_letter(t):
                    p = _profiles().profile(t)
                    cosines = matrix @ p / max(float(np.linalg.norm(p)), 1e-9)
                    k = int(np.argmax(cosines))
                    best, cosine = names[k], min(1.0, max(0.0, float(cosines[k])))
                langs.append(best), scores.append(cosine)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *into])

    return documents.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
