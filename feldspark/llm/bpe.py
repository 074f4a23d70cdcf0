"""Byte-level BPE by longest matches and backtracking, exact as to the merges, in linear time.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton finds the longest token at each place.
Two adjacent tokens are compatible if the merges would leave their border alone, which the last merges of the tokens
that stand at the border in turn tell; the answers are memoised. The encoder takes the longest token that is compatible with the one
before it, tries shorter ones if it isn't, and steps back where none is left. Texts are first split by a pattern,
and each piece is encoded separately.

The result has the key and its own columns; others of the documents, whatever their names, are left out. Repeated rows
are repeated. Defined cases: a null or empty text has no token; equal texts have equal tokens; the length of a text is not
limited. Lone surrogates can't occur in Spark's strings.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, take_worker

#: Pieces of a generation that a worker remembers (of two: those of the last one are kept while used), their longest length, and remembered pairs of tokens.
REMEMBERED, MEMORABLE, PAIRS = 225_000, 64, 200_000

#: A rank after all others.
LAST = 1 << 62


class Encoder:
    """The encoder of one table of ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        self.tokens: dict[int, bytes] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.rank = {t: r for r, t in self.tokens.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the table has no token for {len(missing)} single bytes")
        self.pieces = regex.compile(pattern)
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        # ids of pieces as 32-bit numbers, which takes the least memory
        self.known: dict[str, bytes] = {}
        self.names = {r: str(r) for r in self.tokens}
        self.older = self.known
        reachable = []
        for r in sorted(self.tokens):
            token = self.tokens[r]
            if len(token) == 1:
                self.split[r] = (r, r)
                reachable.append(r)
                continue
            halves = self._halves(token, r)
            if halves:
                self.split[r] = halves
                self.merged[halves] = r
                reachable.append(r)
        self.lengths = {r: len(t) for r, t in self.tokens.items()}
        self.automaton = ahocorasick.Automaton()
        for r in reachable:
            self.automaton.add_word(self.tokens[r].decode("latin-1"), (r, len(self.tokens[r])))
        self.automaton.make_automaton()
        found = {self.tokens[r] for r in reachable}
        for r in reachable:
            token = self.tokens[r]
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in found:
                    self.shorter[r] = self.rank[token[:n]]
                    break

    def _halves(self, token: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that the merges under `below` leave of a token; None if they leave more."""
        parts = [self.rank[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((m, i) for i in range(len(parts) - 1) if (m := self.merged.get((parts[i], parts[i + 1]), below)) < below), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts[0], parts[1]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's left (0) or right (1) end while it is being merged, each with the rank that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known = [(token, LAST)]
            while self.split[token][side] != token:
                token, end = self.split[token][side], token
                known.append((token, end))
            self.edges[side][known[0][0]] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right side by side.

        Two tokens meet at the border if there is a time at which both stand there. They are merged if the rank of
        the two together comes before those that end them; of equal ranks the one further left is merged first.
        """
        pair = left << 32 | right
        answer = self.fits.get(pair)
        if answer is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            merged = self.merged
            answer = self.fits[pair] = not any(
                (rank := merged.get((a, b))) is not None and rank < end_of_a and rank <= end_of_b for a, end_of_a in self._edge(left, 1) for b, end_of_b in self._edge(right, 0)
            )
        return answer

    def _merge(self, piece: bytes) -> list[int]:
        """Tokens of a piece: the longest that goes with the one before at each place; where none goes, the place is closed and the one before is made shorter.

        Merges split a beginning of the piece in one way only, so a place that is closed stays so.
        """
        n = len(piece)
        longest: list[int | None] = [None] * (n + 1)
        # matches come by their ends, so the last one from a place is the longest
        for end, (r, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = r
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        closed = bytearray(n + 1)
        path: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = path[-1] << 32 if path else -1
            while token is not None:
                if not closed[at + lengths[token]]:
                    if before < 0:
                        break
                    fit = fits.get(before | token)
                    if fit or fit is None and self.compatible(before >> 32, token):
                        break
                token = shorter.get(token)
            if token is None:
                closed[at] = 1
                token = path.pop()
                at -= lengths[token]
                token = shorter.get(token)
            else:
                path.append(token)
                at += lengths[token]
                token = longest[at]
        return path

    def piece(self, text: str) -> bytes:
        """Ids of a piece."""
        got = self.older.get(text)
        if got is None:
            raw = text.encode("utf-8")
            whole = self.rank.get(raw)
            got = array("I", [whole] if whole is not None else self._merge(raw)).tobytes()
        if len(text) <= MEMORABLE:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[text] = got
        return got

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """Ids of a text, and these as decimals joined by commas."""
        if not text:
            return [], ""
        ids = np.frombuffer(b"".join([self.known.get(x) or self.piece(x) for x in self.pieces.findall(text)]), np.uint32).tolist()
        return ids, ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_MADE: dict[str, Encoder] = {}


def _forget() -> None:
    _MADE.clear()


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each table and pattern in a Python worker, whatever the number of its tasks."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _MADE:
        _MADE[key] = Encoder(ranks, pattern)
    return _MADE[key]


def _shared(spark: SparkSession, path: str):
    """The table of ranks, read by the driver and broadcast; a vocabulary's size doesn't depend on the data, and is checked."""
    with open(path, "rb") as file:
        ranks = file.read(64 << 20)
        if file.read(1):
            raise ValueError("a table of ranks over 64 MB")
    return spark.sparkContext.broadcast(ranks)


def encode_texts(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, token_ids array<int>, ids_sha256, decoded_sha256) of every row; decoded_sha256 is of the bytes that the ids decode to."""
    spark = documents.sparkSession
    small_batches(spark)
    ranks = _shared(spark, path)
    schema = documents.select(key).schema.add("n_tokens", "long").add("token_ids", T.ArrayType(T.IntegerType())).add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_forget)
        own = encoder(ranks.value, pattern)
        for b in batches:
            counts, flat, ids_sha, text_sha = [], [], [], []
            for t in b.column(1).to_pylist():
                ids, said = own.encode(t)
                counts.append(len(ids))
                flat.append(np.array(ids, np.int32))
                ids_sha.append(hashlib.sha256(said.encode("ascii")).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), lists, pa.array(ids_sha), pa.array(text_sha)], names=schema.names)

    return documents.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, path: str, ids: str = "token_ids", into: str = "text") -> DataFrame:
    """tokens with the text that each row's ids stand for (bytes that are no UTF-8 give U+FFFD); null ids give null."""
    spark = tokens.sparkSession
    small_batches(spark)
    ranks = _shared(spark, path)
    kept = [c for c in tokens.columns if c != into]
    schema = tokens.select(*[f"`{c}`" for c in kept]).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_forget)
        own = encoder(ranks.value, ".")
        for b in batches:
            got = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string())], names=[*kept, into])

    return tokens.select(*[f"`{c}`" for c in kept], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
