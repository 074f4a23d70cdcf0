import zlib
from collections import Counter

import numpy as np
import pytest

from feldspark.llm import sharding as H


def plain(key, shards):
    """Jump consistent hash, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_against_the_plain_algorithm():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert H.jump(keys, n).tolist() == [plain(int(k), n) for k in keys]


def test_few_rows_move_and_only_into_the_new_shard():
    keys = H.mixed(np.arange(40_000))
    for n in (1, 3, 8):
        a, b = H.jump(keys, n), H.jump(keys, n + 1)
        assert set(b[a != b]) == {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02
        assert max(Counter(a.tolist()).values()) < 1.1 * 40_000 / n
    with pytest.raises(ValueError):
        H.jump(keys, 0)


def check(rows, got):
    texts = Counter((d, t) for d, t in rows)
    for r in got:
        assert r["law"] == "key"
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): c for (d, t), c in texts.items()})
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    by_key = {}
    for r in got:
        assert by_key.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 8)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, H.shard_documents(docs).collect())


def test_odd_rows(spark):
    rows = [(None, None), (None, "x"), (1, ""), (2, "é"), (2, "é"), (-1, "y"), *[(7, "hot")] * 50]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, slot int")
    check(rows, H.shard_documents(df).collect())
    assert H.shard_documents(df.where("false")).count() == 0
