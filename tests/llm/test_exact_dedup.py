import hashlib
import random
import re
from collections import defaultdict

import pytest

from feldspark.llm import exact_dedup as X


def brute(rows):
    """{(doc_id, digest): [(keep_id, group_size)]} and how many rows are kept, by comparing all normalised texts."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: x[:3])[3]
        out += [(x[3], keep, len(own), hashlib.sha256(norm.encode()).hexdigest()) for x in own]
    return sorted(out, key=repr), len(groups)


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, digest int")
    got = X.mark_duplicates(df, **options).collect()
    want, groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    return got


@pytest.mark.parametrize(("bits", "page"), [(64, 1), (64, 256), (5, 1), (1, 4)])
def test_against_brute_force(spark, bits, page):
    """Few bits put texts that differ into one chain; small pages double the directory."""
    draw = random.Random(bits)
    texts = ["".join(draw.choice("ab \t\n\x0b\x0c\ré") for _ in range(draw.randrange(7))) for _ in range(300)]
    check(spark, list(enumerate(texts)), bits=bits, page=page)


def test_odd_rows(spark):
    check(spark, [(None, None), (None, "x"), (1, ""), (2, " \n"), (3, None), (4, "x"), (4, "x"), (4, "x "), (5, "y "), (6, "y"), (7, "z" * 300_000), (8, "z" * 300_000 + "\t")])
    assert X.mark_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_group(spark):
    check(spark, [(i, "a  b" if i % 3 else f"{i}") for i in range(3000)], page=16)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = X.keep_distinct(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


@pytest.mark.parametrize("page", [1, 3, 50, 10_000])
def test_directory(spark, page):
    """Slots of a bucket are neighbours, as many as its local depth leaves; no bucket is overfull, and none was split before it was."""
    keys = sorted({random.Random(page).getrandbits(64) - (1 << 63) for _ in range(2000)} | {0, -1, 1, (1 << 63) - 1})
    slots, depth = X.directory(spark.createDataFrame([(k,) for k in keys], "key long"), page)
    of = {r["slot"]: (r["bucket"], r["first"]) for r in slots.collect()}
    load, spans = defaultdict(int), defaultdict(list)
    slot = lambda k, d: (k % (1 << 64)) >> (64 - d) if d else 0
    for k in keys:
        load[of[slot(k, depth)][0]] += 1
    for s, (b, first) in sorted(of.items()):
        spans[b].append(s)
        assert first == spans[b][0]
    assert sum(load.values()) == len(keys)
    for b, own in spans.items():
        local = b % 64
        assert own == list(range(own[0], own[0] + (1 << depth - local))) and own[0] >> depth - local == b // 64
        assert load[b] <= page or local == depth
        if local:
            assert sum(slot(k, local - 1) == b // 128 for k in keys) > page
    assert page < 10_000 or depth == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = X.mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
