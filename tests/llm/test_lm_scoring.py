import math
from collections import Counter

import numpy as np
import pytest

from feldspark.llm import lm_scoring as L

DOC = "doc_id long, text string"


def brute(rows, order, alpha, leave_one_out):
    texts = [(t or "").encode().lower().split() for _, t in rows]
    own = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in texts]
    every = sum(own, Counter())
    total = sum(map(len, texts))
    out = []
    for (d, _), w, o in zip(rows, texts, own, strict=True):
        count = lambda g, o=o: every[g] - (o[g] if leave_one_out else 0)
        n = max(1, total - (len(w) if leave_one_out else 0))
        log = 0.0
        for i in range(len(w)):
            weight, score = 1.0, None
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if count(g):
                    score = weight * count(g) / (count(g[:-1]) if k > 1 else n)
                    break
                weight *= alpha
            log += math.log10(score if score is not None else weight / n)
        out.append((d, len(w), log))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("leave_one_out", [True, False])
@pytest.mark.parametrize(("block", "bucket"), [(8 << 20, 1_500_000), (20_000, 500)])
def test_against_brute_force(spark, sf_dir, monkeypatch, order, leave_one_out, block, bucket):
    monkeypatch.setattr(L, "BLOCK_BYTES", block)
    monkeypatch.setattr(L, "BUCKET", bucket)
    monkeypatch.setattr(L, "SLICE", 1)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()] + [(-1, None), (-2, " "), (-3, "x"), (-4, "a b A B a b"), (-4, "a b A B a b")]
    got = sorted((r["doc_id"], r["n_tokens"], r["logprob"]) for r in L.score_documents(spark.createDataFrame(rows, DOC), order, leave_one_out=leave_one_out).collect())
    want = brute(rows, order, L.ALPHA, leave_one_out)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def test_edges(spark):
    score = lambda rows: {r["doc_id"]: r for r in L.score_documents(spark.createDataFrame(rows, DOC)).collect()}
    assert score([]) == {}
    alone = score([(1, "one two")])[1]
    assert alone["logprob"] == pytest.approx(math.log10(0.4) + 2 * math.log10(0.4), abs=1e-6)
    empty = score([(1, None)])[1]
    assert (empty["n_tokens"], empty["logprob"], empty["mean_logprob"]) == (0, 0.0, None)


def test_packing():
    rnd = np.random.default_rng(0)
    h = np.unique(rnd.integers(0, 1 << 64, 1000, dtype=np.uint64))
    for bits in (0, 1, 7):
        ends = L._ends(h, bits)
        assert len(ends) == (1 << bits) + 1 and ends[-1] == len(h)
        for part, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            assert s == e or ((h[s:e] >> np.uint64(64 - bits) if bits else h[s:e] * np.uint64(0)) == part).all()
            assert (L._got(L._put(h[s:e], part, bits), part, bits) == h[s:e]).all()
    c = rnd.integers(0, 1000, 500)
    assert (L._large(L._small(c)) == c).all()
    assert len(L._large(L._small(np.zeros(0, np.int64)))) == 0


def test_production_scores_trigrams(spark):
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "x b c d a b"), (4, "b c b d")]
    got = sorted((r["doc_id"], r["n_tokens"], r["logprob"]) for r in L.score_documents(spark.createDataFrame(rows, DOC)).collect())
    want = brute(rows, 3, L.ALPHA, True)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-5)
    assert [w[2] for w in want] != pytest.approx([w[2] for w in brute(rows, 2, L.ALPHA, True)], abs=1e-2)


def test_clashing_columns_and_a_text_longer_than_a_block(spark):
    rows = [(1, "a b " * 3_000_000, "x", 1), (2, "a b a", "y", 2), (3, None, None, None)]
    df = spark.createDataFrame(rows, DOC + ", block string, words long")
    got = {r["doc_id"]: r["n_tokens"] for r in L.score_documents(df).collect()}
    assert got == {1: 6_000_000, 2: 3, 3: 0}


def test_blocks_are_not_shuffled(spark, sf_dir):
    plan = L.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2, plan


def test_what_a_block_sends_to_a_partition_stays_large():
    for words in (1e6, 1e9, 1e13):
        side = L._side(words, 3)
        assert side * side / (3 * words) == pytest.approx(L.SLICE)
