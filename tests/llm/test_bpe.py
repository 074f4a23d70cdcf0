import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feldspark.llm import bpe

NAMES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def raw(name):
    with open(P.path(name), "rb") as f:
        return f.read()


OWN = {n: bpe.Encoder(raw(n), P.PATTERN) for n in NAMES}
THEIRS = {n: tiktoken.Encoding(n, pat_str=P.PATTERN, mergeable_ranks=e.rank, special_tokens={}) for n, e in OWN.items()}


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab t'seé \n09*"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(name, text):
    ids, said = OWN[name].encode(text)
    assert ids == THEIRS[name].encode_ordinary(text) and said == ",".join(map(str, ids))
    assert OWN[name].decode(ids) == text.encode()


@pytest.mark.parametrize("name", NAMES)
def test_long_pieces(name):
    rnd = random.Random(2)
    for text in ("a" * 30001, "ab" * 20000, "=-" * 9999, " " * 5000 + "x", "".join(rnd.choice("tionerathe") for _ in range(20000)), "日本" * 3000):
        assert OWN[name].encode(text)[0] == THEIRS[name].encode_ordinary(text)


def test_forgetting_changes_nothing(monkeypatch):
    own = bpe.Encoder(raw(NAMES[0]), P.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    text = "Thlyouble inesea, onononedth! edshhe worthless 12345 onrein"
    assert own.encode(text)[0] == THEIRS[NAMES[0]].encode_ordinary(text)


def test_incomplete_table():
    with pytest.raises(ValueError):
        bpe.Encoder(b"YQ== 0\n", P.PATTERN)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-2, "")], "doc_id long, text string"))
    made = bpe.encode_texts(docs, P.path(NAMES[0]), P.PATTERN)
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = made.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = THEIRS[NAMES[0]].encode_ordinary(want[r["doc_id"]])
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    back = bpe.decode_ids(made, P.path(NAMES[0])).collect()
    assert all(r["text"] == want[r["doc_id"]] for r in back)
    assert bpe.encode_texts(docs.where("false"), P.path(NAMES[0]), P.PATTERN).count() == 0


def test_compatible_pairs_are_those_that_merges_leave():
    """Pairs of tokens against the merges themselves, each pair of bytes by the least rank, the leftmost first."""
    own = OWN[NAMES[0]]

    def merges(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            ranks = [(own.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in own.rank]
            if not ranks:
                return parts
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(11)
    known = sorted(own.split)
    seen = set()
    for _ in range(4000):
        a, b = rnd.choice(known), rnd.choice(known[:2000])
        if rnd.random() < 0.3:
            a, b = b, a
        want = merges(own.tokens[a] + own.tokens[b]) == [own.tokens[a], own.tokens[b]]
        assert own.compatible(a, b) == want
        seen.add(want)
    assert seen == {True, False}


def test_other_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "one two", "x", 5), (1, "one two", "x", 5), (None, None, None, None)], "doc_id long, text string, ids_sha256 string, n_tokens long")
    got = bpe.encode_texts(df, P.path(NAMES[0]), P.PATTERN).collect()
    assert sorted((r["n_tokens"], r["doc_id"]) for r in got if r["doc_id"]) == [(len(THEIRS[NAMES[0]].encode_ordinary("one two")), 1)] * 2
    assert [r["n_tokens"] for r in got if r["doc_id"] is None] == [0]
