import zlib

import numpy as np
import pytest

from feldspark.llm import language_id as I


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    found = I.identify(documents, I.fit(documents)).collect()
    assert len(found) == documents.count()
    held = [r for r in found if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows(spark, documents):
    got = documents.select("doc_id", I.held_out(documents["doc_id"]).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_held_out_rows_teach_nothing(spark, documents):
    a = I.fit(documents)
    b = I.fit(documents.where(~I.held_out(documents["doc_id"])))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_profile_is_the_bundle_of_its_grams():
    text = "Ab, ça1b"
    letters = " ab ça b "
    want = np.zeros(I.DIMENSIONS)
    for i in range(len(letters) - 2):
        v = np.ones(I.DIMENSIONS)
        for k in range(3):
            v = v * np.roll(I.letter(ord(letters[i + k])).astype(float), k)
        want += v
    assert (I.Profiles().profile(text) == want).all()


def test_small_tables_change_nothing(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 3
    whole = I.Profiles().profile(text)
    monkeypatch.setattr(I, "KEPT", 5)
    assert (I.Profiles().profile(text) == whole).all()


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !? 45", None), (4, "a", "en"), (5, "die der das und " * 20000, None), (None, "the", None)], "doc_id long, text string, lang_pred string")
    prototypes = {"en": I.Profiles().profile("the cat and the dog of the house"), "de": I.Profiles().profile("die der das und ist nicht")}
    prototypes = {k: v / np.linalg.norm(v) for k, v in prototypes.items()}
    got = I.identify(df, prototypes).collect()
    assert [(r["lang_pred"], r["score"] == 0) for r in got[:3]] == [(I.UNKNOWN, True)] * 3
    assert got[4]["lang_pred"] == "de" and got[5]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in I.identify(df, {}).collect()} == {I.UNKNOWN}
    assert I.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_sample_bound(spark, documents):
    few = I.fit(documents, sample=20)
    assert set(few) == {"en", "de", "fr", "es"}


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    text = "Das ist, 1 neues Haus! ÉTÉ ΟΔΟΣ " * 30 + "x"
    whole = I.Profiles().profile(text)
    for chunk in (1, 7, 64, 1000):
        monkeypatch.setattr(I, "CHUNK", chunk)
        assert (I.Profiles().profile(text) == whole).all()


def test_prediction_is_the_nearest_prototype(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(80)
    prototypes = I.fit(docs)
    twice = docs.unionByName(docs).withColumn("score", docs["lang"])
    rows = I.identify(twice, prototypes).collect()
    assert len(rows) == 160 and len({tuple(r) for r in rows}) <= 80

    def vector(text):
        folded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        out = np.zeros(I.DIMENSIONS)
        for i in range(len(folded) - 2):
            one = np.ones(I.DIMENSIONS)
            for k, c in enumerate(folded[i : i + 3]):
                one *= np.roll(I.letter(ord(c)), k)
            out += one
        return out / np.linalg.norm(out)

    for r in rows[:40]:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == (I.UNKNOWN, 0.0)
            continue
        cosines = {k: float(v @ vector(r["text"])) for k, v in prototypes.items()}
        assert r["lang_pred"] == max(sorted(cosines), key=cosines.get)
        assert abs(r["score"] - max(0, max(cosines.values()))) < 1e-4


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(I, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        I.fit(spark.createDataFrame([(k, "text", f"l{k}") for k in range(9)], "doc_id long, text string, lang string"))
