import pytest

import corpus_pipeline as C
from feldspark.llm import decontaminate, language_id, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and gave, over the documents of 0.01."""
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in C.STAGES:
        made = C.stored(stage(spark, docs, sf), name)
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(steps):
    assert [n for n, _, _ in steps] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "bpe"]
    assert all(made.columns == COLUMNS for _, _, made in steps[:-1])


def test_language_stage_keeps_documents_with_letters(steps):
    _, docs, made = steps[0]
    gone = [r for r in docs.collect() if r["doc_id"] not in ids(made)]
    assert len(gone) <= 0.02 * docs.count()
    assert all(r["doc_id"] in ids(made) for r in docs.collect() if language_id.has_letter(r["text"]) and len(r["text"]) > 400 and r["lang"])


def test_one_of_each_group_stays(steps):
    from test_jaccard_join import brute

    _, docs, made = steps[1]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], C.WIDTH, C.PERCENT)
    assert ids(made) == {d for d, _, c in want if d == c}


def test_passages_go(spark, steps):
    _, docs, made = steps[2]
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    table = decontaminate.Table(list(enumerate(items)))
    rows = docs.collect()
    assert ids(made) == {r["doc_id"] for r in rows if not table.matches(r["text"])}
    assert not any(t in r["text"] for r in made.collect() for t in items)


def test_secrets_are_replaced(steps):
    _, docs, made = steps[3]
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (docs, made))
    assert before.keys() == after.keys()
    for k, r in before.items():
        assert after[k]["text"] == secret_scan.redact(r["text"]) and after[k]["n_chars"] == len(after[k]["text"])


def test_tokens(steps):
    _, docs, made = steps[4]
    assert ids(made) == ids(docs) and made.where("n_tokens = 0").count() == docs.where("text = ''").count()


def test_run_equals_the_stages(spark, steps):
    got = C.run(spark, "/root/testdata/sf0.01")
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.select("doc_id", "ids_sha256").collect())
    assert key(got) == key(steps[-1][2])


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "the house and the dog " * 9, "en", "s", 198), (3, "the house and the dog " * 9, "en", "s", 198), (None, "the cat of the town", "en", "s", 19), (6, "the house and the dog " * 9, None, "s", 198)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 3]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
