import pytest
from pyspark.sql import functions as F

from feldspark.config import Config
from feldspark.plans import pipeline as P
from feldspark.sources import adapters, readers, sinks
from feldspark.streaming import apply


@pytest.fixture(scope="module")
def made(spark, sf_dir, tmp_path_factory):
    df = adapters.transactions(spark, sf_dir)
    n = df.count()
    cfg = Config(train_n=int(n * 0.46), val_n=int(n * 0.1), test_n=int(n * 0.1), window_rows=20, knn_ref=200, k_sel=12)
    p = P.Pipeline(spark, cfg, str(tmp_path_factory.mktemp("run")))
    return df, n, p, p.run(df)


def test_all_checks_hold(made):
    _, n, p, _ = made
    got = {r["check"]: (r["ok"], r["detail"]) for r in p.check(n).collect()}
    assert all(ok for ok, _ in got.values()), got


def test_outputs(spark, made):
    _, n, p, _ = made
    own = p.params["reduce"]
    parts = [sinks.read_split(spark, f"{p.folder}/out", "features_sel", s) for s in ("train", "val", "test", "monitor")]
    assert sum(x.count() for x in parts) == n
    assert parts[0].columns == ["TransactionID", *own["track_a"]]
    assert set(Config().protect) & set(own["track_a"])
    ranks = [r["importance_rank"] for r in spark.read.parquet(f"{p.folder}/manifest").orderBy(F.desc("importance_gain"), "name").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
    assert sinks.load_json(spark, f"{p.folder}/feature_manifest.json")[0]["importance_rank"] == 1
    assert "## Selected features" in spark.read.text(f"{p.folder}/report.md", wholetext=True).first()[0]


def test_resumes_and_rejects_unknown_stages(spark, made):
    df, _, p, out = made
    again = P.Pipeline(spark, p.cfg, p.folder.rsplit("/", 1)[0])
    got = again.run(stage="scale")
    assert list(again.timings) == ["scale"]
    assert got.count() == df.count()
    with pytest.raises(ValueError):
        again.run(df, stage="S99")
    with pytest.raises(ValueError):
        P.Pipeline(spark, Config(seed=7), p.folder).run()


def test_frozen_transform_equals_the_run(spark, made):
    df, _, p, out = made
    vocabulary = spark.read.parquet(f"{p.folder}/encoders")
    from feldspark.operators import clean, impute, split

    scaled = spark.read.parquet(p.path("winsor"))
    ref = impute.reference(split.train(scaled), "TransactionID", p.cfg.knn_ref, p.cfg.seed)
    base = split.assign(clean.normalise(df), p.cfg)
    again = P.transform(base, p.params, vocabulary, p.cfg, ref)
    own = p.params["reduce"]["track_a"]
    a = {r[0]: r[1:] for r in again.select("TransactionID", *own).collect()}
    b = {r[0]: r[1:] for r in out.select("TransactionID", *own).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_stream(spark, made, tmp_path):
    _, _, p, _ = made
    rows = spark.read.parquet(p.path("flags")).drop(*p.params["flags"])
    folder = str(tmp_path / "in")
    rows.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    query = apply.write(apply.transform_stream(stream, p.params), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = P.stateless(rows, p.params)
    assert got.count() == want.count() and set(got.columns) == set(want.columns)
    key = lambda df: sorted((r["TransactionID"], round(r["TransactionAmt"], 9)) for r in df.collect())
    assert key(got) == key(want)


def test_card_activity(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = apply.card_activity(stream, "ts", "user_id", "value").writeStream.format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("activity").agg(F.sum("n")).first()[0]
    assert 0 < got <= events.count()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,TransactionDT,isFraud,TransactionAmt,card4,V1\n1,100,0,5.5,visa,\n2,200,1,7,,3\n")
    (tmp_path / "i.csv").write_text("TransactionID,id-01,DeviceType,id-12\n1,-5,mobile,Found\n")
    df = readers.csv_to_parquet(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), str(tmp_path / "out"))
    assert dict(df.dtypes) == {"TransactionID": "int", "TransactionDT": "bigint", "isFraud": "tinyint", "TransactionAmt": "float", "card4": "string", "V1": "float", "id_01": "float", "DeviceType": "string", "id_12": "string"}
    assert [tuple(r) for r in df.orderBy("TransactionID").collect()] == [(1, 100, 0, 5.5, "visa", None, -5.0, "mobile", "Found"), (2, 200, 1, 7.0, None, 3.0, None, None, None)]
    # the table is taken as it is unless forced
    (tmp_path / "t.csv").write_text("TransactionID,TransactionDT,isFraud\n9,1,0\n")
    assert readers.csv_to_parquet(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), str(tmp_path / "out")).count() == 2
    assert readers.csv_to_parquet(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), str(tmp_path / "out"), force=True).count() == 1
    assert readers.inferred_csv(spark, str(tmp_path / "i.csv")).count() == 1
    assert readers.parquet(spark, str(tmp_path / "out"), ["isFraud"]).columns == ["isFraud"]
    with pytest.raises(FileNotFoundError):
        readers.typed_csv(spark, str(tmp_path / "none.csv"))
    twice = spark.createDataFrame([(1,), (1,)], "TransactionID int")
    with pytest.raises(ValueError):
        readers.join_identity(twice, twice)


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.25)], "TransactionID int, TransactionDT int, x double")
    sinks.write_csv(df, str(tmp_path / "f"), ["TransactionID", "TransactionDT"])
    assert spark.read.csv(str(tmp_path / "f"), header=True).columns == ["TransactionID", "x"]
    assert spark.read.csv(str(tmp_path / "f_ids"), header=True).count() == 2


def test_wide_projections_of_a_stage_are_compiled(spark, sf_dir, tmp_path, monkeypatch):
    df = adapters.transactions(spark, sf_dir)
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    monkeypatch.setattr(P.sinks, "write_parquet", lambda *a, _f=sinks.write_parquet: (seen.append(spark.conf.get(name)), _f(*a))[1])
    P.Pipeline(spark, Config(train_n=400, val_n=100, test_n=100, window_rows=20), str(tmp_path)).run(df, "clean")
    assert seen == ["8000", "8000"] and spark.conf.get(name) == before
