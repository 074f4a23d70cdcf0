"""Operators give the same at any number of rows to a part, with hot times, hot cards and many ties."""

import random

import pytest

from feldspark.operators import checks, encode, engineer, split, stats
from feldspark.sources import adapters


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of which a third have one time, and another third one card."""
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        time = 500 if i % 3 == 0 else rnd.randrange(1000)
        card = None if i % 3 == 1 else f"c{rnd.randrange(40)}"
        rows.append((i, time, card, float(rnd.randrange(1, 20)), i % 7 == 0))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "TransactionID long, TransactionDT long, card string, TransactionAmt double, y boolean").withColumn("y", stats.F.col("y").cast("int")).cache()


@pytest.mark.parametrize("rows", [50, 10**6])
def test_positions(spark, monkeypatch, hot, rows):
    monkeypatch.setattr(stats, "PART_ROWS", rows)
    placed = stats.positions(hot, ["TransactionDT", "TransactionID"])
    got = [(r["TransactionDT"], r["TransactionID"], r["position"]) for r in placed.collect()]
    assert [p for _, _, p in sorted(got)] == list(range(900))
    if rows == 50:
        # the hot time is dealt over several parts
        ranged = hot.repartitionByRange(stats.parts_of(900, spark), "TransactionDT", "TransactionID")
        sizes = [r["count"] for r in ranged.groupBy(stats.F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 4 * rows


@pytest.mark.parametrize("rows", [50, 10**6])
def test_history_of_hot_cards(monkeypatch, hot, rows):
    monkeypatch.setattr(stats, "PART_ROWS", rows)
    got = {r["TransactionID"]: r for r in engineer.history(hot, ["card"]).collect()}
    seen = {}
    import math

    for r in sorted(hot.collect(), key=lambda r: (r["TransactionDT"], r["TransactionID"])):
        n, spent, first, last = seen.get(r["card"], (0, 0.0, r["TransactionDT"], None))
        g = got[r["TransactionID"]]
        assert g["card_prior_txn_count"] == n and g["card_is_first_seen"] == (n == 0)
        assert g["card_time_since_last"] == pytest.approx(-1 if last is None else math.log1p(r["TransactionDT"] - last))
        assert g["card_velocity"] == pytest.approx(n / ((r["TransactionDT"] - first) / 86400 + 1))
        assert g["amt_to_avg_card_ratio"] == pytest.approx(1 if not n else min(100, r["TransactionAmt"] / (spent / n)))
        seen[r["card"]] = n + 1, spent + r["TransactionAmt"], first, r["TransactionDT"]
    assert len(got) == 900


@pytest.mark.parametrize("rows", [50, 10**6])
def test_counts_lags_and_means_of_hot_keys(monkeypatch, hot, rows):
    """With values of nothing among them, and null as a key."""
    monkeypatch.setattr(stats, "PART_ROWS", rows)
    df = hot.withColumn("v", stats.F.when(stats.F.col("TransactionID") % 5 > 0, stats.F.col("TransactionAmt")))
    counted = {r["TransactionID"]: r["n"] for r in engineer.running_count(df, ["card"], split.ORDER, "n").collect()}
    before = {r["TransactionID"]: r["p"] for r in engineer.previous(df, ["card"], split.ORDER, "v", "p").collect()}
    ratio = {r["TransactionID"]: r["m"] for r in engineer.global_mean_ratio(df, ["card"], "v", "m").collect()}
    seen, falls = {}, 0
    for r in sorted(df.collect(), key=lambda r: (r["TransactionDT"], r["TransactionID"])):
        own = seen.setdefault(r["card"], [])
        assert counted[r["TransactionID"]] == len(own)
        p = own[-1] if own else None
        assert before[r["TransactionID"]] == p
        falls += p is not None and r["v"] is not None and r["v"] < p
        own.append(r["v"])
    for r in df.collect():
        there = [v for v in seen[r["card"]] if v is not None]
        assert ratio[r["TransactionID"]] == (None if r["v"] is None else pytest.approx(r["v"] / (sum(there) / len(there))))
    assert len(counted) == len(before) == len(ratio) == 900
    assert checks.monotonic(df, ["card"], "TransactionDT", "v").first()["n_decreasing"] == falls


@pytest.mark.parametrize("rows", [50, 10**6])
@pytest.mark.parametrize("ties", ["average", "ordinal"])
def test_auc(monkeypatch, hot, rows, ties):
    monkeypatch.setattr(stats, "PART_ROWS", rows)
    got = stats.auc(hot, ["TransactionAmt", "TransactionDT"], "y", ties, split.ORDER)
    every = hot.collect()
    for c, a in got.items():
        order = sorted(every, key=lambda r: (r[c], r["TransactionDT"], r["TransactionID"]))
        ranks = {}
        for i, r in enumerate(order):
            ranks.setdefault(r[c] if ties == "average" else i, []).append(i + 1)
        mean = {k: sum(v) / len(v) for k, v in ranks.items()}
        total = sum(mean[r[c] if ties == "average" else i] for i, r in enumerate(order) if r["y"])
        pos = sum(r["y"] for r in order)
        want = (total - pos * (pos + 1) / 2) / (pos * (900 - pos))
        assert a == pytest.approx(max(want, 1 - want))


@pytest.mark.parametrize("gather", [20, 10**6])
def test_quantiles_are_read_on_executors(monkeypatch, hot, gather):
    import numpy as np

    monkeypatch.setattr(stats, "GATHER", gather)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = stats.quantiles(hot, ["TransactionAmt", "TransactionDT"], shares)
    for c, q in got.items():
        assert q == pytest.approx(np.quantile([r[c] for r in hot.collect()], shares).tolist())


@pytest.mark.parametrize("rows", [50, 10**6])
def test_vocabulary_and_key_ids(monkeypatch, hot, rows):
    monkeypatch.setattr(stats, "PART_ROWS", rows)
    got = [(r["value"], r["count"]) for r in encode.fit(hot, ["card"], 10).orderBy("code").collect()]
    counts = {}
    for r in hot.collect():
        counts[r["card"] or "unknown"] = counts.get(r["card"] or "unknown", 0) + 1
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
    ids = {(r["card"], r["card_key_id"]) for r in engineer.key_ids(hot, stats.F.coalesce("card", stats.F.lit("na"))).collect()}
    assert sorted(ids, key=lambda x: x[1]) == [(None if k == "na" else k, i) for i, k in enumerate(sorted({c or "na" for c, _ in ids}))]


def test_a_leaking_fit_is_found(spark, sf_dir):
    df = adapters.lines(spark, sf_dir)
    honest = lambda t: stats.quantiles(split.train(t), ["price", "debt"], [0.5])
    leaking = lambda t: stats.quantiles(t, ["price", "debt"], [0.5])
    assert checks.fitted_on_train(honest, df, ["price", "debt"])[1]
    assert not checks.fitted_on_train(leaking, df, ["price", "debt"])[1]


@pytest.fixture(scope="module")
def many_cards(spark, tmp_path_factory):
    """A folder with events of 60,000 users, each with one or two in the earlier half."""
    folder = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(75_000).selectExpr("id AS event_id", "timestampadd(SECOND, CAST(id AS INT), timestamp_ntz'2024-01-01 00:00:00') AS ts", "id % 60000 AS user_id", "'view' AS event_type", "CAST(id % 100 AS DOUBLE) AS value", "'' AS props")
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


def against_sql(spark, folder, name):
    import duckdb
    from compare import rows_of, rows_of_sql
    from feldspark.plans import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got, want = rows_of(queries.QUERIES[name](spark, folder)), rows_of_sql(con, queries.ORACLE[name])
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w] == []


@pytest.mark.parametrize("name", ["freq_encode", "freq_encode_pair", "interactions"])
def test_all_values_are_counted(spark, many_cards, name):
    against_sql(spark, many_cards, name)


def test_first_rows_by_a_cut(spark, monkeypatch, hot):
    """The same rows as by a sort, with a third of the rows at one time."""
    want = [r["TransactionID"] for r in sorted(hot.collect(), key=lambda r: (r["TransactionDT"], r["TransactionID"]))]
    monkeypatch.setattr(stats, "SMALL_PART", 3)
    for n in (5, 300, 600, 899, 900, 5000):
        assert {r["TransactionID"] for r in stats.first_rows(hot, split.ORDER, n).collect()} == set(want[:n])
    assert stats.first_rows(hot.where("false"), split.ORDER, 10).count() == 0


def test_splits_by_boundary_keys(spark, hot):
    """Rows of one time on both sides of a boundary; the table isn't shuffled."""
    from feldspark.config import Config

    cfg = Config(train_n=250, val_n=100, test_n=150, window_rows=90, windows=3)
    placed = split.assign(hot, cfg)
    got = sorted(placed.collect(), key=lambda r: (r["TransactionDT"], r["TransactionID"]))
    assert [r["split"] for r in got] == [0] * 250 + [1] * 100 + [2] * 150 + [3] * 400
    assert [r["window_id"] for r in got] == [-1] * 500 + [0] * 90 + [1] * 90 + [2] * 90 + [-1] * 130
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    short = split.assign(hot.where("TransactionID < 10"), cfg)
    assert {r["split"] for r in short.collect()} == {0} and {r["window_id"] for r in short.collect()} == {-1}


def test_codes_are_not_capped_in_the_pipeline(spark, tmp_path):
    """Frequencies are those of the most frequent values, codes those of all, and M columns of other values are -1."""
    from feldspark.config import Config
    from feldspark.plans.pipeline import Pipeline

    df = spark.range(300).selectExpr("CAST(id AS INT) AS TransactionID", "id AS TransactionDT", "0 AS split", "CAST(id AS STRING) AS card1", "CONCAT('v', id % 150) AS ProductCD", "IF(id % 2 = 0, 'M0', 'T') AS M4")
    p = Pipeline(spark, Config(freq_top=20), str(tmp_path))
    p.params["train_n"] = 300
    out = {r["TransactionID"]: r for r in p.encode(df).collect()}
    assert {r["ProductCD"] for r in out.values()} == set(range(150))
    assert sum(r["card1_freq"] for r in out.values()) == 20
    assert {(i % 2, r["M4"]) for i, r in out.items()} == {(0, -1), (1, 1)}


def test_codes_of_all_values(spark):
    df = spark.range(50_100).selectExpr("CAST(id AS STRING) AS a", "CAST(id % 3 AS STRING) AS b")
    got = {(r["column"], r["value"]): (r["count"], r["code"]) for r in encode.fit(df, ["a", "b"], None).collect()}
    assert [got["b", v] for v in "012"] == [(16_700, 0), (16_700, 1), (16_700, 2)]
    assert {v: got["a", v] for _, v in got if _ == "a"} == {v: (1, i) for i, v in enumerate(sorted(map(str, range(50_100))))}


def test_sums_of_amounts_do_not_depend_on_parts(spark, monkeypatch, hot):
    """To the last bit, with amounts that doubles don't hold exactly."""
    df = hot.withColumn("TransactionAmt", stats.F.col("TransactionAmt") / 7 + stats.F.col("TransactionID") * 0.1)
    found = []
    for rows in (20, 50, 300, 10**6):
        monkeypatch.setattr(stats, "PART_ROWS", rows)
        found.append({r["TransactionID"]: r["amt_to_avg_card_ratio"] for r in engineer.history(df, ["card"]).collect()})
    assert len(found[0]) == 900 and all(f == found[0] for f in found)


@pytest.mark.parametrize("name", ["card_causal", "interactions"])
def test_ratio_to_earlier_amounts_of_nothing(spark, tmp_path, name):
    values = {1: [0.0, 5.0, 2.0], 2: [0.0, 0.0, 7.5], 3: [0.0, -0.25, 1.0], 4: [0.5, -0.5, 2.0]}
    rows = [(u * 10 + i, f"2024-01-0{i + 1} 00:00:00", u, "view", v, "") for u, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", stats.F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    against_sql(spark, str(tmp_path), name)


@pytest.mark.parametrize("kind", ["spread", "ties", "alike", "far"])
def test_nearest_by_blocks(monkeypatch, kind):
    """The same rows in the same order as the plain search, with many equal distances, equal rows and distant ones, and padding."""
    import numpy as np
    from feldspark.operators import impute

    monkeypatch.setattr(impute, "LARGE", 1)
    rnd = np.random.default_rng(5)
    base = {"spread": rnd.normal(size=(3001, 6)), "ties": rnd.integers(0, 3, (3001, 6)).astype(float), "alike": np.ones((3001, 6)), "far": rnd.normal(size=(3001, 6)) * 1e4}[kind]
    query = np.concatenate([base[:150], rnd.normal(size=(150, 6))])
    for k in (1, 5, 200):
        assert (impute.finder(base, k)(query) == impute.nearest(query, base, k)).all()
    assert (impute.finder(base[:3], 5)(query) == impute.nearest(query, base[:3], 5)).all()


def test_nearest_by_blocks_takes_less_time():
    import time

    import numpy as np
    from feldspark.operators import impute

    rnd = np.random.default_rng(5)
    base, query = rnd.normal(size=(50_000, 8)), rnd.normal(size=(640, 8))
    took = []
    for find in (lambda q: impute.nearest(q, base, 5), impute.finder(base, 5)):
        find(query[:64])
        began = time.process_time()
        find(query)
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 3


@pytest.mark.parametrize("gather", [20, 1000])
def test_quantiles_of_large_tables(spark, monkeypatch, gather):
    """With values that take many ranks, nulls, infinities and a column without values; sketches of a few values."""
    import numpy as np
    from feldspark.operators import stats as st

    monkeypatch.setattr(st, "HELD", 0)
    monkeypatch.setattr(st, "GATHER", gather)
    rnd = np.random.default_rng(6)
    n = 6000
    columns = {"a": rnd.normal(size=n), "b": np.where(rnd.random(n) < 0.9, 4.0, rnd.integers(0, 9, n)), "c": np.where(rnd.random(n) < 0.3, None, rnd.exponential(size=n)), "d": np.where(rnd.random(n) < 0.2, np.inf, np.where(rnd.random(n) < 0.2, -np.inf, rnd.normal(size=n))), "e": np.full(n, None)}
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns)).cache()
    # places that fall on ranks, so that no infinity is interpolated
    got = st.quantiles(df, ["a", "b", "c", "e"], [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])
    for c in "abc":
        own = [float(v) for v in columns[c] if v is not None]
        assert got[c] == pytest.approx(np.quantile(own, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]).tolist())
    assert got["e"] is None
    assert st.quantiles(df, ["d"], [0.5])["d"] == pytest.approx([np.median(columns["d"].astype(float))])
