import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspark.config import Config
from feldspark.operators import checks, clean, encode, engineer, flags, impute, reduce, scale, split, winsor

CARD = "TransactionID long, TransactionDT long, TransactionAmt double, card1 string, card2 int, card3 string, card5 string, addr1 int, D1 int"
CARDS = [
    (1, 0, 10.0, "A", 1, "x", "p", 1, 0),
    (2, 86400, 20.0, "A", 1, "x", "p", 1, 1),
    (3, 172800, 30.0, "A", 1, "x", "p", 1, 2),
    (4, 0, 40.0, "B", 2, "y", "q", 2, 0),
    (5, 86400, 50.0, "B", 2, "y", "q", 2, 1),
    (6, 0, 60.0, "C", 3, "z", "r", 3, 0),
]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(CARDS, CARD)


def test_causal_history(cards):
    df = cards.withColumn("k", engineer.card_key(cards))
    got = {r["TransactionID"]: r for r in engineer.history(df, ["k"]).collect()}
    assert [got[i]["card_prior_txn_count"] for i in range(1, 7)] == [0, 1, 2, 0, 1, 0]
    assert [got[i]["card_is_first_seen"] for i in range(1, 7)] == [1, 0, 0, 1, 0, 1]
    assert [got[i]["card_velocity"] for i in range(1, 7)] == pytest.approx([0, 1 / 2, 2 / 3, 0, 1 / 2, 0])
    assert [got[i]["amt_to_avg_card_ratio"] for i in range(1, 7)] == pytest.approx([1, 2, 2, 1, 1.25, 1])
    assert [got[i]["card_time_since_last"] for i in range(1, 7)] == pytest.approx([-1, math.log(86401), math.log(86401), -1, math.log(86401), -1])


def test_history_ignores_later_rows(cards):
    key = ["card1"]
    full = {r["TransactionID"]: r for r in engineer.history(cards, key).collect()}
    early = engineer.history(cards.where("TransactionDT <= 86400"), key).collect()
    assert all(full[r["TransactionID"]] == r for r in early)


def test_prior_mean_of_zero_and_ties(spark):
    rows = [(1, 5, 0.0, "A"), (2, 5, 3.0, "A"), (3, 5, 500.0, "A")]
    got = engineer.history(spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 string"), ["card1"]).orderBy("TransactionID").collect()
    assert [r["amt_to_avg_card_ratio"] for r in got] == [1.0, 100.0, 100.0]
    assert [r["card_prior_txn_count"] for r in got] == [0, 1, 2]


def test_ratio_over_amounts_of_nothing(spark):
    """The operator clips an infinite ratio; missing amounts are no part of sums and have no ratio; amounts are exact in any order."""
    amounts = [0.0, 0.0, -3.0, 3.0, None, 5.0, 0.1, 0.2, 1e12, -1e12, 0.3]
    df = spark.createDataFrame([(i, i, a, "A") for i, a in enumerate(amounts)], "TransactionID long, TransactionDT long, TransactionAmt double, card1 string")
    got = [r["amt_to_avg_card_ratio"] for r in engineer.history(df, ["card1"]).orderBy("TransactionID").collect()]
    # earlier sums: 0, 0, 0, -3, 0, 0, 5, 5.1, 5.3, 1e12 + 5.3, 5.3
    assert got == [1.0, 100.0, 0.0, 0.0, None, 100.0, 0.12, pytest.approx(0.2 * 7 / 5.1), 100.0, 0.0, 0.3 * 10 / 5.3]


def test_key_ids(cards):
    ids = [r["card_key_id"] for r in engineer.key_ids(cards, engineer.card_key(cards)).orderBy("TransactionID").collect()]
    assert ids == [0, 0, 0, 1, 1, 2]


def test_encoders(spark):
    train = spark.createDataFrame([(v,) for v in ["A", "A", "B", "C", "A", None]], "s string")
    test = spark.createDataFrame([(i, v) for i, v in enumerate(["A", "D", None, "B"])], "i int, s string")
    v = encode.fit(train, ["s"])
    assert {r["value"]: r["count"] for r in v.collect()} == {"A": 3, "B": 1, "C": 1, "unknown": 1}
    assert [r["s_freq"] for r in encode.apply_frequency(test, v, "s").orderBy("i").collect()] == [3, 0, 1, 1]
    assert [r["s"] for r in encode.apply_ordinal(test, v, "s").orderBy("i").collect()] == [0, -1, 3, 1]
    assert [r["s"] for r in encode.apply_ordinal(test, v, "s", missing_code=-1).orderBy("i").collect()] == [0, -1, -1, 1]
    assert [r["s_freq"] for r in encode.apply_frequency(test, v, "s", total=6).orderBy("i").collect()] == pytest.approx([0.5, 0, 1 / 6, 1 / 6])


def test_many_categories_and_top(spark):
    train = spark.range(3000).select((F.col("id") % 300).cast("string").alias("s"))
    v = encode.fit(train, ["s"])
    assert sorted(r["code"] for r in v.collect()) == list(range(300))
    top = encode.fit(train, ["s"], 7)
    assert sorted(r["value"] for r in top.collect()) == sorted(map(str, range(300)))[:7]


def test_true_false(spark):
    v = encode.fit(spark.createDataFrame([("T", "M0"), (None, "T")], "a string, b string"), ["a", "b"])
    assert encode.is_true_false(v, "a") and not encode.is_true_false(v, "b")


def test_flags(spark):
    rows = [(i, None if i % 2 else 1.0, None if i % 2 else 2.0, None if i % 4 else 1.0, None if i % 4 else 5.0, 1.0 if i % 3 else None) for i in range(24)]
    df = spark.createDataFrame(rows, "TransactionID int, V1 double, V2 double, D3 double, V9 double, V5 double")
    own = ["V1", "V2", "D3", "V9", "V5"]
    assert flags.groups(df, own) == [["V1", "V2"], ["D3", "V9"], ["V5"]]
    assert [flags.name(g) for g in (["V1", "V2"], ["D3", "V9"], ["V5"], ["id_2", "id_1"], ["V12", "V3", "V100", "V7"])] == ["Vgrp1_2_missing", "D3_missing", "V5_missing", "id_1_missing", "Vgrp100_12_3_missing"]
    rates = {"V1": 0.05, "V2": 0.9, "D3": 0.91, "V9": 0.06, "V5": 0.0}
    assert flags.candidates(own, rates, Config()) == ["V2", "V9"]


def test_winsor_and_skew(spark):
    values = [float(i) for i in range(1, 100)] + [10_000.0]
    df = spark.createDataFrame([(v, -v if v > 90 else v / 100, None) for v in values], "a double, b double, n double")
    params = winsor.fit(df, ["a", "b", "n"], Config(winsor=(0.0, 1.0)))
    assert params["a"]["transform"] == "log1p" and params["b"]["transform"] == "signed_log1p" and "n" not in params
    low, high = np.quantile(values, [0.01, 0.99])
    p = winsor.fit(df, ["a"], Config())["a"]
    assert (p["low"], p["high"]) == pytest.approx((low, high))


def test_yeo_johnson(spark):
    rnd = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x),) for x in np.exp(rnd.normal(size=800))], "x double")
    lam = winsor.best_lambdas(df, ["x"])["x"]
    assert -1.5 < lam < 0.5
    got = winsor.transform(df, {"x": {"low": 0, "high": 1e9, "transform": "yeo_johnson", "lambda": lam}})
    from feldspark.operators import stats

    assert abs(stats.skewness(got, ["x"])["x"]) < 0.5


def test_scale(spark):
    df = spark.createDataFrame([(float(i), 5.0, 1.0 if i == 0 else 0.0, None) for i in range(100)], "a double, same double, rare double, n double")
    params = scale.fit(df, ["a", "same", "rare", "n"])
    assert params["same"]["scale"] == 1.0 and params["rare"]["scale"] == pytest.approx(0.1) and "n" not in params
    far = spark.createDataFrame([(1e9,), (None,)], "a double")
    assert [r["a"] for r in scale.transform(far, {"a": params["a"]}).collect()] == [10.0, None]


def test_fit_sees_train_alone(spark):
    df = spark.createDataFrame([(i, i % 3, float(i * (1 + 100 * (i % 3)))) for i in range(90)], "TransactionID int, split int, x double")
    fit = lambda t: (scale.fit(t, ["x"]), winsor.fit(t, ["x"], Config()))
    assert checks.fitted_on_train(lambda t: fit(split.train(t)), df, ["x"])[1]
    assert not checks.fitted_on_train(fit, df, ["x"])[1]


def test_impute_plan():
    rates = {"a": 0.0, "b": 0.05, "c": 0.49, "d": 0.5, "e": 0.9}
    assert impute.plan(rates, list(rates), Config()) == {"a": "none", "b": "knn", "c": "knn", "d": "median", "e": "median"}


def test_knn(spark):
    rnd = np.random.default_rng(2)
    points, targets = rnd.normal(size=(200, 5)), rnd.normal(size=(200, 3))
    targets[10, 0] = targets[50, 1] = np.nan
    rows = [(i, *map(float, points[i]), *[None if np.isnan(v) else float(v) for v in targets[i]]) for i in range(200)]
    df = spark.createDataFrame(rows, "TransactionID long, " + ", ".join(f"a{i} double" for i in range(5)) + ", t0 double, t1 double, t2 double")
    got = impute.knn_fill(df, df.where("TransactionID < 100"), "TransactionID", [F.col(f"a{i}") for i in range(5)], ["t0", "t1", "t2"], 3, {}).orderBy("TransactionID").collect()
    for i, c in ((10, 0), (50, 1)):
        near = np.argsort(((points[:100] - points[i]) ** 2).sum(1), kind="stable")[:3]
        assert got[i][f"t{c}"] == pytest.approx(np.nanmean(targets[near, c]))
    assert all(r["t0"] is not None and r["t1"] is not None for r in got)


def test_knn_without_neighbours_takes_the_default(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 1.0, None)], "TransactionID long, a double, t double")
    got = impute.knn_fill(df, df, "TransactionID", [F.col("a")], ["t"], 5, {"t": 7.0}).collect()
    assert [r["t"] for r in got] == [7.0, 7.0]


def test_nan_aware_distance():
    a = np.array([[1.0, np.nan, 2.0]])
    b = np.array([[1.0, 5.0, 4.0], [np.nan, 3.0, np.nan]])
    assert impute._distances(a, b, True).tolist() == [[4.0 * 3 / 2, np.inf]]


def test_selection():
    assert reduce.select_top(["a", "b", "c", "d"], {"a": 0.5, "b": 0.9, "c": 0.7}, ("d", "x"), 3) == ["d", "b", "c"]
    assert reduce.cap_track(["a", "b", "c"], {"a": 1, "b": 2, "c": 3}, ("a",), 2) == ["a", "c"]
    m = np.array([[1, 0.99, 0.2], [0.99, 1, 0.96], [0.2, 0.96, 1]])
    assert reduce.greedy_correlation(["a", "b", "c"], m, ["a", "b", "c"], 0.95, ()) == (["a", "c"], ["b"])
    assert reduce.greedy_correlation(["a", "b", "c"], m, ["a", "b", "c"], 0.95, ("b",)) == (["a", "b"], ["c"])


def test_components(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 1)) @ np.array([[1.0, 2.0, -1.0]]) + rnd.normal(size=(300, 3)) * 0.01
    df = spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(x)], "TransactionID int, V1 double, V2 double, V3 double, V4 double")
    (block,) = reduce.fit_components(df, ["V1", "V2", "V3", "V4"], {"V1": 3, "V2": 3, "V3": 3, "V4": 9}, Config())
    assert block["columns"] == ["V1", "V2", "V3"] and len(block["components"]) == 1
    first = np.array(block["components"][0])
    assert np.abs(first) == pytest.approx([3**-0.5] * 3, abs=1e-3) and first[np.abs(first).argmax()] > 0
    got = [r["Vpca_b0_0"] for r in reduce.project(df, [block]).orderBy("TransactionID").collect()]
    z = (x - x.mean(0)) / x.std(0)
    assert got == pytest.approx((z @ first).tolist(), abs=1e-4)


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(-i)) for i in range(9)], "TransactionID int, a double, b double, c double")
    assert reduce.duplicates(df, ["a", "b", "c"]) == [["a", "b"]]


def test_split_and_windows(spark):
    df = spark.createDataFrame([(i, (i * 7) % 40) for i in range(100)], "TransactionID long, TransactionDT long")
    cfg = Config(train_n=40, val_n=10, test_n=10, window_rows=15, windows=2)
    got = split.assign(df, cfg).orderBy("TransactionDT", "TransactionID").collect()
    assert [r["split"] for r in got] == [0] * 40 + [1] * 10 + [2] * 10 + [3] * 40
    assert [r["window_id"] for r in got] == [-1] * 60 + [0] * 15 + [1] * 15 + [-1] * 10
    assert checks.splits_in_order(split.assign(df, cfg), cfg)[1]


def test_column_pruning(spark):
    rows = [(None if i else 1.0, 3.0, 1.0 if i else 2.0, float(i), 4.0) for i in range(400)]
    df = spark.createDataFrame(rows, "gone double, one double, near double, fine double, D1 double")
    assert clean.fit(df, Config()) == {"missing": ["gone"], "constant": ["one"], "near_constant": ["near"]}


def test_config():
    assert Config().key() != Config(seed=1).key()
    assert Config().sampled(20_000).train_n == int(273_000 * 20_000 / 590_540)
    with pytest.raises(ValueError):
        Config(skew_method="log")


def test_vector_queries_take_all_rows(spark, tmp_path):
    from feldspark.plans.queries import QUERIES

    rnd = np.random.default_rng(5)
    n = 700
    v = np.round(rnd.normal(size=(n, 6)), 4)
    spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for name in ("knn_impute", "knn_self_anchor", "knn_nan_euclidean", "pca_blocks"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r[0] for r in rows) == list(range(n))
        got[name] = {r[0]: r.asDict() for r in rows}
    t = v[:, 4:].copy()
    t[np.arange(n) % 3 == 0, 0] = np.nan
    t[np.arange(n) % 5 == 1, 1] = np.nan
    # by the z-scores of all anchors; by the columns themselves, among rows that miss none; by the coordinates that both rows have
    z = (v[:, :4] - v[:, :4].mean(0)) / v[:, :4].std(0, ddof=1)
    own = np.concatenate([v[:, :2], t], 1)
    whole = ~np.isnan(own).any(1)
    scaled = np.nan_to_num((own - own[whole].mean(0)) / own[whole].std(0))
    default = {"knn_impute": np.nanmedian(t, 0), "knn_self_anchor": t[whole].mean(0), "knn_nan_euclidean": np.nanmean(t, 0)}
    for i in range(n):
        gap, both = own - own[i], ~np.isnan(own - own[i])
        d = {"knn_impute": ((z - z[i]) ** 2).sum(1), "knn_self_anchor": np.where(whole, ((scaled - scaled[i]) ** 2).sum(1), np.inf), "knn_nan_euclidean": np.where(both, gap**2, 0).sum(1) * 4 / both.sum(1)}
        for name, far in d.items():
            near = np.argsort(np.round(far, 9), kind="stable")[:5]
            for k, c in enumerate(("t1", "t2")):
                found = t[[i], k] if not np.isnan(t[i, k]) else t[near, k][~np.isnan(t[near, k])]
                want = found.mean() if len(found) else default[name][k]
                assert got[name][i][c] == pytest.approx(want, abs=2e-6)


def test_boosted_importance(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(600, 3))
    rows = [(int(a + 0.1 * b > 0), float(a), float(b), float(c)) for a, b, c in x]
    df = spark.createDataFrame(rows, "isFraud int, a double, b double, c double")
    got = reduce.gbt_importance(df.limit(400), ["a", "b", "c"], rounds=5, val=df.limit(100))
    assert max(got, key=got.get) == "a"
    assert reduce.gbt_importance(df.where("isFraud = 1"), ["a", "b"]) == {"a": 0.0, "b": 0.0}


def test_time_proxies(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5)], "TransactionID int, transaction_month int, transaction_year int, x double")
    assert reduce.features(df) == ["x"]
    assert reduce.features(df, Config(exclude_time_proxies=False)) == ["transaction_month", "transaction_year", "x"]


def test_dominated_and_constant_columns(spark):
    rows = [(1.0 if i else 2.0, float(i), "a" if i else "b", None if i % 2 else 5.0, 7) for i in range(200)]
    df = spark.createDataFrame(rows, "near double, wide double, word string, holes double, one int")
    from feldspark.operators import stats

    assert stats.dominated(df, df.columns, 0.995) == ["near", "word", "one"]
    assert stats.constant(df, df.columns) == ["holes", "one"]
