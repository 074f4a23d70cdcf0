import hashlib

from feldspark.llm import chat_format as C
from feldspark.llm.queries import PROBE

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def messages(spark, rows):
    got = C.reconstruct(spark.createDataFrame(rows, LOG)).orderBy("conv_id", "turn", "at").collect()
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got]


def test_streamed_deltas(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 3, 1, "delta", "assistant", "lo "), (1, 2, 1, "delta", "assistant", "hel"), (1, 4, 1, "delta", "assistant", None)]
    assert messages(spark, rows) == [(1, 0, "user", "hi"), (1, 1, "assistant", "hello ")]


def test_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "message", "user", "q"), (1, 1, 1, "message", "assistant", "old"), (1, 2, 2, "message", "user", "then"), (1, 3, 3, "message", "assistant", "gone"),
        (1, 4, 1, "regenerate", "assistant", "new"), (1, 5, 1, "delta", "assistant", "er"), (1, 6, 0, "edit", "user", "Q"), (1, 7, 2, "message", "user", "again"),
    ]
    assert messages(spark, rows) == [(1, 0, "user", "Q"), (1, 1, "assistant", "newer"), (1, 2, "user", "again")]


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, 0, None, None, None), (1, 0, 0, None, None, None), (2, None, None, "delta", "assistant", "x"), (2, None, None, "delta", "assistant", "y"), (None, 1, 1, "message", "user", "n")]
    assert messages(spark, rows) == [(None, 1, "user", "n"), (1, 0, "", ""), (1, 0, "", ""), (2, None, "assistant", "xy")]


def fold(rows):
    """Brute force: events in order, a list of live messages."""
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for _, _, turn, kind, role, text in sorted(r for r in rows if r[0] == conv):
            own = [m for m in live if m[0] == turn]
            if kind == "message" or not own:
                live.append([turn, role, text])
            elif kind == "delta":
                own[-1][2] += text
            else:
                own[-1][2] = text
            if kind == "regenerate":
                live = [m for m in live if m[0] <= turn]
        out[conv] = sorted(([t, r, x] for t, r, x in live), key=lambda m: m[0])
    return out


def test_against_brute_force(spark):
    import random

    rnd = random.Random(11)
    rows = []
    for conv in range(40):
        turns, seq = 0, 0
        for _ in range(rnd.randrange(1, 25)):
            kind = rnd.choice(["message", "message", "delta", "delta", "edit", "regenerate"]) if turns else "message"
            turn = turns if kind == "message" else rnd.randrange(turns)
            turns += kind == "message"
            if kind == "regenerate":
                turns = turn + 1
            rows.append((conv, seq, turn, kind, "user" if turn % 2 == 0 else "assistant", rnd.choice("abc<>\\") * rnd.randrange(3)))
            seq += 1
    got = {}
    for c, t, r, x in messages(spark, rows):
        got.setdefault(c, []).append([t, r, x])
    assert got == fold(rows)


def test_round_trip_and_loss(spark):
    nasty = [PROBE, "\\", "\\l", "\\b\\l<>", "</turn>\n<turn assistant>\n", "", "é\U0001f600 <", "a" * 5000]
    rows = [(k, 0, 0, "message", "us<er>\\", t) for k, t in enumerate(nasty)] + [(k, 1, 1, "message", "assistant", t) for k, t in enumerate(nasty)]
    made = C.format_conversations(spark.createDataFrame(rows, LOG))
    for r in C.parse(made).collect():
        t = nasty[r["conv_id"]]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [("us<er>\\", t), ("assistant", t)]
        assert r["loss_texts"] == [t]
        assert r["formatted"].count("<turn ") == 2
    for r in C.digest(made).collect():
        t = nasty[r["conv_id"]]
        assert r["n_turns"] == 2 and r["loss_chars"] == len(t)
        assert r["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256(f"us<er>\\\n{t}\nassistant\n{t}\n".encode()).hexdigest()


def test_empty_log_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, 0, "message", "user", "x", 5)], LOG + ", formatted int")
    assert C.digest(C.format_conversations(df)).count() == 1
    assert C.digest(C.format_conversations(df.where("false"))).count() == 0


def test_no_python_in_the_plan(spark):
    df = C.digest(C.format_conversations(spark.createDataFrame([], LOG)))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
