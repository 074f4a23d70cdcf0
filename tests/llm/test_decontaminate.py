import random

from feldspark.llm import decontaminate as D

APPLES = "Tom has 5 apples and buys 7 more apples from Anna for 3 dollars. How many apples does Tom have?"


def matches(item, text):
    return D.Table([(1, item)]).matches(text)


def test_reparameterised_questions_are_found():
    other = "Well: Peter has 12 apples and buys 30 more apples from Maria for 9 dollars. How many apples does Peter have? Fine."
    ((item, covered, size, changed),) = matches(APPLES, other)
    assert (item, size, changed) == (1, 20, True) and covered >= D.ENOUGH


def test_slots_must_be_consistent():
    assert not matches(APPLES, "Peter has 12 apples and buys 30 more apples from Peter for 9 dollars. How many apples does Maria have?")
    # what is equal in plain tokens counts, whatever the slots
    assert matches(APPLES, APPLES.replace("does Tom", "does Jane").replace("Tom has", "Tom has"))


def test_plain_copies_and_clean_texts():
    rnd = random.Random(0)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "mnrs"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(20)) for i in range(50)]
    table = D.Table(items)
    for i, t in items:
        assert [m[0] for m in table.matches(text(30) + " " + t.upper().lower() + " " + text(30))] == [i]
        assert table.matches(text(300)) == []
        assert [m[0] for m in table.matches(text(5) + " " + " ".join(t.split()[3:16]))] == [i]
        assert table.matches(text(5) + " " + " ".join(t.split()[3:13]) + " " + text(5)) == []


def test_slots_alone_never_match():
    assert not matches("In 1990 Paris and London and Rome and Oslo won 5 and 6", "In 1991 Lima and Quito and Bern and Riga won 7 and 8")
    assert matches("In 1990 Paris and London and Rome and Oslo won 5 and 6", "so In 1990 Paris and London and Rome and Oslo won 5 and 6 ok")


def test_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()}
    assert want and want <= got

    def runs(text):
        w = D._TOKEN.findall(text.lower())
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    grams = {i: runs(t) for i, t in items}
    texts = {r["doc_id"]: runs(r["text"]) for r in docs.collect()}
    assert all(grams[i] & texts[d] for d, i in got - want)


def test_blocks_nulls_repeats_and_columns(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 10)
    bench = spark.createDataFrame([(1, APPLES), (2, APPLES), (None, APPLES), (3, None), (4, "too short"), (5, " ".join(f"word{c}" for c in "abcdefghijklm"))], "item_id long, text string")
    rows = [(1, APPLES, "m"), (1, APPLES, "m"), (2, None, "m"), (3, "", "m"), (None, "clean words only", "m"), (6, "x " + " ".join(f"word{c}" for c in "abcdefghijklm"), "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect())
    assert len(got) == 3 and got[0] == got[1] and got[2] == (6, 5)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 3]
    assert D.clean(docs, bench.where("false")).count() == 6
    assert D.contaminated(docs.where("false"), bench).count() == 0


def test_copies_in_any_letter_case():
    texts = [
        APPLES,
        "Doesbo tari mel kono Vesta lupi ram Doesbo sino tel miro kasa dun pelo",
        "Die Straße nach Köln war im Jahr 1990 länger als die Straße nach Mainz und Bonn heute noch",
    ]
    for text in texts:
        for other in (text.upper(), text.lower(), text.title(), text.swapcase()):
            assert [m[0] for m in matches(text, f"Nothing here of that. {other} NOR HERE.")] == [1]
            assert [m[0] for m in matches(other, f"Nothing here of that. {text} NOR HERE.")] == [1]


def test_capitals_alone_never_match():
    assert not matches(APPLES, "JANE SAW 4 HORSES AND RODE 9 OTHER HORSES TOWARDS PARIS IN 2 HOURS. WHERE ARE THE HORSES NOW?")


def agree(x, y):
    """Whether two tokens are equal in any letter case, or slots of one kind, with or without their letter case."""
    fold = x.casefold(), y.casefold()
    return fold[0] == fold[1] or any(D.kind_of(v) == D.kind_of(w) != D.LITERAL for v, w in ((x, y), fold))


def fits(pairs):
    """Whether slots stand for one value each, and names for different ones."""
    slots, names, fine = {}, {}, True
    for x, y in pairs:
        kind, x, y = D.kind_of(x), x.casefold(), y.casefold()
        fine &= kind == D.LITERAL or slots.setdefault((kind, x), y) == y
        fine &= kind != D.NAME or names.setdefault(y, x) == x
    return fine


def alike(a, b):
    """Whether two windows match: on their templates, without letter case and with slots for numbers and units, or as they are."""
    same = lambda x, y: x.casefold() == y.casefold()
    kinds, caseless = [D.kind_of(x) for x in a], [D.kind_of(x.casefold()) for x in a]
    template = D.LITERAL in kinds and all(D.kind_of(y) == k and (k != D.LITERAL or same(x, y)) for x, y, k in zip(a, b, kinds, strict=True))
    if D.LITERAL not in caseless:
        return template or all(map(same, a, b))
    return template or all(D.kind_of(y.casefold()) == k and (k != D.LITERAL or same(x, y)) for x, y, k in zip(a, b, caseless, strict=True))


def brute(items, text):
    """Matches by the definition, on strings: every window of a text against every one of an item."""
    seen, out = {}, []
    for i, t in sorted(items):
        seen.setdefault(tuple(D._TOKEN.findall(t)), i)
    tokens = D._TOKEN.findall(text)
    fold = [t.casefold() for t in tokens]
    for own, i in seen.items():
        size = min(D.WINDOW, len(own))
        diagonals = {}
        for p in range(len(own) - size + 1 if own else 0):
            for q in range(len(tokens) - size + 1):
                if alike(own[p : p + size], tokens[q : q + size]):
                    diagonals.setdefault(q - p, []).append(p)
        covered, same, changed = set(), set(), False
        for shift, starts in diagonals.items():
            every = {k for s in starts for k in range(s, s + size)}
            if not fits([(own[k], tokens[k + shift]) for k in sorted(every)]):
                every = {k for s in starts if all(own[j].casefold() == fold[j + shift] for j in range(s, s + size)) for k in range(s, s + size)}
            equal = {k for k in every if own[k].casefold() == fold[k + shift]}
            covered |= every
            same |= equal
            changed |= equal != every
        share = 0.5 if len(own) >= D.WINDOW else 0.75
        if own and len(covered) >= min(D.ENOUGH, len(own)) and len(same) >= share * len(covered):
            out.append((i, len(covered), len(own), changed))
        elif D.WINDOW < len(own) < D.ENOUGH + D.WINDOW:
            for shift in sorted(diagonals):
                if 0 <= shift <= len(tokens) - len(own):
                    pairs = [(x, y) for x, y in zip(own, tokens[shift : shift + len(own)], strict=True) if agree(x, y)]
                    if len(pairs) >= len(own) - 1 and fits(pairs) and 2 * sum(x.casefold() == y.casefold() for x, y in pairs) >= len(pairs):
                        out.append((i, len(pairs), len(own), True))
                        break
    return sorted(out)


ITEMS = [
    (1, APPLES),
    (2, "Who wrote Moby Dick?"),
    (3, "What is two plus two"),
    (4, "A train runs 60 km in 2 hours and then 90 km in 3 hours , how many km is that per hour"),
    (5, "Box A has 5 red 7 blue 9 green , box B has 4 red 6 blue 8 green , box C 3 red"),
    (6, "北京是中国的首都吗"),
    (7, "42 km"),
    (8, "In 1990 Paris and London and Rome and Oslo won 5 and 6"),
    (9, "Who wrote Moby Dick ?"),
    (10, "..."),
    (11, "when she came home from the mill she put 3 loaves away"),
    (12, "Tom paid 5 dollars"),
    (13, "Der Hund des Bauern lief 5 km durch den Wald und fand 7 Knochen"),
]


def test_equal_to_brute_force_on_planted_copies():
    rnd = random.Random(3)
    filler = "the boat went up river and people of town saw it as they do every year in Mainz or Bonn for 3 or 4 days".split()
    table = D.Table(ITEMS)
    found = set()
    for trial in range(700):
        i, item = rnd.choice(ITEMS)
        kind = trial % 8
        if kind == 0:
            item = item.upper()
        elif kind == 1:
            item = " ".join(str(rnd.randrange(2, 99)) if w.isdigit() else w for w in item.split())
        elif kind == 2:
            item = item.replace("Tom", "Peter").replace("Anna", "Maria").replace("km", "miles").replace("60", "70")
        elif kind == 3:
            item = " ".join(item.split()[rnd.randrange(3) :])
        elif kind == 4:
            item = item.lower()
        elif kind == 5:
            words = item.split()
            words[rnd.randrange(len(words))] = rnd.choice(["boat", "Oslo", "17"])
            item = " ".join(words)
        elif kind == 6:
            item = " ".join(str(rnd.randrange(2, 99)) if w.isdigit() else w for w in item.split()).upper()
        text = " ".join(rnd.choices(filler, k=rnd.randrange(20))) + f". {item} " + " ".join(rnd.choices(filler, k=rnd.randrange(20)))
        got = table.matches(text)
        assert got == brute(ITEMS, text), text
        found |= {(m[0], m[3]) for m in got}
    assert {(1, True), (4, True), (5, True), (11, True), (12, True), (13, True)} <= found and {2, 3, 6, 7, 8} <= {i for i, _ in found}


def test_short_items_and_scripts_without_spaces():
    assert [m[0] for m in D.Table(ITEMS).matches("They asked: WHO WROTE MOBY DICK? Nobody knew.")] == [2]
    assert not D.Table(ITEMS).matches("Who wrote the story of Moby Dick")
    assert [m[0] for m in D.Table(ITEMS).matches("问题:北京是中国的首都吗?是的")] == [6]
    assert D._TOKEN.findall("abc中文x") == ["abc", "中", "文", "x"]


def test_number_dense_questions_are_found_with_other_numbers():
    other = "Box A has 15 red 17 blue 19 green, box B has 14 red 16 blue 18 green, box C 13 red"
    ((item, _, _, changed),) = D.Table(ITEMS).matches(f"So it is. {other}. The end of it.")
    assert (item, changed) == (5, True)
    # slots of other values alone are no evidence
    assert not D.Table([(1, "set 1 2 3 4 5 6 7 8 9 10 11 12 13 14")]).matches("set 21 22 23 24 25 26 27 28 29 30 31 32 33 34")


def test_a_very_long_text_and_one_of_repeats():
    text = "the boat went up river " * 400_000 + APPLES.replace("5", "8")
    assert [m[0] for m in D.Table(ITEMS).matches(text)] == [1]
    assert D.Table([(1, "the boat went up river " * 5)]).matches("the boat went up river " * 2000)[0][1] == 25


def test_equal_tokens_are_one_item_for_any_number_of_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t in ITEMS] + [(21, APPLES.replace("apples", "apples,")), (0, APPLES.replace(".", "!")), (22, "Who wrote: Moby Dick"), (None, APPLES), (23, None)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = [APPLES, APPLES.upper().replace("5", "8"), "Who wrote Moby Dick? Nobody.", "It is 42 km. Peter paid 5 dollars.", "nothing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((d, *m) for d, t in enumerate(texts) if t for m in brute([r for r in rows if r[0] is not None and r[1]], t))
    assert {(0, 0), (1, 0), (2, 2), (3, 7), (3, 12)} <= {w[:2] for w in want} and not {w[1] for w in want} & {1, 9, 21, 22}
    for windows in (1_000_000, 100, 12):
        monkeypatch.setattr(D, "BLOCK_WINDOWS", windows)
        assert sorted(tuple(r) for r in D.contaminated(docs, bench).collect()) == want, windows
        assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [4, 5]
    assert len(list(D.tables(bench))) > 3


def test_many_copies_of_an_item_are_one():
    table = D.Table([(i, APPLES) for i in range(5, 500)])
    assert [m[0] for m in table.matches(APPLES)] == [5]


def test_short_items_with_other_numbers():
    assert matches("Tom paid 5 dollars", "Once Tom paid 9 dollars there.") == [(1, 4, 4, True)]
    assert not matches("Tom paid 5 dollars", "Once Peter paid 9 dollars there.")
    assert not matches("5 apples", "We have 7 apples") and not matches("Who wrote Moby Dick?", "Who wrote Don Quixote?")


def test_other_numbers_in_capitals_and_among_capitalised_nouns():
    other = APPLES.replace("5", "12").replace("7", "30")
    assert [(m[0], m[3]) for m in matches(APPLES, "NOT THAT. " + other.upper())] == [(1, True)]
    assert not matches(APPLES, "NOT THAT. " + other.upper().replace("APPLES", "HORSES").replace("BUYS", "SELLS"))
    item = "Der Hund des Bauern lief 5 km durch den Wald und fand 7 Knochen"
    assert matches(item, item.replace("5", "6").replace("7", "9"))


def test_one_token_may_be_another():
    item = "when she came home from the mill she put 3 loaves away"
    assert len(item.split()) == 12
    # at any place that leaves a window; a second one is too many
    for k in (0, 1, 5, 6, 10, 11):
        words = item.replace("3", "8").split()
        words[k] = "otherwise"
        assert matches(item, "so " + " ".join(words) + " and on") == [(1, 11, 12, True)], k
    assert not matches(item, item.replace("mill", "town").replace("came", "went"))
    assert not matches(item + " from all of us who stayed on in town", item.replace("mill", "town"))
