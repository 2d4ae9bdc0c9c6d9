"""The name chain, the composite score and the sentences of reports."""

import random

import pytest
from pyspark.sql import functions as F

from furlong import catalog
from furlong.functions import similarity, text
from furlong.operators import resolve
from furlong.sources import report_text


def chain(events, known):
    out = {}
    for i, name, body in events:
        inside = sorted((-len(k), k) for k in known if name and k in name)
        around = sorted((len(k), k) for k in known if name and name in k)
        ratios = sorted((-similarity.indel_ratio(name, k), k) for k in known) if name else []
        text = sorted((-len(k), k) for k in known if len(k) >= 4 and f" {k} " in f" {body} ")
        if name in known:
            out[i] = (name, "exact", 1.0)
        elif inside or around:
            out[i] = ((inside or around)[0][1], "contained", 0.95)
        elif ratios and -ratios[0][0] >= 95:
            out[i] = (ratios[0][1], "similar", -ratios[0][0] / 100)
        elif text:
            out[i] = (text[0][1], "in_text", 0.95)
        else:
            out[i] = (None, "none", 0.0)
    return out


def test_name_chain_against_plain_search(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("ABCDE") for _ in range(draw.randint(1, 9)))
    known = {" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(60)} | {"A", "ABCABCABCABCABCABCAB"}
    pick = sorted(known)
    events = []
    for i in range(150):
        name = draw.choice(pick)
        cut = draw.randrange(len(name))
        name = draw.choice([name, name + " KG", name[:-2], name[:cut] + name[cut + 1 :], word() + "Z" + word(), "", "ABCABCABCBCABCABCAB"])
        body = " ".join(draw.choice([word(), draw.choice(pick), "A"]) for _ in range(6))
        events.append((i, name, body))
    events.append((999, None, "nothing"))
    df = spark.createDataFrame(events, "id int, nm string, body string")
    out = resolve.name_chain(df, spark.createDataFrame([(k,) for k in known] + [(None,), ("",)], "name string"), "id", "nm", "body", "name")
    got = {r.id: (r.matched_name, r.match_step, round(r.match_confidence, 9)) for r in out.collect()}
    assert got == {i: (n, s, round(c, 9)) for i, (n, s, c) in chain(events, known).items()}


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("SEA STAR", "SEA STAR", 100.0), ("SEA STAR", "STAR SEA", 95.0), ("SEA STAR", "SEA STAR II", 95.0), ("STAR", "XXXSTARXXX", 90.0),
        ("AB", "XXXXXXXXXABXXXXXXXX", 60.0), ("", "A", 0.0), ("ABCDEFGHIJ", "ABCDEFGHI", 2 * 9 / 19 * 100), ("STAR", "SEA STAR OF WIND", 90.0),
    ],
)
def test_composite_score(a, b, score):
    assert similarity.composite_ratio(a, b) == pytest.approx(score) == similarity.composite_ratio(b, a)


@pytest.mark.parametrize("cutoff", [86.0, 94.5])
def test_no_composite_pair_is_lost(spark, cutoff):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("ABC") for _ in range(draw.randint(2, 6)))
    left = sorted({" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(70)} | {"AA AA BCBCBC"})
    right = sorted({" ".join(word() for _ in range(draw.randint(1, 3))) for _ in range(70)} | {"AAA BCBCBC"})
    out = resolve.composite_pairs(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), "l", "r", cutoff)
    assert {(r.l, r.r) for r in out.collect()} == {(x, y) for x in left for y in right if similarity.composite_ratio(x, y) >= cutoff}


def test_links_show_their_evidence(spark):
    people = [(1, "SEA STAR", "FATHER ONE", "MOTHER ONE"), (2, "SEA STARS", "FATHER ONE", "MOTHER ONE"), (3, "LONE WOLF RUNNER", "F", "M"), (4, "TWIN", "T", "T"), (5, "TWIN", "T", "T")]
    asked = [(1, "SEA STAR", "FATHER ONE", "MOTHER ONE"), (3, "LONE WOLF RUNER", "F", "M"), (4, "TWIN", "T", "T"), (9, "SEA STARZ", "FATHER ONE", "MOTHER ONE")]
    schema = "id int, name string, father_name string, mother_name string"
    out = {r.left_id: r for r in resolve.composite_links(spark.createDataFrame(asked, schema), spark.createDataFrame(people, schema)).collect()}
    assert set(out) == {1, 3} and out[1].method == "exact_name_parents"  # twins and near names have close runners-up
    assert out[3].right_id == 3 and out[3].score == pytest.approx(0.55 * out[3].name_score + 45) and out[3].father_score == 100.0 and out[3].runner_up is None


@pytest.mark.parametrize("few", [0, 1000])
def test_longest_name_inside_words_and_across_them(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "FEW_WORDS", few)
    said = ["the xx-SEAS\ntars run", "Starch, star!", "deep blue sea here", "deepblue", None, "", "sta r", "çelİk and Celika"]
    known = ["STAR", "STARS", "TARC", "EASTARS", "BLUE SEA", "EEPBL", "CELIK", "AB"]
    texts = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string")
    out = resolve.dictionary_match(texts, spark.createDataFrame([(n,) for n in known], "n string"), "i", "t", "n", clean=text.clean_name)
    bodies = {r.i: r.b for r in texts.select("i", text.clean_name("t").alias("b")).collect()}
    want = {(i, min((n for n in known if len(n) >= 4 and n in b), key=lambda n: (-len(n), n))) for i, b in bodies.items() if any(len(n) >= 4 and n in b for n in known)}
    assert set(map(tuple, out.select("i", "n").collect())) == want and len(want) == 5
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # no stretch of a text at every letter of it


def test_name_chain_sends_no_names_through_the_driver(spark):
    plan = catalog.queries()["name_chain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # events and what was found for them, not the plan of every step before
    assert "Broadcast" not in plan and plan.count("Scan parquet") <= 4


def test_only_records_that_reach_the_threshold_stand_against_a_link(spark):
    people = [(1, "SEA STAR RUNNER", "FATHER", "MOTHER"), (2, "SEA STAR RUNNERS", "FATHER", "MATTER"), *[(10 + i, "LONG WAY HOME" + "S" * (i > 0), "F" + "X" * (i == 2), "M") for i in range(3)]]
    asked = [(1, "SEA STAR RUNNE", "FATHER", "MOTHER"), (7, "LONG WAY HOMEE", "F", "M")]
    schema = "id int, name string, father_name string, mother_name string"
    left, right = spark.createDataFrame(asked, schema), spark.createDataFrame(people, schema)
    part = similarity.composite_ratio
    scored = {a: {p[0]: sum(w * part(x, y) for w, x, y in zip((0.55, 0.225, 0.225), t, p[1:], strict=True)) for p in people} for a, *t in asked}
    assert scored[1][1] >= 97 > scored[1][2] > scored[1][1] - 10
    out = {r.left_id: r for r in resolve.composite_links(left, right, 97.0, 10.0).collect()}
    assert set(out) == {1, 7} and all((r.runner_up, r.candidates) == (None, 1) for r in out.values()) and out[1].right_id == 1
    wide = {r.left_id: r for r in resolve.composite_links(left, right, 92.0, 0.1).collect()}
    assert wide[7].candidates == sum(s >= 92.0 for s in scored[7].values()) == 3


def test_report_sentences(spark):
    said = [
        "4. koşuda 7 numarada kayıtlı KARA YEL isimli at", "2.  Koşuda 11 numaralı kayıtlı olarak koşan Çelik-Bilek isimli at topal", "5 numara kayıtlı RÜZGAR isimli at",
        "kayıtlı RÜZGAR isimli at", "3 numarada 9 isimli at", "hiçbir şey", "1. koşuda 3 numarada kayıtlı A1B isimli at",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, p string").withColumns(report_text.entry_fields(F.col("p")))
    got = [tuple(r)[2:] for r in df.orderBy("i").collect()]
    assert got[0] == (4, 7, "KARA YEL") and got[1] == (2, 11, "CELIKBILEK") and got[2] == (None, 5, "RUZGAR")
    assert [g[2] for g in got[3:]] == [None] * 4
    kinds = spark.createDataFrame([("Jokey listesi",), ("ANTRENÖR",), ("Çıkış Nedeni",), ("SEYİS",), ("x",)], "t string").select(report_text.table_type(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()][:2] == ["JOCKEY_CHANGE", "TRAINER_CHANGE"] and [r.k for r in kinds.collect()][3:] == ["GROOM_CHANGE", "UNKNOWN"]
