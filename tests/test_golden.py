"""Hand-computed cases on tiny frames."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from furlong import schemas
from furlong.functions import numbers, similarity, text
from furlong.operators import filters, latest, quality, resolve
from furlong.plans import coverage, diagnostics, drift, evaluated, features, gates, lifecycle, metrics, pnl, roi, shadow
from furlong.sources import scans


def at(s):
    return dt.datetime.fromisoformat(s)


PROGRAM_ROW = dict(
    snapshot_id=1, race_id="r", horse_id="horse:1", race_start_at=at("2026-01-01T10:00"), race_no=1, captured_at=at("2026-01-01T09:00"),
    source_endpoint="e", source_request_id="q", draw=1.0, carried_weight=55.0, jockey="J", trainer="T", handicap_rating=40.0,
    race_class="A", track="Istanbul", surface="K:", distance=1400.0, horse_name="AT 1",
)


def program(spark, *changes):
    return spark.createDataFrame([{**PROGRAM_ROW, **c} for c in changes], schemas.PROGRAM)


def prediction(**c):
    base = dict.fromkeys([f.split()[0] for f in schemas.PREDICTIONS.split(", ")])
    base.update(
        prediction_id="p", model_version="v", race_id="r", horse_id="horse:1", prediction_time=at("2026-01-01T09:00"),
        race_start_at=at("2026-01-01T15:30"), source_request_id="q", feature_values_json="{}",
    )
    base.update(c)
    return base


def result(**c):
    base = dict.fromkeys([f.split()[0] for f in schemas.RESULTS.split(", ")])
    base.update(result_id=1, race_id="r", horse_id="horse:1", race_start_at=at("2026-01-01T15:30"), captured_at=at("2026-01-01T17:00"), result_status="finished")
    base.update(c)
    return base


def test_late_snapshot_is_excluded(spark):
    df = program(spark, {}, {"snapshot_id": 2, "captured_at": at("2026-01-01T11:00")}, {"snapshot_id": 3, "captured_at": at("2026-01-01T10:00")})
    out = evaluated.latest_programs(df, latest.eligible_asof()).collect()
    assert [r.snapshot_id for r in out] == [1]


def _legacy(spark, *items):
    raw = [
        dict.fromkeys([f.split()[0] for f in schemas.HISTORY.split(", ")], None) | dict(
            horse_key="horse:1", race_id=f"h{i}", race_date=day, hippodrome="Istanbul", distance="1400", surface="K:", race_class=cls,
            finish=finish, weight="54,0", jockey="J", trainer="T",
        )
        for i, (day, finish, cls) in enumerate(items)
    ]
    return scans.history_columns(spark.createDataFrame(raw, schemas.HISTORY))


def _frame(spark, legacy, **target):
    program_rows = program(spark, target)
    return features.asof_frame(
        program_rows, spark.createDataFrame([], schemas.RESULTS), spark.createDataFrame([], schemas.AGF), spark.createDataFrame([], schemas.ODDS), legacy
    ).collect()[0]


def test_fallback_history_ignores_the_future(spark):
    row = _frame(spark, _legacy(spark, ("15.12.2025", "2", "B"), ("10.01.2026", "1", "A")))
    assert row.class_change == 1 and row.surface_change == 0 and row.distance_change == 0.0
    assert abs(row.days_since_last_race - (17 + 10 / 24)) < 1e-6
    assert row.surface_win_rate == 0.0 and row.weight_change == 1.0 and row.last_3_avg_position == 2.0


def test_invariance_to_future_rows_and_same_day_order(spark):
    past = [("15.12.2025", "2", "B"), ("20.12.2025", "1", "A")]
    assert _frame(spark, _legacy(spark, *past)) == _frame(spark, _legacy(spark, *past, ("02.01.2026", "9", "C")))
    targets = program(spark, {"race_start_at": at("2025-12-01T12:00"), "captured_at": at("2025-12-01T08:00")}).withColumn("start", F.col("race_start_at"))
    hist = spark.createDataFrame(
        [("horse:1", at(f"2025-12-01T{h}:00"), 1, f"s{h}", 54.0, "A", 1200.0, "K:", "Istanbul", "J", "T", float(p)) for h, p in (("10", 1), ("11", 2), ("12", 7))],
        "horse_id string, start timestamp, race_no int, race_id string, carried_weight double, race_class string, distance double, surface string, track string, jockey string, trainer string, finish_position double",
    )
    out = features.history_features(features.with_keys(targets), features.with_keys(hist)).first()
    assert out.last_3_avg_position == 1.5


def test_target_outcome_never_changes_features(spark):
    legacy = _legacy(spark, ("15.12.2025", "2", "B"))
    before = _frame(spark, legacy)
    with_result = features.asof_frame(
        program(spark, {}), spark.createDataFrame([result(race_start_at=at("2026-01-01T10:00"), finish_position=1.0)], schemas.RESULTS),
        spark.createDataFrame([], schemas.AGF), spark.createDataFrame([], schemas.ODDS), legacy,
    ).collect()[0]
    assert before == with_result


def test_lagged_rating_and_same_day_quarantine(spark):
    typed = spark.createDataFrame(
        [("h1", "a", "2026-01-01", 40.0), ("h1", "b", "2026-01-02", 47.0), ("h1", "c", "2026-01-02", 49.0), ("h2", "d", "2026-01-01", 30.0), ("h2", "e", "2026-01-02", 35.0)],
        "horse_id string, race_id string, day string, handicap_rating double",
    ).withColumn("day", F.to_date("day"))
    for c in ("track", "surface", "race_class", "jockey", "trainer"):
        typed = typed.withColumn(c, F.lit("x"))
    typed = typed.withColumns({"distance": F.lit(1.0), "carried_weight": F.lit(50.0), "finish_position": F.lit(1.0)})
    out = {r.race_id: r for r in features.dataset_features(typed, [F.col("day")]).collect()}
    assert [out[k].pre_race_handicap_rating for k in "abcde"] == [None, None, None, None, 30.0]
    assert [out[k].history_order_certified for k in "abcde"] == [True, False, False, True, True]


def test_field_completeness(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0), ("y", 3.0)], "race_id string, f double")
    out = {r.race_id: r for r in quality.field_completeness(df, ["race_id"], "f").collect()}
    assert out["x"].race_field_complete and not out["y"].race_field_complete
    assert (out["y"].found_starters, out["y"].expected_starters_min, out["y"].missing_starters_min) == (2, 3.0, 1.0)


def test_contract():
    schemas.check_contract(schemas.MODEL_FEATURES)
    for bad in ([*schemas.MODEL_FEATURES, "finish_position"], ["handicap_rating" if c == "pre_race_handicap_rating" else c for c in schemas.MODEL_FEATURES]):
        with pytest.raises(ValueError):
            schemas.check_contract(bad)


def _performance(spark, stake=1, official=None):
    probs = {"horse:1": (0.60, 0.20, 0.70, 0.65), "horse:2": (0.40, 0.80, 0.30, 0.35)}
    preds = [
        prediction(prediction_id=h, horse_id=h, logistic_probability=a, catboost_probability=b, xgboost_probability=c, ensemble_probability=e)
        for h, (a, b, c, e) in probs.items()
    ]
    results = spark.createDataFrame([result(finish_position=1.0, result_odds=3.40), result(horse_id="horse:2", finish_position=2.0, result_odds=2.0)], schemas.RESULTS)
    matched = spark.createDataFrame([("horse:1", official)] if official else [], "prediction_id string, official_odds double")
    ev = evaluated.evaluated(spark.createDataFrame(preds, schemas.PREDICTIONS), results, program(spark, {}, {"horse_id": "horse:2", "horse_name": "AT 2"}), matched)
    return ev, {r.model: r for r in pnl.model_summary(pnl.money(ev, stake)).collect()}


def test_performance_race(spark):
    ev, _ = _performance(spark)
    s = evaluated.summary(ev).first()
    assert (s.total_predictions, s.correct_predictions, s.accuracy_percent, s.roi_bets) == (4, 3, 75.0, 4)
    assert abs(s.net_profit - 6.2) < 1e-9 and abs(s.roi_percent - 155.0) < 1e-9
    assert ev.filter("model = 'Ensemble'").first().race_time == "18:30"


def test_stake_and_odds_precedence(spark):
    _, twenty = _performance(spark, 20)
    e = twenty["Ensemble"]
    assert abs(e.net_profit - 48) < 1e-9 and abs(e.total_return - 68) < 1e-9 and abs(e.roi_percent - 240) < 1e-9
    assert abs(twenty["CatBoost"].net_profit + 20) < 1e-9
    _, fifty = _performance(spark, 50)
    assert abs(fifty["Ensemble"].net_profit - 120) < 1e-9
    _, official = _performance(spark, 20, 4.80)
    assert abs(official["Ensemble"].total_return - 96) < 1e-9 and abs(official["Ensemble"].net_profit - 76) < 1e-9


def test_diagnostics(spark):
    def run(race, start, probs, agf):
        return [
            prediction(prediction_id=f"{race}{i}", race_id=race, horse_id=str(i), race_start_at=at(start), prediction_time=at("2026-01-01T08:00"),
                       logistic_probability=p, catboost_probability=p, xgboost_probability=p, ensemble_probability=p, agf_rank=r, agf_percent=50.0 - r)
            for i, (p, r) in enumerate(zip(probs, agf), 1)
        ]

    preds = run("a", "2026-01-01T10:00", (0.6, 0.3, 0.1), (2, 3, 1)) + run("b", "2026-01-01T11:00", (0.40, 0.35, 0.25), (1, 2, 3))
    progs = program(
        spark,
        *[dict(race_id="a", horse_id=str(i), horse_name=f"AT {i}", surface="Çim", race_class="Maiden", distance=1200.0) for i in (1, 2, 3)],
        *[dict(race_id="b", horse_id=str(i), horse_name=f"AT {i}", surface="Kum", race_class="Handikap 15", distance=1800.0, race_start_at=at("2026-01-01T11:00")) for i in (1, 2, 3)],
    )
    results = spark.createDataFrame(
        [result(race_id="a", horse_id=str(i), finish_position=f) for i, f in ((1, 2.0), (2, 3.0), (3, 1.0))]
        + [result(race_id="b", horse_id=str(i), finish_position=float(i)) for i in (1, 2, 3)], schemas.RESULTS,
    )
    frame = spark.createDataFrame(preds, schemas.PREDICTIONS)
    diag = diagnostics.diagnostics(frame, results, progs).filter("model = 'Ensemble'")
    s = diagnostics.summary(diag).first()
    assert (s.top1_accuracy, s.top2_accuracy, s.top3_accuracy) == (50.0, 50.0, 100.0)
    a = diag.filter("race_id = 'a'").first()
    assert a.winner_rank == 3 and abs(a.probability_difference - 0.5) < 1e-9 and a.agf_favorite == "AT 3" and a.agf_comparison == "market"
    assert (a.surface_group, a.race_type_group, a.distance_group) == ("turf", "maiden", "<=1200")
    assert rows(diagnostics.winner_rank_histogram(diag)) == [(1, 1), (3, 1)]
    detail = {r.race_id: r for r in diagnostics.race_detail(frame, results).filter("model = 'Ensemble'").collect()}
    assert detail["a"].confidence == "High Confidence Wrong"
    m = shadow.by_model(diag).first()
    assert m.evaluated_race_count == 2 and m.roi_bet_count == 0 and m.median_winner_rank == 2.0


def test_paging(spark):
    df = spark.range(104).withColumn("x", F.col("id"))
    from furlong.operators.sets import Page

    sizes = [Page.of(df, [F.col("id").desc()], p).rows.count() for p in (1, 2, 3)]
    assert sizes == [100, 4, 0] and Page.of(df, [F.col("id")]).total.first() == (104, 2)


def test_roi_needs_full_prices(spark):
    df = spark.createDataFrame([("r", "1", 1, None, 0.6), ("r", "2", 0, 2.0, 0.4)], "race_id string, horse_id string, winner int, pre_race_odds double, ensemble_probability double")
    assert roi.certification(df).first().status == "NOT CERTIFIED"
    assert {r.bets for r in roi.strategies(df).collect()} == {0}


def _monitoring(spark, shift):
    out = []
    for day, probs in (("2029-12-15", (0.55, 0.25, 0.15, 0.05)), ("2030-01-01", (0.95, 0.03, 0.01, 0.01) if shift else (0.55, 0.25, 0.15, 0.05))):
        for race in range(25):
            for i, p in enumerate(probs):
                out.append((day, f"{day}-{race}", str(i), "Ensemble", p, int(i == 0), float((2, 4, 8, 12)[i]), "new" if shift and day > "2030" else "old", "finished"))
    df = spark.createDataFrame(out, "race_date string, race_id string, horse_id string, model string, probability double, winner int, pre_race_odds double, race_class string, result_status string")
    return df.withColumn("race_date", F.to_date("race_date"))


def test_drift_alarm(spark):
    for shift, want in ((False, "PASS"), (True, "CRITICAL")):
        df = _monitoring(spark, shift)
        assert drift.prediction_report(df, "race_date").first().status == want
        report = drift.feature_report(df, "race_date", ["probability"], ["race_class"])
        assert drift.overall_status(report).first().status == want
    live = metrics.live_metrics(_monitoring(spark, False))
    assert {r.top1_accuracy for r in live.collect()} == {1.0}


def test_coverage_gate(spark):
    progs = program(spark, {"race_id": "r1", "race_start_at": at("2026-01-01T12:00")}, {"race_id": "r2", "track": "Paris", "race_start_at": at("2026-01-01T13:00")})
    empty = spark.createDataFrame([], "race_id string")
    lit = lambda s: F.lit(s).cast("timestamp")
    missed = lambda now, preds: [r.race_id for r in gates.missed_races(progs, preds, lit("2025-01-01"), lit(now)).collect()]
    assert missed("2026-01-01 11:56:00", empty) == ["r1"]
    assert missed("2026-01-01 11:54:00", empty) == []
    assert missed("2026-01-01 14:00:00", empty.unionByName(spark.createDataFrame([("r1",)], "race_id string"))) == []


def test_single_match(spark):
    preds = spark.createDataFrame([prediction()], schemas.PREDICTIONS)
    results = spark.createDataFrame([result(finish_position=1.0, result_odds=3.5)], schemas.RESULTS)
    none = spark.createDataFrame([], "prediction_id string")
    out = resolve.match_results(preds, results, none).collect()
    assert len(out) == 1 and out[0].winner == 1 and out[0].payout == 3.5
    assert resolve.match_results(preds, results, spark.createDataFrame([("p",)], "prediction_id string")).count() == 0


@pytest.mark.parametrize(
    ("now", "supported", "state"),
    [("13:59:59", True, "WAITING"), ("14:14:59", True, "PRE_WINDOW"), ("14:15:00", True, "CAPTURING"), ("14:29:00", True, "FINAL_CAPTURING"),
     ("14:31:00", True, "POST_START_RETRY"), ("14:32:01", True, "FAILED"), ("14:00:00", False, "SOURCE_UNSUPPORTED")],
)
def test_lifecycle(spark, now, supported, state):
    ts = lambda s: F.lit(f"2026-01-01 {s}").cast("timestamp")
    got = spark.range(1).select(lifecycle.state(ts(now), ts("14:30:00"), F.lit(False), F.lit(False), F.lit(supported))).first()[0]
    assert got == state


def test_refresh_due(spark):
    now = at("2026-01-01T12:00")
    lit_now = F.lit("2026-01-01 12:00:00").cast("timestamp")

    def due(*items):
        data = [(str(i), now + dt.timedelta(minutes=start), now - dt.timedelta(minutes=age) if age else None) for i, (start, age) in enumerate(items)]
        df = spark.createDataFrame(data, "race_id string, race_start_at timestamp, last_agf_at timestamp")
        return sorted(r.race_id for r in lifecycle.refresh_due(df, lit_now).collect())

    assert due((-1, 0), (5, 0), (30, 0)) == ["1"]
    assert due((120, 14), (45, 5), (20, 1)) == ["1"]
    assert due((4, 0), (8, 0)) == ["0"]


def test_names_and_tracks(spark):
    df = spark.createDataFrame([("YAĞIZATEŞ  Bey (8)", "Diyarbakır (3. Y.G.)", "Ä°stanbul")], "n string, t string, m string")
    got = df.select(text.horse_name("n"), text.track_key("t"), text.clean_name("n"), text.is_domestic_track("t"), text.track_key(F.lit("Veliefendi")), text.fold("m")).first()
    assert tuple(got) == ("YAĞIZATEŞ BEY", "DIYARBAKIR", "YAGIZATES BEY", True, "ISTANBUL", "ISTANBUL")


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(numbers.crowd_percent(F.lit("%35,5(2)"))) == 35.5 and one(numbers.crowd_rank(F.lit("%35,5(2)"))) == 2
    assert one(numbers.grid_number(F.lit("7 (%45,74)"))) == 7 and one(numbers.grid_percent(F.lit("7 (%45,74)"))) == 45.74
    assert one(numbers.grouped_number(F.lit("1.234,50 TL"))) == 1234.5 and one(numbers.leading_number(F.lit("-"))) is None


def test_similarity_is_indel():
    assert similarity.indel_ratio("AB", "AXB") == 80.0
    assert similarity.indel_ratio("KITTEN", "SITTING") == pytest.approx(200 * 4 / 13)
    assert similarity.indel_ratio("", "") == 100.0 and similarity.indel_ratio("A", "") == 0.0


def test_similar_pairs_are_complete(spark):
    """Against brute force over every pair."""
    import random

    rng = random.Random(5)
    names = {"".join(rng.choice("ABCD ") for _ in range(rng.randint(1, 12))).strip() or "A" for _ in range(160)}
    near = {n[:i] + rng.choice("ABCD") + n[i + 1:] for n in names for i in [rng.randrange(len(n))]}
    left, right = sorted(names), sorted(near)
    for cutoff, order in ((85.0, False), (90.0, True)):
        got = {
            (r.a, r.b) for r in resolve.similar_pairs(
                spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), [], "a", "b", cutoff, order
            ).collect()
        }
        sort = lambda s: " ".join(sorted(s.split(" ")))
        best = lambda x, y: max(similarity.indel_ratio(x, y), similarity.indel_ratio(sort(x), sort(y)) if order else 0)
        assert got == {(x, y) for x in left for y in right if best(x, y) >= cutoff}


def test_weighted_links_need_a_margin(spark):
    cols = "id long, name string, father_name string, mother_name string"
    left = spark.createDataFrame([(1, "KARA YILDIZ HAN", "ATA BEY", "ANA HANIM"), (2, "GUNES PARLAK", "X SIRE", "Y DAM"), (3, "TWIN STAR ONE", "S", "D")], cols)
    right = spark.createDataFrame(
        [(10, "KARA YILDIZ HAN", "ATA BEY", "ANA HANIM"), (20, "GUNES PARLAKK", "X SIRE", "Y DAM"), (30, "TWIN STAR ONEE", "S", "D"), (31, "TWIN STAR ONNE", "S", "D")], cols,
    )
    out = {r.left_id: (r.right_id, r.method) for r in resolve.weighted_links(left, right).collect()}
    assert out == {1: (10, "exact_name_parents"), 2: (20, "fuzzy_name_parents")}


def test_comparison_rows(spark):
    day = dt.date(2026, 1, 1)
    actual = spark.createDataFrame([(day, "Ankara", 1, "YAGIZATES", 1), (day, "Ankara", 1, "RUZGAR GULU", 2)], "race_date date, city string, race_no int, horse_name string, finish_position int")
    preds = spark.createDataFrame([(day, "Ankara", 1, "YAGIZATESS", 1, 0.6), (day, "Ankara", 1, "Ruzgar Gulu (4)", 2, 0.4)], "race_date date, city string, race_no int, horse_name string, predicted_rank int, probability double")
    out = coverage.comparisons(actual, preds)
    s = coverage.comparison_summary(out).first()
    assert (s.matched_preds, s.top1_correct, s.winner_name, s.winner_pred_rank) == (2, 1, "YAGIZATES", 1)
    assert {r.horse_name: r.match_score for r in out.collect()}["RUZGAR GULU"] == 1.0


def test_filters_reject_bad_values():
    for bad in (dict(date="01.01.2026"), dict(model="Nobody"), dict(outcome="maybe")):
        with pytest.raises(ValueError):
            filters.performance_filter(list(schemas.MODELS), **bad)
    for bad in (0, -1, 2_000_000, "x"):
        with pytest.raises(ValueError):
            filters.stake_value(bad)
    with pytest.raises(ValueError):
        filters.diagnostics_filter(date_from="2026-02-01", date_to="2026-01-01")
    with pytest.raises(ValueError):
        filters.in_country("track", "XX")


def test_unscored_horses_are_never_picked(spark):
    rows = [("p1", "r", 1, 0.6), ("p2", "r", 2, 0.3), ("p3", "r", 3, None), ("p4", "none", 4, None)]
    t = dt.datetime(2026, 1, 1, 12)
    preds = spark.createDataFrame(
        [(i, race, horse, t, t + dt.timedelta(hours=1), "v", 2.0, p) for i, race, horse, p in rows],
        "prediction_id string, race_id string, horse_id long, prediction_time timestamp, race_start_at timestamp, model_version string, odds double, p double",
    )
    out = evaluated.top_picks(preds, {"m": "p"}).collect()
    assert [(r.race_id, r.horse_id, r.probability) for r in out] == [("r", 1, 0.6)]
    scored = spark.createDataFrame([("r", 1, 0.6, 0, 2.0), ("r", 2, 0.3, 1, 9.0), ("r", 3, None, 0, 50.0)], "race_id string, horse_id long, p double, y int, odds double")
    got = metrics.market_accuracy(scored.withColumn("k", F.lit(1)), ["k"], "p", "y", "odds").first()
    assert got.favorite_accuracy == 0.0 and got.longshot_accuracy is None


def test_events_find_the_first_race_of_their_key(spark):
    events = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1), (4, "a", None)], "e long, g string, no int")
    races = spark.createDataFrame([(10, "a", 4), (11, "a", 5), (12, "a", 5)], "race long, g string, rn int")
    out = {r.e: (r.matched_race, r.same_number) for r in resolve.event_race_match(events, races, "e", ["g"], "no", "rn", "race").collect()}
    assert out == {1: (11, True), 2: (10, False), 3: (None, None), 4: (10, False)}


def test_track_and_category_texts(spark):
    df = spark.createDataFrame([("Ankara (3. Y.G.)",), ("Veliefendi (x) (3. Yarış Günü)",), ("(x)",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_track("t")).collect()] == ["Ankara", "İstanbul", "Bilinmiyor", "Bilinmiyor"]
    df = spark.createDataFrame([("Maiden, 58 KG, 3", "race_class"), ("Kum: Sulu", "surface"), ("Iğdır  / X", None), (None, None)], "v string, f string")
    assert [df.select(text.normalise_category("v", f)).collect()[i][0] for i, f in enumerate(["race_class", "surface", None, None])] == ["maiden", "k:", "iğdir/x", "__MISSING__"]
