"""Numbers of the golden cases in FIXTURES.md."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexicon, query as qy, text as tx
from lodestone.operators import bookings as bk, content as ct, indexing, lookups, pricing, search as se
from lodestone.params import ReportParams
from lodestone.sources import io
from lodestone.streaming import ingest

T = dt.datetime.fromisoformat
MAY = ReportParams("2026-05-01", "2026-05-31")
BOOKING = "id long, resource_id long, user_id long, start_at timestamp_ntz, end_at timestamp_ntz, status string, amount decimal(12,2), refund_amount decimal(12,2), created_at timestamp_ntz, deleted_at timestamp_ntz"
RESOURCE = "id long, name string, capacity long, status string, payment_type string, deleted_at timestamp_ntz"


def bookings(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(i, 1, 1, T(s), T(e), st, Decimal(a), None if r is None else Decimal(r), T(c), d and T(d)) for i, (s, e, st, a, r, c, d) in enumerate(rows)], BOOKING)


def test_booking_trend(spark):
    day = lambda d, st, a: (f"2026-05-{d} 10:00:00", f"2026-05-{d} 11:00:00", st, a, None, f"2026-05-{d} 09:00:00", None)
    rows = bookings(spark, [day("01", "confirmed", 100), day("01", "completed", 200), day("01", "cancelled", 500), day("02", "confirmed", 150)])
    assert sorted(map(tuple, bk.trend(rows, MAY).collect())) == [("2026-05-01", 2, 300.0, 150.0), ("2026-05-02", 1, 150.0, 150.0)]
    assert bk.trend(rows.limit(0), MAY).collect() == []


def test_overview_and_soft_delete(spark):
    row = lambda st, a, r, d=None: ("2026-05-01 10:00:00", "2026-05-01 11:00:00", st, a, r, "2026-05-01 09:00:00", d)
    rows = bookings(spark, [row("completed", 100, None), row("cancelled", 50, 20), row("no_show", 80, None), row("completed", 999, None, "2026-05-02 00:00:00")])
    kinds = spark.createDataFrame([(1, "a", 1, "active", "paid", None), (2, "b", 1, "active", "free", None), (3, "c", 1, "inactive", "paid", None)], RESOURCE)
    out = bk.overview(rows, kinds, MAY).first()
    assert (out["total"], out["revenue"], out["refunded"], out["avg_amount"], out["cancelled_rate"], out["resources"], out["active"], out["paid"], out["free"]) == (3, 230.0, 20.0, 76.67, 33.33, 3, 2, 2, 1)


def test_occupancy(spark):
    rows = bookings(spark, [("2026-05-01 08:00:00", "2026-05-01 10:00:00", "completed", 200, None, "2026-05-01 07:00:00", None), ("2026-05-01 11:00:00", "2026-05-01 12:00:00", "cancelled", 100, None, "2026-05-01 07:00:00", None)])
    kinds = spark.createDataFrame([(1, "a", 1, "active", "paid", None)], RESOURCE)
    windows = spark.createDataFrame([(1, 5, 8, 18, 60, True)], "resource_id long, day_of_week int, start_hour int, end_hour int, slot_minutes int, is_active boolean")
    one = ReportParams("2026-05-01", "2026-05-01")
    out = bk.resource_performance(kinds, rows, windows, one).first()
    assert (out["bookings"], out["available_hours"], out["booked_hours"], out["occupancy_rate"], out["avg_minutes"], out["revenue"]) == (2, 10.0, 2.0, 20.0, 120.0, 200.0)
    out = bk.resource_performance(kinds, rows, windows.limit(0), one).first()
    assert (out["occupancy_rate"], out["available_hours"]) == (0.0, 0.0)
    assert bk.slots(windows, kinds, rows, "2026-05-01", "2026-05-01 07:00:00").count() == 10


def test_trend_label_and_suggestion_score(spark):
    cases = [((100, 50), "rising"), ((5, 100), "falling"), ((7, 50), "stable"), ((10, 0), "rising"), ((0, 0), "stable"), ((-1, -1), "stable")]
    df = spark.createDataFrame([c for c, _ in cases], "d long, w long").withColumn("t", se.trend_label(F.col("d"), F.col("w")))
    assert [r["t"] for r in df.collect()] == [t for _, t in cases]
    df = spark.createDataFrame([(0, 0, None), (9, 0, 60)], "s long, c long, d long")
    decay, signed = ([r[0] for r in df.select(se.suggestion_score(F.col("s"), F.col("c"), F.col("d"), mode)).collect()] for mode in ("decay", "signed"))
    assert decay == [0.0, 1.0] and signed == [0.0, 4.0]


def test_text(spark):
    df = spark.createDataFrame([("  أَحمد  IPHONE ١٥ ",)], "t string")
    assert df.select(tx.normalize(F.col("t"))).first()[0] == "احمد iphone 15"
    assert qy.split_negation("phones without samsung 2020") == (["phones"], ["samsung", "2020"])
    assert qy.split_negation("not 2020 phone") == (["phone"], ["2020"])
    assert len(tx.FOLD_FROM) == len(tx.FOLD_TO)
    for raw, folded in (("ٲٳٵ یېۍﻯ ۇۋ کڪګ ھہ \u061c۵", "ااا يييي وو ككك هه 5"), ("كِتَاب\u200dٌ  ــ", "كتاب")):
        assert spark.createDataFrame([(raw,)], "t string").select(tx.normalize(F.col("t"))).first()[0] == folded == tx.normal(raw)
    assert re.fullmatch(tx.loose_regex("ايفون"), "آيفُون")
    for text in ("iphone case", "laptop bag"):
        typed = "".join(lexicon.KEYS.get(c, c) for c in text if len(lexicon.KEYS.get(c, c)) == 1)
        assert qy.fix_layout(typed).fixed == "".join(c for c in text if len(lexicon.KEYS.get(c, c)) == 1)


def test_prices(spark):
    offers = spark.createDataFrame([(1, 1, "percentage", 10, False), (1, 2, "fixed_amount", 30, False), (1, 3, "percentage", 150, True)], "entry_id long, offer_id long, kind string, value int, is_code boolean")
    entries = spark.createDataFrame([(1, 100)], "entry_id long, price int")
    out = {r["offer_id"]: (float(r["final_price"]), r["is_applied"]) for r in pricing.compute_prices(offers, entries).collect()}
    assert out == {1: (90.0, False), 2: (70.0, True), 3: (0.0, False)}


def test_streams(spark, tmp_path):
    rows = [('{"event_id": "a", "event_type": "login", "occurred_at": "2024-01-01T00:00:00"}',), ('{"event_id": "a", "event_type": "login", "occurred_at": "2024-01-01T00:00:00"}',), ('{"event_id": "b", "event_type": "audit.x", "occurred_at": "2024-01-01T01:00:00"}',), ("not json",)]
    spark.createDataFrame(rows, "value string").write.text(str(tmp_path / "in"))
    good, bad = ingest.decode(spark.readStream.schema("value string").text(str(tmp_path / "in")))
    ingest.write_both(good, str(tmp_path / "logs"), str(tmp_path / "audit"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert [spark.read.parquet(str(tmp_path / p)).count() for p in ("logs", "audit")] == [1, 1]
    assert ingest.decode(spark.createDataFrame(rows, "value string"))[1].count() == 1


def test_cancellations(spark):
    row = lambda st, a, r: ("2026-05-01 10:00:00", "2026-05-01 11:00:00", st, a, r, "2026-05-01 09:00:00", None)
    rows = bookings(spark, [row("cancelled", 100, 40), row("no_show", 80, None), row("completed", 70, None)])
    out = bk.cancellations(rows, MAY).first()
    assert (out["cancellations"], out["amount"], out["refunded"], out["avg_refund"], out["cancellation_rate"], out["refund_rate"], out["no_shows"], out["lost"], out["no_show_rate"]) == (1, 100.0, 40.0, 40.0, 33.33, 40.0, 1, 80.0, 33.33)
    kinds = spark.createDataFrame([(1, "a", "room")], "id long, name string, type string")
    assert [tuple(r) for r in bk.cancellations_by_resource(rows, kinds, MAY).collect()] == [(1, 1, 40.0, "a", "room")]
    assert [tuple(r) for r in bk.cancellation_trend(rows, MAY).collect()] == [("2026-05-01", 1, 40.0)]


def test_peaks_and_lead_time(spark):
    rows = bookings(spark, [("2026-05-01 14:00:00", "2026-05-01 15:00:00", "confirmed", 150, None, "2026-05-01 09:00:00", None), ("2026-05-01 15:00:00", "2026-05-01 16:00:00", "confirmed", 100, None, "2026-05-01 14:00:00", None)])
    assert [tuple(r) for r in bk.peak(rows, MAY, "dow").collect()] == [(5, "Friday", 2, 250.0)]
    assert sorted(tuple(r) for r in bk.peak(rows, MAY, "hour").collect()) == [(14, "14:00", 1, 150.0), (15, "15:00", 1, 100.0)]
    assert bk.lead_time(rows, spark.createDataFrame([(1, "a")], "id long, name string"), MAY).first()["lead_hours"] == 3.0


def test_slots_conflicts_and_refunds(spark):
    day = "2026-05-01"
    at = lambda h: f"{day} {h}:00"
    rows = bookings(spark, [(at("08:00"), at("10:00"), "confirmed", 1, None, at("07:00"), None), (at("08:00"), at("09:00"), "completed", 1, None, at("07:00"), None), (at("09:30"), at("10:00"), "pending", 1, None, at("07:00"), None), (at("09:00"), "2026-05-03 09:00:00", "no_show", 1, None, at("07:00"), None), (at("08:00"), at("12:00"), "cancelled", 1, None, at("07:00"), None)])
    kinds = spark.createDataFrame([(1, "a", 1, "active", "paid", None)], RESOURCE)
    windows = spark.createDataFrame([(1, 5, 8, 10, 60, True)], "resource_id long, day_of_week int, start_hour int, end_hour int, slot_minutes int, is_active boolean")
    # Only confirmed and pending bookings that start with the slot count.
    assert [(r["booked"], r["available"]) for r in bk.slots(windows, kinds, rows, day, at("07:00")).orderBy("slot_start").collect()] == [(1, False), (0, True)]
    asked = spark.createDataFrame([(100, 1, T(at("09:15")), T("2026-05-02 08:00:00")), (101, 1, T("2026-05-02 23:00:00"), T("2026-05-04 01:00:00")), (102, 1, T("2026-05-03 09:00:00"), T("2026-05-03 10:00:00"))], "id long, resource_id long, start_at timestamp_ntz, end_at timestamp_ntz")
    assert {r["id"]: (r["overlaps"], r["conflict"]) for r in bk.conflicts(asked, rows, kinds).collect()} == {100: (3, True), 101: (1, True), 102: (0, False)}
    tiers = spark.createDataFrame([(1, 24, 100), (1, 2, 50), (1, 0, 10)], "resource_id long, hours_before int, refund_percentage int")
    later = bookings(spark, [("2026-05-02 09:00:00", "2026-05-02 10:00:00", "confirmed", 80, None, at("07:00"), None), (at("10:59"), at("12:00"), "confirmed", 80, None, at("07:00"), None), (at("09:30"), at("12:00"), "confirmed", 80, None, at("07:00"), None), (at("09:00"), at("12:00"), "confirmed", 80, None, at("07:00"), None)])
    assert {r["id"]: r["refund"] for r in bk.refunds(later, tiers, at("09:00")).collect()} == {0: 80.0, 1: 8.0, 2: 8.0, 3: 0.0}


def test_content_summary(spark):
    from decimal import Decimal

    rows = [(s, Decimal("4.50"), n, None, "news") for s, n in (("published", 2), ("draft", 0), ("scheduled", 0), ("archived", 0))]
    entries = spark.createDataFrame(rows, "status string, ratings_avg decimal(3,2), ratings_count long, deleted_at timestamp_ntz, data_type string")
    out = ct.content_summary(spark.createDataFrame([("news",), ("none",)], "data_type string"), entries).orderBy("data_type").collect()
    assert [(r["total"], r["published"], r["publish_rate"], r["avg_rating"], r["ratings"]) for r in out] == [(4, 1, 25.0, 4.5, 2), (0, 0, 0.0, 0.0, 0)]


def test_closure_walks_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 0), (50, 51)], "parent long, child long")
    out = ct.closure(edges)
    assert out.count() == 31 * 30 + 1 and out.agg(F.max("distance")).first()[0] == 30
    assert sorted(r["id"] for r in ct.descendants(edges, spark.createDataFrame([(50,)], "id long")).collect()) == [50, 51]


def test_eav_writes(spark):
    fields = spark.createDataFrame([(1, "title")], "id long, name string")
    write = lambda rows: ct.written(spark.createDataFrame(rows, "entry_id long, field string, language string, values array<string>"), fields)
    old = spark.createDataFrame([(1, "title", "en", "a"), (1, "title", "fr", "b"), (2, "title", "en", "c")], "entry_id long, field string, language string, value string")
    after = lambda rows: sorted((tuple(r) for r in ct.replaced(old, write(rows)).select("entry_id", "field", "language", "value").collect()), key=str)
    assert after([(1, "title", "en", ["x", "y"])]) == [(1, "title", "en", "x"), (1, "title", "en", "y"), (1, "title", "fr", "b"), (2, "title", "en", "c")]
    assert after([(1, "title", "default", ["x"])]) == [(1, "title", None, "x"), (2, "title", "en", "c")]
    with pytest.raises(Exception, match="Unknown field body"):
        write([(1, "body", "en", ["x"])]).collect()


def test_index_text():
    assert indexing.flat('{"tags": ["a", 1, {"b": [true, null, ["deep", ["lost"]]]}]}') == "a 1 1 deep"
    assert indexing.flat("plain") == "plain" and indexing.flat("12") == "12" and indexing.flat(None) == ""
    assert indexing.build_text("آيفون 15", "", '{"tags": "سعر"}') == "ايفون 15 سعر iphone price"
    assert indexing.build_text("", None, None) == ""


def test_typos_against_all_pairs(spark):
    r = random.Random(2)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 11))) for _ in range(150)})
    words = sorted({"".join(w) for w in ([r.choice("abc") if r.random() < 0.2 else c for c in t] + (["a"] if r.random() < 0.3 else []) for t in terms)})
    got = {x["word"]: (x["term"], x["distance"]) for x in tx.typo_candidates(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    for w in words:
        most = 1 if len(w) <= 5 else 2 if len(w) <= 8 else 3
        near = [(d, t) for t in terms if (d := qy.distance(w, t)) <= most and 1 - d / max(len(w), len(t)) >= 0.6]
        assert got.get(w) == ((min(near)[1], min(near)[0]) if near else None)


def test_lookups(spark):
    rules = spark.createDataFrame([(1, None, "a", True), (2, 5, "a", True), (3, 5, "a", False)], "id long, project_id long, event_key string, is_active boolean")
    assert [r["id"] for r in lookups.active_rules(rules, "a").collect()] == [1] and [r["id"] for r in lookups.active_rules(rules, "a", 5).collect()] == [2]


def test_search_mends_queries(spark):
    text = [(1, "cheap iphone case"), (2, "samsung galaxy phone"), (3, "apple phone charger")]
    rows = [(i, i, 1, "en", "published", 1, "products", t, t, t, T("2024-01-01"), 0, 0, 0.0, 0.0, 0.0) for i, t in text]
    index = spark.createDataFrame(rows, "id long, entry_id long, project_id long, language string, status string, data_type_id long, data_type_slug string, title string, content string, search_text string, published_at timestamp_ntz, clicks long, views long, popularity double, ctr double, freshness double")
    postings = se.postings(index, "search_text")
    ask = lambda k: (lambda f: (f.mended, f.total, sorted(r["id"] for r in f.items.collect())))(se.answer(index, postings, se.Search(k, 1)))
    assert ask("iphoen") == ("typo", 2, [1, 3])  # "apple phone" is a phrase among its synonyms
    assert ask("هحاخىث") == ("layout", 2, [1, 3])
    assert ask("phone not samsung") == (None, 1, [3])
    assert ask("without samsung") == (None, 0, [])
    assert ask("zzqq") == (None, 0, [])


def test_stored_postings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red ring"), (2, "red widget red"), (3, "bolt")], "id long, content string")
    made = se.postings(rows)
    se.store_postings(made, str(tmp_path / "p"), 4)
    read = lambda words=None: sorted(map(tuple, se.stored_postings(spark, str(tmp_path / "p"), words, 4).select("token", "id", "tf").collect()))
    assert read() == sorted(map(tuple, made.collect())) and read(["red", "no"]) == [("red", 1, 1), ("red", 2, 2)] == sorted(map(tuple, se.postings(rows, only=["red"]).collect()))
    assert [r for r in read(["re*"]) if r[0] == "red"] == read(["red"])
    plan = se.stored_postings(spark, str(tmp_path / "p"), ["bolt"], 4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_extension_points(spark, monkeypatch):
    monkeypatch.setattr(ct, "PREDICATES", dict(ct.PREDICATES))
    monkeypatch.setattr(pricing, "DISCOUNTS", dict(pricing.DISCOUNTS))
    ct.register_predicate("starts", lambda v, x: v.startswith(x))
    pricing.register_discount("half", lambda price, _: price / 2)
    values = spark.createDataFrame([(1, "name", "abc"), (2, "name", "xbc")], "entry_id long, field string, value string")
    assert [r[0] for r in ct.matching(values, "name", "starts", "a").collect()] == [1]
    row = spark.createDataFrame([(10, "half", 0)], "price int, kind string, value int")
    assert float(row.select(pricing.discounted(F.col("price"), F.col("kind"), F.col("value"))).first()[0]) == 5.0


def test_tables_and_queues(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "project_id int, name string")
    io.append(rows((1, "a"), (2, "b")), root, "t", ["project_id"])
    io.append(rows((1, "c")), root, "t", ["project_id"])
    io.overwrite(rows((2, "d")), root, "t", ["project_id"])
    read = lambda: sorted((r["project_id"], r["name"]) for r in io.read_table(spark, root, "t").collect())
    assert read() == [(1, "a"), (1, "c"), (2, "d")]
    assert io.read_table(spark, root, "t", "name string, other long").where("other is null").count() == 3
    io.send(ingest.published(rows((1, "x")), "cms.project.created", "cms", "now"), root + "/q")
    seen = []
    ingest.micro_batch(io.queue(spark, root + "/q", 1), lambda b: seen.extend(r["routing_key"] for r in b.collect()), root + "/c").awaitTermination(120)
    assert seen == ["cms.project.created"]


def test_jobs_and_breaker():
    at = dt.datetime(2024, 1, 2, 1, 30)
    assert ingest.due({}, at) == list(ingest.JOBS)
    last = dict.fromkeys(ingest.JOBS, dt.datetime(2024, 1, 2, 1, 0))
    assert ingest.due(last, at) == ["renew_subscriptions"]
    assert "reindex" in ingest.due(last, at.replace(hour=2)) and "update_signals" in ingest.due(last, at.replace(hour=2))
    b = ingest.Breaker()
    assert [b.report("failure", i) for i in range(5)] == [True] * 4 + [False]
    assert not b.report("attempt", 200) and b.report("attempt", 305) and b.state == "half-open"
    assert not b.report("failure", 306) and b.retry_at == 606 and b.report("success", 700) and b.failures == 0


def test_queues(spark, tmp_path):
    sent = ingest.published(spark.createDataFrame([(7, "x")], "user_id long, note string"), "ecommerce.order.paid", "shop", "2024-01-01T00:00:00Z")
    rows = sent.unionByName(spark.createDataFrame([("other.key", '{"user_id": 1}'), ("cms.project.created", "{broken")], "routing_key string, value string"))
    handled, unknown, corrupt = ingest.notifications(rows)
    assert [(r["user_id"], r["kind"], r["service"]) for r in handled.collect()] == [(7, "ecommerce.order.paid", "ecommerce")]
    assert unknown.count() == 1 and [r["known"] for r in corrupt.collect()] == [True]
    seen = []
    rows.write.json(str(tmp_path / "q"))
    stream = spark.readStream.schema("routing_key string, value string").json(str(tmp_path / "q"))
    ingest.micro_batch(ingest.notifications(stream)[0], lambda b: seen.extend(r["user_id"] for r in b.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert seen == [7]


def test_keyed_streams(spark, tmp_path):
    stamp = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, 2, stamp(i)) for i in range(4)], "user_id long, amount long, ts timestamp").write.parquet(str(tmp_path / "u"))
    use = spark.readStream.schema("user_id long, amount long, ts timestamp").parquet(str(tmp_path / "u"))
    ingest.metered(use, 5, 120).writeStream.format("memory").queryName("used").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    # Reset after two minutes.
    assert sorted((r["used"], r["allowed"]) for r in spark.table("used").collect()) == [(2, True), (2, True), (4, True), (4, True)]
    events = [("s", stamp(i), "failure", i) for i in range(6)] + [("s", stamp(12), "attempt", 9), ("s", stamp(13), "success", 10)]
    df = spark.createDataFrame(events, "service string, ts timestamp, kind string, id long")
    want = ["closed"] * 4 + ["open"] * 2 + ["half-open", "closed"]
    assert [r["state"] for r in ingest.breakers(df).orderBy("id").collect()] == want
    df.drop("id").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("service string, ts timestamp, kind string").parquet(str(tmp_path / "e"))
    ingest.breaker_stream(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["state"] for r in spark.table("states").orderBy("ts").collect()] == want
