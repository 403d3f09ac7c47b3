"""Boundary cases of column rules and operators."""

import json
import zipfile
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from bourseline.functions import market as M
from bourseline.functions import text as T
from bourseline.operators import asof, learning, mapping, matching, series, upsert
from bourseline.sources import files
from bourseline.streaming import feed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("time", "day"), [("15:29:59", 9), ("15:30:00", 9), ("15:30:00.000001", 10), ("15:30:01", 10), ("00:00:00", 9)])
def test_cutoff_is_strictly_after_the_close(spark, time, day):
    at = F.lit(f"2025-03-10 {time}").cast("timestamp_ntz")
    assert one(spark, M.prediction_cutoff(at)).day == day


@pytest.mark.parametrize(("rate", "want"), [(0.0075, "POSITIVE"), (-0.0075, "NEGATIVE"), (0.0074, "NEUTRAL"), (None, None)])
def test_direction(spark, rate, want):
    assert one(spark, M.direction(F.lit(rate).cast("double"))) == want


@pytest.mark.parametrize(("subject", "kind"), [("Dividend - Rs 5", "DIVIDEND"), ("Demerger", "MERGER"), ("Buy Back", "BUYBACK"), ("", "OTHER"), (None, "OTHER"), ("Board Meeting for Stock Split", "BOARD_MEETING")])
def test_action_type(spark, subject, kind):
    assert one(spark, M.action_type(F.lit(subject).cast("string"))) == kind


@pytest.mark.parametrize(("subject", "amount"), [("Dividend - Rs 5.50 Per Share", 5.5), ("DIVIDEND RE 1", 1.0), ("Dividend Rs. 5", None), ("none", None)])
def test_dividend_amount(spark, subject, amount):
    got = one(spark, M.dividend_amount(F.lit(subject)))
    assert (None if got is None else float(got)) == amount


@pytest.mark.parametrize(("isin", "good"), [("US0378331005", True), ("US0378331006", False), ("INE002A01018", True), ("INE002A0101", False)])
def test_isin_check_digit(spark, isin, good):
    assert one(spark, T.isin_valid(F.lit(isin))) is good


def test_text_rules(spark):
    assert one(spark, T.normalized_name(F.lit("A & B Ltd. - Ex-Date: 01/02"))) == "A B LTD"
    assert one(spark, T.without_legal_suffix(F.lit("ABC CO LTD"))) == "ABC"
    assert one(spark, T.scrip_code(F.lit("Name Ltd (505537)"))) == "505537"
    assert one(spark, T.title_company(F.lit("Name Ltd (505537)"))) == "Name Ltd"
    assert one(spark, T.safe_double(F.lit("-"))) is None
    assert one(spark, T.safe_long(F.lit("1,234.9"))) == 1234
    assert one(spark, T.url_class(F.lit("http://x.y/a.pdf?b=1"))) == "PDF"
    assert one(spark, T.parsed_date(F.lit("05-Mar-2025"))).month == 3
    assert one(spark, T.parsed_date(F.lit("-"))) is None
    assert one(spark, T.tokens(F.lit("THE DME DEVELOPMENT LIMITED DME"))) == ["DME", "DEVELOPMENT"]


def test_sequence_ratio(spark):
    pairs = [("ABC DEF", "ABC DXF"), ("A", None), ("", "")]
    got = [r["x"] for r in spark.createDataFrame(pairs, "a string, b string").select(T.sequence_ratio("a", "b").alias("x")).collect()]
    assert sorted(x for x in got if x is not None) == sorted([SequenceMatcher(None, *pairs[0]).ratio(), 1.0])


def plain_rsi(c, n=14):
    d = [b - a for a, b in zip(c, c[1:], strict=False)]
    if len(c) <= n:
        return None
    g, low = sum(max(x, 0) for x in d[:n]) / n, sum(max(-x, 0) for x in d[:n]) / n
    for x in d[n:]:
        g, low = (g * (n - 1) + max(x, 0)) / n, (low * (n - 1) + max(-x, 0)) / n
    return 100.0 if low == 0 else 100 - 100 / (1 + g / low)


def plain_macd(c):
    def ema(v, n):
        out = [v[0]]
        for x in v[1:]:
            out.append(2 / (n + 1) * x + (1 - 2 / (n + 1)) * out[-1])
        return out

    line = [a - b for a, b in zip(ema(c, 12), ema(c, 26), strict=True)]
    signal = ema(line, 9)[-1]
    return line[-1], signal, line[-1] - signal


def test_recursive_indicators(spark):
    c = [100 + ((i * 37) % 23) / 3 for i in range(60)]
    values = F.array(*map(F.lit, c))
    assert one(spark, series.rsi(values)) == pytest.approx(plain_rsi(c))
    assert tuple(one(spark, series.macd(values))) == pytest.approx(plain_macd(c))
    assert one(spark, series.rsi(F.array(*[F.lit(5.0)] * 20))) == 100.0
    assert one(spark, series.rsi(F.array(*[F.lit(5.0)] * 14))) is None
    assert one(spark, series.macd(F.array(*[F.lit(5.0)] * 34))) is None
    assert one(spark, series.drawdown(F.array(*map(F.lit, [1.0, 4.0, 1.0, 5.0])))) == -0.75


def test_as_of_and_counts(spark):
    day = lambda n: datetime(2025, 1, n).date()
    bars = spark.createDataFrame([(1, day(2), 10.0), (1, day(5), 20.0), (2, day(1), 7.0)], "security_id long, trade_date date, close double")
    events = spark.createDataFrame([(1, 1, day(1)), (2, 1, day(2)), (3, 1, day(4)), (4, 1, day(9)), (5, 3, day(9))], "id long, security_id long, at date")
    got = {r["id"]: r["close"] for r in asof.as_of(events, bars, "at", ["close"]).collect()}
    assert got == {1: None, 2: 10.0, 3: 10.0, 4: 20.0, 5: None}
    counts = {r["id"]: r["n_rows"] for r in asof.counted_between(events, bars, "at", 4).collect()}
    assert counts == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    base = asof.as_of(events, asof.numbered(bars), "at", ["session"]).filter("session IS NOT NULL").drop("base_date")
    assert {r["id"]: r["c1"] for r in asof.forward(base, asof.numbered(bars), (1,)).collect()} == {2: 20.0, 3: 20.0, 4: None}


def test_upserts(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id long, k string, v string")
    new = spark.createDataFrame([(1, None, "z"), (3, "y", "c"), (3, "y", "d")], "id long, k string, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(rows(upsert.insert_ignore(old, new, ["id", "k"], [F.col("v")])), key=key) == [(1, None, "a"), (2, "x", "b"), (3, "y", "c")]
    assert sorted((tuple(r) for r in upsert.newest_wins(old, new, ["id", "k"], [F.col("v")]).collect()), key=key) == [(1, None, "z"), (2, "x", "b"), (3, "y", "c")]
    assert upsert.replace_keys(old, new, ["id", "k"]).count() == 4
    assert sorted((tuple(r) for r in upsert.updated(old, new.filter("id = 1"), ["id", "k"], ["v"]).collect()), key=key) == [(1, None, "z"), (2, "x", "b")]
    with pytest.raises(ValueError):
        upsert.checked(old, filled=F.col("k").isNotNull())


def test_ambiguous_rule_is_not_rescued_by_a_later_one(spark):
    keys = spark.createDataFrame([("SYMBOL", "AB", 1), ("SYMBOL", "AB", 2), ("NAME", "ALPHA", 3)], "rule string, key string, security_id long")
    wanted = spark.createDataFrame([(1, "SYMBOL", "AB"), (1, "NAME", "ALPHA"), (2, "SYMBOL", None), (2, "NAME", "ALPHA"), (3, "NAME", "NONE")], "news_id long, rule string, key string")
    got = {r["news_id"]: (r["status"], r["security_id"]) for r in mapping.cascade(wanted, keys).collect()}
    assert got == {1: ("AMBIGUOUS", None), 2: ("MAPPED", 3), 3: ("PENDING", None)}


def test_similar_names(spark):
    left = spark.createDataFrame([(1, "NSE", "ALPHA BETA GAMMA"), (2, "BSE", "ALPHA BETA GAMMA")], "id long, exchange string, name string")
    right = spark.createDataFrame([(7, "NSE", "ALPHA BETA GAMA"), (8, "NSE", "ALPHA OMEGA")], "id long, exchange string, name string")
    assert [(r["event_id"], r["security_id"]) for r in mapping.similar_names(left, right).collect()] == [(1, 7)]


def test_metrics(spark):
    rows = spark.createDataFrame([("A", "A")] * 3 + [("A", "B")] + [("B", "B")] * 2, "label string, predicted string")
    got = learning.summary(learning.confusion(rows)).first()
    assert got["accuracy"] == pytest.approx(5 / 6)
    assert got["balanced_accuracy"] == pytest.approx(0.875)


def test_price_files(spark, tmp_path):
    head = ",".join(h for h, _, _ in files.PRICE_COLUMNS)
    row = "2025-01-02,2025-01-02,CM,NSE,STK,7,INE002A01018,ABC,EQ,1,2,0.5,1.5,1.5,-,1000,1e3,Alpha"
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text(f"{head}\n{row}\n{row.replace('STK', 'FUT')}\n")
    got = files.valid_prices(files.read_prices(spark, str(tmp_path / "csv"))).collect()
    assert len(got) == 1
    assert got[0]["previous_close"] is None
    assert got[0]["volume"] == 1000
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "b.zip", "w") as z:
        z.writestr("deep/er/x.csv", "no\n")
        z.writestr("x.csv", f"﻿{head}\n{row}\n")
    assert files.read_zipped_prices(spark, str(tmp_path / "zip")).count() == 1
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_prices(spark, str(tmp_path / "bad.csv"))


def test_json_and_ids(spark, tmp_path):
    (tmp_path / "ca.json").write_text('{"data": [{"symbol": "ABC", "exDate": "05-Mar-2025", "isin": "-", "subject": "Bonus"}]}')
    got = files.read_corporate_actions(spark, str(tmp_path / "ca.json")).first()
    assert (got["isin"], got["exDate"].day) == (None, 5)
    (tmp_path / "n.json").write_text('{"exchanges": {"NSE": {"equity": {"records": [{"title": "T", "published": "Mon, 06 Jan 2025 10:00:00 GMT"}]}}}}')
    got = files.read_news(spark, str(tmp_path / "n.json")).first()
    assert (got["external_id"], got["published_at"].hour) == ("T", 10)
    (tmp_path / "ids.txt").write_text("1\n# no\n2 # two\n")
    assert sorted(r["id"] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == [1, 2]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>u</link></item></channel></rss>")
    assert files.read_rss(spark, str(tmp_path / "feed.xml")).first()["title"] == "A"


def test_stream_keeps_first_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2025, 1, 1)), (1, datetime(2025, 1, 1)), (2, datetime(2025, 1, 1))], "id long, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = feed.first_arrivals(feed.read_feed(spark, str(tmp_path / "in"), "id long, at timestamp"), ["id"], "at")
    feed.run_available(stream, str(tmp_path / "check"), lambda df, _: seen.extend(r["id"] for r in df.collect())).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_models_are_stored_and_scored(spark, tmp_path):
    from bourseline.operators import learning

    rows = spark.range(300).selectExpr("id AS news_id", "CAST(id % 3 AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y", "element_at(array('NEGATIVE', 'NEUTRAL', 'POSITIVE'), CAST(id % 3 + 1 AS INT)) AS target")
    model = learning.fit(rows, ["x", "y"], "target", trees=5)
    path = f"file://{tmp_path}/model"
    learning.save_model(spark, model, ["x", "y"], {"accuracy": 1.0}, path)
    got = learning.score_stored(spark, path, rows.select("y", "news_id", "x", "target"))
    assert got.join(rows.select("news_id", "target"), "news_id").filter("direction = target").count() == 300
    assert learning.prediction_checks(got, ["news_id"]).first().asDict() == {"predictions": 300, "repeated_keys": 0, "bad_sums": 0, "no_direction": 0}
    assert spark.read.csv(f"{path}/importance", header=True).first()["feature"] == "x"
    with pytest.raises(ValueError, match="missing"):
        learning.score_stored(spark, path, rows.drop("x"))
    with pytest.raises(ValueError, match="leak"):
        learning.checked_features(["x", "return_5d"])
    with pytest.raises(ValueError, match="no features"):
        learning.wanted(rows, rows, "ids", spark.range(299, 302).selectExpr("id AS news_id"))
    words = learning.vocabulary(rows, "target")
    assert words == ["NEGATIVE", "NEUTRAL", "POSITIVE", learning.MISSING]
    with pytest.raises(Exception, match="unseen value"):
        learning.coded(rows.withColumn("target", F.lit("NEW")), "target", words, "code").collect()


def test_a_file_of_one_day(spark):
    from bourseline.plans.reports import single_day

    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-01",)], "d string")
    assert single_day(rows, "d").count() == 2
    for bad in (rows.unionByName(spark.createDataFrame([("2024-01-02",)], "d string")), rows.unionByName(spark.createDataFrame([(None,)], "d string")), rows.filter("false")):
        with pytest.raises(ValueError):
            single_day(bad, "d")


def test_price_files_are_read_by_their_headers(spark, tmp_path):
    heads = [h for h, _, _ in files.PRICE_COLUMNS]
    values = {"TradDt": "2024-01-02", "ISIN": "INE000000001", "TckrSymb": "ABC", "ClsPric": "1,234.5", "FinInstrmNm": 'Caf\u00e9, "Ltd"\nline'}
    turned = heads[::-1]
    cell = lambda v: '"' + v.replace('"', '""') + '"'
    line = ",".join(cell(values.get(h, "")) for h in turned)
    text = ",".join(turned) + "\n" + line + "\n"
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_bytes(text.encode("cp1252"))
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("x/y.csv", "no")
        z.writestr("z.csv", "\ufeff" + text)
    got = files.read_price_files(spark, f"file://{tmp_path}/in").collect()
    assert [(r["isin"], r["symbol"], r["close"], r["instrument_name"]) for r in got] == [("INE000000001", "ABC", 1234.5, values["FinInstrmNm"])] * 2
    assert files.newest_file(spark, f"file://{tmp_path}/in").endswith("a.csv")
    (folder / "c.csv").write_text("TradDt\n2024-01-02\n")
    with pytest.raises(Exception, match="columns are missing"):
        files.read_price_files(spark, f"file://{tmp_path}/in").collect()


def test_reports_and_trends_are_written_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([("02-01-2024", "7,000.5"), ("bad", "1"), ("01-01-2024", "6999")], "` DATE ` string, Close string")
    files.write_report(rows.coalesce(1), path)
    got = files.read_index_trend(spark, path).collect()
    assert [(str(r["trade_date"]), r["close"]) for r in got] == [("2024-01-01", 6999.0), ("2024-01-02", 7000.5)]
    with pytest.raises(ValueError):
        files.write_report(rows.select("Close"), f"{path}2")
        files.read_index_trend(spark, f"{path}2")
    files.write_json(rows, f"{path}3")
    assert spark.read.json(f"{path}3").count() == 3
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.overwrite_partitions(parts, f"{path}4", ["k"])
    files.overwrite_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), f"{path}4", ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{path}4").collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "att").mkdir()
    for name in ("x", "y"):
        (tmp_path / "att" / name).write_bytes(b"same")
    (tmp_path / "att" / "z").write_bytes(b"other")
    assert sorted(r["files"] for r in files.read_attachments(spark, f"file://{tmp_path}/att").collect()) == [1, 2]
    assert upsert.run_record(spark, "r1", {"built": 3, "failed": 0}, "SUCCESS").first().asDict() == {"run_id": "r1", "status": "SUCCESS", "built": 3, "failed": 0}


MASTER = "security_id long, isin string, symbol string, series string, name string, exchange string"


def test_get_or_create_changes_one_security_and_never_those_without_identity(spark):
    master = spark.createDataFrame([(1, "INE000000001", "A", "EQ", "one", "NSE"), (2, "INE000000001", "B", "EQ", "two", "NSE"), (3, None, None, None, "noid", "NSE"), (4, "", "C", None, "bare", "NSE"), (5, "INE000000005", "D", "EQ", "five", "NSE")], MASTER)
    seen = spark.createDataFrame([("INE000000001", "A", "EQ", "new"), (None, None, None, "ghost"), ("", " c ", "", "bare again"), (None, "D", "EQ", "other"), ("INE000000009", "Z", "EQ", "fresh"), ("INE000000009", "Z", "EQ", "fresh")], "isin string, symbol string, series string, name string")
    rows = matching.get_or_create(master, seen, ["name"]).collect()
    assert {r["security_id"]: r["name"] for r in rows if r["security_id"] <= 5} == {1: "new", 2: "two", 3: "noid", 4: "bare again", 5: "five"}
    assert sorted((r["name"], r["isin"]) for r in rows if r["security_id"] > 5) == [("fresh", "INE000000009"), ("other", None)]
    assert matching.get_or_create(master.filter("false"), seen.filter("false"), ["name"]).count() == 0


def test_only_real_isins_of_the_own_exchange_decide(spark):
    master = spark.createDataFrame([(1, "INF000000001", "A", "EQ", "fund", "NSE"), (2, "INE000000002", "B", "EQ", "share", "BSE"), (3, None, "C", "EQ", "c", "NSE")], MASTER)
    records = spark.createDataFrame([(1, "INF000000001", "C", ""), (2, "INE000000002", None, None), (3, "INF000000001", None, None)], "id long, isin string, symbol string, series string")
    assert {r["id"]: r["security_id"] for r in matching.actions_to_master(records, master).collect()} == {1: 3, 2: 2, 3: None}
    assert {r["id"]: (r["security_id"], r["status"]) for r in matching.news_to_master(records, master).collect()} == {1: (1, "MAPPED"), 2: (None, "PENDING"), 3: (1, "MAPPED")}
    assert matching.news_to_master(records, master, "BSE").filter("security_id = 2").count() == 1


def test_backward_returns_are_features():
    assert learning.checked_features(["backward_return_1d", "backward_return_5d"]) == ["backward_return_1d", "backward_return_5d"]
    for leak in ("forward_return_1d", "direction_3d", "has_1d_label", "news_id", "prediction_eligible"):
        with pytest.raises(ValueError):
            learning.checked_features(["x", leak])


def test_verification_compares_every_field(spark):
    master = spark.createDataFrame([(1, "INE1", "A", "Acme  Ltd", "ACME LTD", True), (2, "INE2", "B", None, None, True), (3, "INE3", "C", "Gone", None, False)], "security_id long, isin string, symbol string, instrument_name string, nse_name string, is_active boolean")
    asked = spark.createDataFrame([(1, " acme ltd "), (1, "ine1"), (2, "acme"), (3, "Gone"), (9, "x"), (1, None), (2, "")], "security_id long, query_text string")
    got = sorted((r["security_id"], r["query_text"] or "", r["verdict"], r["matched_field"], sum(f["state"] == "UNKNOWN" for f in r["fields"])) for r in matching.verified(asked, master).collect())
    assert got == sorted([(1, " acme ltd ", "MATCH", "MULTIPLE", 8), (1, "ine1", "MATCH", "ISIN", 8), (2, "acme", "REVIEW", None, 10), (3, "Gone", "NO_CANONICAL_MATCH", None, 12), (9, "x", "NO_CANONICAL_MATCH", None, 12), (1, "", "REVIEW", None, 12), (2, "", "REVIEW", None, 12)])


def test_json_objects_are_merged_whole(spark):
    rows = spark.createDataFrame([(1, '{"a":1,"b":{"c":null},"d":null}', '{"b":[1,"x"],"e":true}'), (2, None, '{"a":null}'), (3, "no json", "[1]"), (4, '{"a":"kept"}', "")], "id long, old string, new string")
    got = {r["id"]: json.loads(r["m"]) for r in rows.select("id", F.to_json(T.json_merged(F.col("old"), F.col("new"))).alias("m")).collect()}
    assert got == {1: {"a": 1, "b": [1, "x"], "d": None, "e": True}, 2: {"a": None}, 3: {}, 4: {"a": "kept"}}


def test_only_missing_days_are_asked_for(spark):
    covered = spark.sql("SELECT * FROM VALUES ('a', DATE'2025-01-03'), ('a', DATE'2025-01-03'), ('a', DATE'2025-01-04'), ('a', DATE'2025-01-20'), ('a', NULL), (NULL, DATE'2025-01-01'), ('z', DATE'2025-01-01') AS t(k, d)")
    keys = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    got = sorted((r["k"], r["window_start"].day, r["window_end"].day) for r in series.missing_windows(covered, keys, "k", "d", "2025-01-01", "2025-01-20").collect())
    assert got == [("a", 1, 2), ("a", 5, 11), ("a", 12, 18), ("a", 19, 19), ("b", 1, 7), ("b", 8, 14), ("b", 15, 20)]
    assert series.missing_windows(covered, keys.filter("false"), "k", "d", "2025-01-01", "2025-01-20").count() == 0


def test_stop_words_are_no_tokens(spark):
    assert one(spark, T.tokens(F.lit("ACME PUB PLC CORPORATION OF INDIA"))) == ["ACME"]
