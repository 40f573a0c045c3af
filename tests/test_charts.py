"""Charts over tiny frames, with points worked out by hand."""

import datetime as dt

import pytest

from gridlark.operators.chart import ChartRequest, bin_edges, chart, default_axis, kinds_for, split_kinds, ticks


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)


def points(c, *columns):
    return sorted(tuple(r[x] for x in columns) for r in c.points.collect())


def ask(df, **request):
    return chart(df, ChartRequest(order=["i"], **request))


def test_histogram_keeps_empty_bins_and_the_maximum(spark):
    c = ask(frame(spark, "v double", [(float(x),) for x in range(60)]), x="v")
    got = points(c, "x", "n")
    assert c.kind == "histogram" and len(got) == 30 and sum(n for _, n in got) == 60 and got[0][0] == pytest.approx(59 / 60)


def test_few_values_are_bars(spark):
    assert ask(frame(spark, "v int", [(1,), (2,), (2,)]), x="v").kind == "bar"


def test_labels_are_cut_and_merge(spark):
    c = ask(frame(spark, "t string", [("a" * 28 + "x",), ("a" * 28 + "y",), ("",), (None,)]), x="t")
    assert points(c, "label", "n") == [("a" * 28 + "…", 2)]


def test_counts_are_capped_in_order(spark):
    c = ask(frame(spark, "t string", [(f"k{j:02d}",) for j in range(30) for _ in range(1 + (j == 7))]), x="t")
    got = points(c, "n", "label")
    assert len(got) == 24 and got[-1] == (2, "k07") and ("k24" not in {x for _, x in got})


@pytest.mark.parametrize(("agg", "value"), [("sum", 16.0), ("mean", 4.0), ("median", 2.5), ("min", 1.0), ("max", 10.0), ("count", 4.0), ("odd", 4.0)])
def test_aggregates(spark, agg, value):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", float("nan")), ("a", float("inf")), (None, 3.0)]
    assert points(ask(frame(spark, "k string, v double", rows), x="k", y="v", agg=agg), "label", "y", "n") == [("a", value, 4)]


def test_axes_swap_and_labels_become_series(spark):
    rows = [(1.0, "a"), (2.0, "b")]
    assert points(ask(frame(spark, "v double, k string", rows), x="v", y="k"), "label", "y") == [("a", 1.0), ("b", 2.0)]


def test_line_is_sorted_and_strided(spark):
    c = ask(frame(spark, "x double, y double", [(float(-x), float(x)) for x in range(1000)]), x="x", y="y", kind="line")
    assert points(c, "x") == [(float(-999 + 2 * k),) for k in range(500)]


def test_text_dates_and_periods(spark):
    rows = [("2026-01-05",), ("2026-01-20",), ("2026-02-01",)]
    c = ask(frame(spark, "t string", rows), x="t", grain="month")
    jan = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000
    assert points(c, "x", "y")[0] == (jan, 2.0) and c.x_label == "t by month"
    assert ask(frame(spark, "t string", [*rows, ("soon",)]), x="t", grain="month").kind == "bar"


def test_buckets_beyond_200_values(spark):
    c = ask(frame(spark, "x double, k string", [(float(x), "ab"[x % 2]) for x in range(400)]), x="x", split="k", kind="line")
    got = points(c, "series", "x", "n")
    assert len({x for _, x, _ in got}) == 30 and sum(n for *_, n in got) == 400 and any("buckets" in n for n in c.notes)


def test_split_keeps_six_series_and_slots_count_all_rows(spark):
    rows = [(f"r{i % 3}", f"c{min(i % 9, 8)}") for i in range(90)]
    c = ask(frame(spark, "r string, c string", rows), x="r", split="c")
    assert len({s for (s,) in points(c, "series")}) == 6 and any("busiest" in n for n in c.notes)


def test_split_histogram_has_every_bin(spark):
    rows = [(float(x), "EU" if x < 40 else "US") for x in range(60)]
    got = points(ask(frame(spark, "v double, k string", rows), x="v", split="k"), "series", "x", "n")
    assert len(got) == 60 and sum(n for *_, n in got) == 60


def test_empty_reasons(spark):
    df = frame(spark, "a array<int>, v double", [([1], 1.0)])
    assert ask(frame(spark, "v double", [(None,)]), x="v", kind="histogram").empty == "v has no numbers."
    assert "no column" in ask(df, x="zz").empty and "nested" in ask(df, x="a").empty


def test_tables_of_kinds():
    assert kinds_for("category") == ["bar"] and kinds_for("number") == ["histogram", "bar"] and kinds_for("temporal", "number")[0] == "line"
    assert split_kinds("number", None) == ["histogram", "bar", "line"] and split_kinds("temporal", "y") == ["line", "scatter", "bar"]
    assert default_axis([("a", "str"), ("b", "i64")]) == "b" and default_axis([("l", "list[i64]"), ("a", "str")]) == "a"
    assert ticks(0, 1) == [0, 0.25, 0.5, 0.75, 1]


def test_notes_and_reasons(spark):
    said = lambda c, what: any(what in n for n in c.notes)
    of = lambda rows, schema, **r: chart(spark.createDataFrame(rows, schema), ChartRequest(**r))
    assert said(of([(f"o{i}",) for i in range(200)], "x string", x="x"), "200 distinct values")
    assert said(of([(1.0,), (None,), (3.0,), (None,)], "v double", x="v"), "2 rows skipped")
    assert said(of([("EU", 1.0), ("US", None), (None, 3.0)], "x string, v double", x="x", y="v"), "2 rows skipped")
    split = of([(f"r{i % 3}", None if i == 0 else f"c{i % 9}") for i in range(90)], "x string, g string", x="x", split="g")
    assert said(split, "g has 9 values; the 6 busiest") and said(split, "1 row skipped")
    days = of([(dt.date(2026, 1, 1) + dt.timedelta(i), 1, "EU" if i % 2 else "US") for i in range(40)], "x date, n bigint, g string", x="x", y="n", split="g", kind="bar")
    assert said(days, "the first 24 are drawn") and days.points.select("x").distinct().count() == 24
    few = of([(f"s{i}", f"g{i}") for i in range(6) for _ in range(10)] + [(f"s{i}", f"rare{i}") for i in range(6, 30)], "x string, g string", x="x", split="g")
    assert few.points.select("label").distinct().count() == 6 and not said(few, "slots")
    assert of([("EU", 1.0, None), ("US", 2.0, "")], "x string, v double, g string", x="x", y="v", split="g").empty == "g has no value to draw."
    assert of([("a", None, "x"), ("b", None, "y")], "x string, v double, g string", x="x", y="v", split="g").empty == "v has no value to draw."
    assert of([("a", None), (None, "y")], "x string, g string", x="x", split="g").empty == "No row has a value in all of x, g."


def test_families_of_text(spark):
    kind = lambda rows, **r: chart(spark.createDataFrame([(v,) for v in rows], "x string"), ChartRequest(x="x", **r)).kind
    assert kind([str(i) for i in range(40)], untyped=True) == "histogram" and kind([str(i) for i in range(40)]) == "bar"
    assert kind([*[str(i) for i in range(40)], "n/a"], untyped=True) == "histogram" and kind(["EU", "US", "1"], untyped=True) == "bar"
    # a day that its month does not have makes the column text
    assert kind(["2026-02-28", "2026-02-27"], grain="month") == "line" and kind(["2026-02-28", "2026-02-30"], grain="month") == "bar"


def test_ties_and_edges(spark):
    c = chart(spark.createDataFrame([(v,) for v in "BbAaé"], "x string"), ChartRequest(x="x"))
    assert [r.label for r in c.points.collect()] == ["a", "A", "b", "B", "é"]
    day = 86_400_000.0
    assert bin_edges("date", 0, 30 * day)[:2] == ["1970-01-01", "1970-01-02"] and bin_edges("date", 0, 15 * day)[1] == "1970-01-01 12:00:00" and len(bin_edges("f64", 0, 30)) == 31
