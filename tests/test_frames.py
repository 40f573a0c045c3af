"""Names, order and rows of frame verbs."""

import random

import pytest
from pyspark.sql import functions as F

from gridlark.errors import TooManyValues, UnknownColumn
from gridlark.functions import expr as e
from gridlark.functions import selectors as cs
from gridlark.plans import frame as frames
from gridlark.plans import order
from gridlark.plans.frame import Frame, concat, micros
from gridlark.plans.order import Ordered
from gridlark.plans.sql import SQLContext, run_sql, sql_on


@pytest.fixture(scope="module")
def abc(spark):
    return Frame(spark.createDataFrame([(1, 10, 100), (2, None, 200), (3, 30, 300), (4, None, None), (5, 50, 500)], "a long, b long, c long"), ("a",))


CASES = [
    (lambda f: f.select("b", "a", d=e.col("c")), ["b", "a", "d"]), (lambda f: f.with_columns(e.col("b") + 1, n=e.lit(1)), ["a", "b", "c", "n"]), (lambda f: f.drop("b", "zz"), ["a", "c"]),
    (lambda f: f.rename({"a": "x", "q": "y"}), ["x", "b", "c"]), (lambda f: f.with_row_index(), ["index", "a", "b", "c"]), (lambda f: f.unpivot(["b"], ["a"]), ["a", "variable", "value"]),
    (lambda f: f.melt("a", ["b", "c"], "k", "v"), ["a", "k", "v"]), (lambda f: f[["c", "a"]], ["c", "a"]), (lambda f: f.group_by("a").agg(e.col("b").sum(), e.col("a").max(), z=e.len_()), ["a", "b", "z"]),
    (lambda f: f.agg(e.col("b").mean(), e.len_()), ["b", "len"]), (lambda f: f.select(e.all_().name.suffix("_x")), ["a_x", "b_x", "c_x"]), (lambda f: f.select(e.exclude("a")), ["b", "c"]),
    (lambda f: f.select(e.col("^[ab]$")), ["a", "b"]), (lambda f: f.select(e.col("b") * e.col("a"), e.lit(3)), ["b", "literal"]), (lambda f: f.select(e.when(e.col("a") > 1).then(e.col("c")).otherwise(0)), ["c"]),
    (lambda f: f.join(f, on="a"), ["a", "b", "c", "b_right", "c_right"]), (lambda f: f.merge(f, on="a"), ["a", "b", "c", "b_y", "c_y"]), (lambda f: f.join(f, on="a", how="semi"), ["a", "b", "c"]),
    (lambda f: f.join(f, left_on="a", right_on="b"), ["a", "b", "c", "a_right", "b_right", "c_right"]), (lambda f: f.select((cs.all_() - cs.by_name("b")) | cs.starts_with("zz")), ["a", "c"]),
    (lambda f: f.lazy().collect().clone(), ["a", "b", "c"]), (lambda f: concat([f, f]), ["a", "b", "c"]), (lambda f: f.select(~cs.contains("a")), ["b", "c"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_names(abc, case):
    verb, names = CASES[case]
    assert verb(abc).columns == names


def values(f, name):
    return [r[name] for r in f.df.collect()]


def test_filter_and_remove(abc):
    assert sorted(values(abc.filter(e.col("b") > 10), "a")) == [3, 5]
    assert sorted(values(abc.remove(e.col("b") > 10), "a")) == [1, 2, 4]
    assert values(abc.filter(a=2), "c") == [200]
    with pytest.raises(UnknownColumn, match="did you mean"):
        abc.filter(aa=1)


def test_order_verbs(abc):
    assert values(abc.sort("b", descending=True), "a") == [5, 3, 1, 2, 4]
    assert values(abc.reverse(), "a") == [5, 4, 3, 2, 1]
    assert values(abc.ffill("b").sort("a"), "b") == [10, 10, 30, 30, 50]
    assert values(abc.bfill("b").sort("a"), "b") == [10, 30, 30, 50, 50]
    assert values(abc.interpolate("b").sort("a"), "b") == [10, 20, 30, 40, 50]
    assert sorted(values(abc.slice(-2), "a")) == [4, 5] and sorted(values(abc.gather([0, 2]), "a")) == [1, 3]
    assert values(abc.top_k(2, by="b"), "a") == [5, 3] and values(abc.bottom_k(2, by="b"), "a") == [1, 3]
    with pytest.raises(ValueError, match="order"):
        Frame(abc.df).head()


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_running_operations_agree_for_any_blocks(spark, rows):
    df = spark.createDataFrame([(i, float(i % 5) if i % 3 else None) for i in range(40)], "k long, v double")
    vals = [float(i % 5) if i % 3 else None for i in range(40)]
    total, want = 0.0, []
    for v in vals:
        total += v or 0
        want.append(total if v is not None else None)
    order = lambda d, c: [r[c] for r in d.orderBy("k").collect()]
    ordered = lambda: Ordered(df, ["k"], rows=rows)
    assert order(ordered().cumulative("v", "sum", "s"), "s") == want
    assert order(ordered().row_index("i"), "i") == list(range(40))
    assert order(ordered().fill("v", True, "f"), "f")[:4] == [None, 1.0, 2.0, 2.0]
    assert order(ordered().shift(["v"], 2, "_p"), "v_p") == [None, None, *vals[:-2]]
    assert order(ordered().cumulative("v", "count", "n"), "n")[-1] == sum(v is not None for v in vals)


def test_reducers_and_groups(abc):
    assert abc.null_count().df.first().asDict() == {"a": 0, "b": 2, "c": 1}
    row = abc.group_by(k=e.col("a") > 2).agg(n=e.col("b").n_unique(), s=e.col("b").sum()).df.orderBy("k").collect()
    assert [(r.n, r.s) for r in row] == [(2, 10), (3, 80)]


def test_pivots(spark):
    f = Frame(spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 3)], "i string, k string, v int"))
    assert f.pivot("k", "i", "v", "sum").df.orderBy("i").collect()[1].asDict() == {"i": "y", "p": 3, "q": None}
    assert f.to_dummies("k").columns == ["i", "k_p", "k_q", "v"]
    assert f.crosstab("i", "k").df.orderBy("i").first().asDict() == {"i": "x", "p": 1, "q": 1}


def test_explode_and_unnest(spark):
    f = Frame(spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [], [])], "i int, a array<int>, b array<int>"))
    assert f.explode("a").df.count() == 3 and [(r.a, r.b) for r in f.explode("a", "b").df.orderBy("i", "a").collect()][:2] == [(1, 3), (2, 4)]


def test_sql(spark, abc):
    assert sql_on(abc, "SELECT count(*) AS n FROM Self").df.first().n == 5
    ctx = SQLContext(spark, frames={"t": abc}).register_many(u=abc)
    assert ctx.tables() == ["t", "u"] and ctx.execute("SELECT t.a FROM t JOIN u ON t.a = u.a").df.count() == 5
    assert run_sql(spark, "SELECT '-- FROM ''x.csv''' AS s").df.first().s == "-- FROM 'x.csv'"


def test_time_spans():
    assert micros("1h30m") == 5_400_000_000


def test_too_many_values_are_an_error(spark):
    f = Frame(spark.range(10_001).selectExpr("id AS k", "id % 2 AS g", "1 AS v"))
    for made in (lambda: f.pivot("k", "g", "v"), lambda: f.crosstab("g", "k"), lambda: f.select("k").to_dummies("k"), lambda: f.partition_by("k")):
        with pytest.raises(TooManyValues, match="k has more than 10000"):
            made()
    most = Frame(spark.range(10_000).selectExpr("nullif(id, 0) AS k"))
    assert len(most.partition_by("k")) == 10_000 and len(most._values("k")) == 9_999


@pytest.fixture(params=[None, 7], ids=["one block", "many blocks"])
def blocks(request, monkeypatch):
    if request.param:
        real = order.cuts_of
        for module in (order, frames):
            monkeypatch.setattr(module, "cuts_of", lambda df, by, *_, **__: real(df, by, request.param))


def test_whole_frame_windows(spark, blocks):
    rng = random.Random(4)
    # ties in the first order column, nulls in it and in the values
    rows = [(rng.choice([None, 0, 0, 0, 1, 2]), i, rng.choice([None, None, float(i % 5), float(i)])) for i in range(60)]
    f = Frame(spark.createDataFrame(rows, "a int, b int, v double"), ["a", "b"])
    v = e.col("v")
    got = f.select("b", s=v.cum_sum(), n=v.cum_count(), lo=v.cum_min(), up=v.cum_max().round(1), was=v.shift(2), d=v.diff(), f=v.forward_fill(), g=v.backward_fill(), r=v.rank(), two=v.cum_count().cum_sum() + 1).df.collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, values, run = [], [r[2] for r in rows], 0
    sizes = sorted(x for x in values if x is not None)
    by_b = {r.b: r for r in got}
    for i, (_, b, x) in enumerate(rows):
        seen += [x] if x is not None else []
        run += len(seen)
        back = lambda n, i=i: values[i - n] if i >= n else None
        want = {
            "s": sum(seen) if x is not None else None, "n": len(seen), "lo": min(seen) if x is not None else None, "up": max(seen) if x is not None else None, "was": back(2),
            "d": x - back(1) if x is not None and back(1) is not None else None, "f": seen[-1] if seen else None, "g": next((y for y in values[i:] if y is not None), None),
            "r": sizes.index(x) + (sizes.count(x) + 1) / 2 if x is not None else None, "two": run + 1,
        }
        assert {k: by_b[b][k] for k in want} == want
    late = f.filter(v.cum_count() > 30).df
    assert late.columns == ["a", "b", "v"] and late.count() == sum(r.n > 30 for r in got)


def test_whole_frame_fills_and_numbers(spark, blocks):
    rows = [(i, None if i % 3 else float(i), None if i % 4 != 1 else f"t{i}") for i in range(50)]
    f = Frame(spark.createDataFrame(rows, "k long, v double, t string"), ["k"])
    up, down, line = (sorted(map(tuple, x.df.collect())) for x in (f.ffill(), f.bfill(), f.interpolate("v")))
    last = lambda seq, c: next((r[c] for r in seq if r[c] is not None), None)
    assert up == [(k, last(rows[k::-1], 1), last(rows[k::-1], 2)) for k, _, _ in rows]
    assert down == [(k, last(rows[k:], 1), last(rows[k:], 2)) for k, _, _ in rows]
    assert [r[1] for r in line[:49]] == pytest.approx([float(k) for k in range(49)]) and line[49][1] is None
    assert sorted((r["index"], r.k) for r in f.with_row_index().df.collect()) == [(k, k) for k in range(50)]


def test_asof_and_rolling(spark, blocks):
    rng = random.Random(1)
    left = [(i, rng.choice("aab"), rng.randrange(40)) for i in range(60)]
    right = [(t, k, t * 100 + ord(k)) for k in "ac" for t in range(0, 40, 3)]
    f, g = Frame(spark.createDataFrame(left, "i int, k string, t int")), Frame(spark.createDataFrame(right, "t int, k string, v int"))
    near = lambda t, k: max(((r[0], r[2]) for r in right if r[0] <= t and r[1] == k), default=(0, None))[1]
    assert sorted((r.i, r.v) for r in f.join_asof(g, on="t", by="k").df.collect()) == [(i, near(t, k)) for i, k, t in left]
    one = Frame(g.df.where("k = 'a'").drop("k"))
    assert sorted((r.i, r.v) for r in f.join_asof(one, on="t").df.collect()) == [(i, near(t, "a")) for i, _, t in left]
    timed = Frame(f.df.selectExpr("i", "k", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) AS at"))
    count = lambda rows, t: sum(t - 5 < u <= t for _, _, u in rows)
    assert sorted((r.i, r.n) for r in timed.rolling("at", "5s", n=F.count("*")).df.collect()) == [(i, count(left, t)) for i, _, t in left]
    assert sorted((r.i, r.n) for r in timed.rolling("at", "5s", by="k", n=F.count("*")).df.collect()) == [(i, count([x for x in left if x[1] == k], t)) for i, k, t in left]


def test_computed_keys(spark):
    a, b = Frame(spark.createDataFrame([(1, "x"), (2, "y")], "id int, n string")), Frame(spark.createDataFrame([(2, "p"), (3, "Q")], "key int, m string"))
    assert [tuple(r) for r in a.join(b, left_on=e.col("id") + 1, right_on="key").sort("id").df.collect()] == [(1, "x", 2, "p"), (2, "y", 3, "Q")]
    assert a.join(b, left_on=e.col("n"), right_on=e.col("m").str.to_lowercase(), how="anti").df.columns == ["id", "n"]
    with pytest.raises(ValueError):
        a.join(b, left_on=["id", "n"], right_on="key")


def test_index_verbs(spark):
    f = Frame(spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, "a", 7)], "k int, c string, v int"))
    wide = f.set_index(["k", "c"]).unstack()
    assert sorted(map(tuple, wide.df.collect())) == [(1, 5, None), (2, 7, None)] and wide.index == ("k",)
    long = wide.stack("c", "v")
    assert sorted(map(tuple, long.df.collect())) == [(1, "a", 5), (2, "a", 7)] and long.index == ("k", "c")
    assert long.reset_index(drop=True).columns == ["v"] and long.reset_index().columns == ["k", "c", "v"] and long.reset_index().index == ()
    with pytest.raises(ValueError):
        f.unstack()
