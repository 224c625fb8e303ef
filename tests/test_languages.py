"""SQL dialect, scripts, command-line functions and plan texts."""

import pytest

from quillon import Frame, cli, introspect
from quillon.plans.parse import ParseError, parse, parse_predicate
from quillon.script import COMMANDS, Interpreter, ScriptError, statements, transpile
from quillon.sql import Session
from quillon.sql import parse as parse_sql

#: Every command of the script language.
NAMES = """load use stash frames drop_frame save show ishow browse schema describe head tail select drop filter sort limit groupby join explain explain_tree tree graph show_graph mermaid collect reset
source timing info clear help exit quit reverse sample shuffle unique null_count glimpse size cast fill_null drop_null rename sum mean min max median std write with_row_index pwd ls cd sum_horizontal
mean_horizontal min_horizontal max_horizontal all_horizontal any_horizontal sum_all mean_all min_all max_all std_all var_all median_all count_all null_count_all with unnest explode upsample scan_csv
scan_parquet scan_ipc scan_ndjson scan_json scan_auto fill_nan forward_fill backward_fill top_k bottom_k transpose unpivot partition_by skew kurtosis approx_n_unique corr cov pivot""".split()


@pytest.fixture(scope="module")
def people(spark):
    return Frame.from_map(spark, {"name": ["a", "b", "c", "d"], "age": [10, 20, 30, -5], "dept": ["x", "x", "y", "y"]})


@pytest.fixture(scope="module")
def session(spark, people):
    s = Session(spark)
    s.register("people", people)
    return s


def rows(f):
    return [tuple(r) for r in f.collect()]


def test_sql(session):
    assert rows(session.query("SELECT name FROM people WHERE age > 15")) == [("b",), ("c",)]
    assert rows(session.query("select dept, sum(age) as total from people group by dept order by dept")) == [("x", 30), ("y", 25)]
    assert rows(session.query("SELECT count(*) AS n, avg(age) FROM people WHERE age > -6 AND (age < 15 OR name = 'c')")) == [(3, 35 / 3)]
    assert session.query("SELECT avg(age) FROM people").columns == ["avg(age)"]
    assert rows(session.query("SELECT DISTINCT dept FROM people ORDER BY dept DESC LIMIT 1")) == [("y",)]
    assert rows(session.query("SELECT name FROM people ORDER BY dept DESC, age ASC")) == [("d",), ("c",), ("a",), ("b",)]
    assert rows(session.query("SELECT * FROM people LIMIT 0")) == []
    assert rows(session.query("SELECT dept, max(age) AS m FROM people GROUP BY dept HAVING max(age) > 25")) == [("y", 30)]
    assert session.tables() == ["people"]
    with pytest.raises(KeyError):
        session.query("SELECT a FROM nowhere")
    with pytest.raises(ValueError):
        session.query("SELECT name, sum(age) FROM people GROUP BY dept")
    with pytest.raises(ParseError):
        parse_sql("SELECT FROM")


def test_expression_language(people):
    get = lambda text: [r[0] for r in people.select(parse(text).alias("o")).collect()]
    assert get("age * 2 + 1 - -age") == [31, 61, 91, -14]
    assert get("(age + 2) * 3 / 4") == [9, 16, 24, -2]
    assert get('name.str.upper().str.replace("A", "z")') == ["z", "B", "C", "D"]
    assert get("not age > 15 and dept == 'x' or age == 30") == [True, False, True, False]
    assert get("age.sum().over(dept)") == [30, 30, 25, 25]
    assert get("coalesce(null, age).cast(\"i64\")") == [10, 20, 30, -5]
    assert get("age.between(5, 25)") == [True, True, False, False]
    for bad in ("age +", "nope(age)", "age.str.nope()", "age.args()", "(age", "age ! 2", "age.__init__()"):
        with pytest.raises(ParseError):
            parse(bad)
    where = lambda text: [r[0] for r in people.filter(parse_predicate(text)).select("name").collect()]
    assert where('name contains "a" or age > 10 and dept == "y"') == ["a", "c"]
    assert where("age is_not_null and name not_like 'b%'") == ["a", "c", "d"]


def test_every_command_exists():
    assert set(NAMES) <= set(COMMANDS)


def test_scripts(spark, tmp_path):
    (tmp_path / "p.csv").write_text('name,age\nann,30\n"b, c",\ndan,25\n')
    (tmp_path / "inner.txt").write_text("filter age > 26\n")
    s = Interpreter(spark)
    s.run_line(f"cd {tmp_path}")
    f = s.run("""
      load p.csv            # "#" in a comment
      .stash all
      source inner.txt
      with older = age + 1
      show
      sum age
      schema
      use all
      drop_null age
      join p.csv on name left
      sort age desc
      save out.parquet
      exit
      nonsense
    """)
    assert rows(f) == [("ann", 30, 30), ("dan", 25, 25)]
    assert "ann   30   31" in s.out[0] and s.out[1] == "30" and s.out[2].startswith("name: string")
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    with pytest.raises(ScriptError, match="did you mean filter"):
        s.run("filtr age > 1")
    with pytest.raises(ScriptError, match="script:2"):
        s.run("reset\nselect nope\nshow")
    assert statements('a \\\n b # c\n\n.d "x # y"') == [(1, "a   b"), (3, 'd "x # y"')] or [x for _, x in statements('a \\\n b # c\n\n.d "x # y"')] == ["a   b", 'd "x # y"']
    assert "f = f.filter((col('age') > lit(1)))" in transpile(".filter age > 1\nexit\nnonsense")
    with pytest.raises(ValueError, match="line 2"):
        transpile("reset\nnonsense")


def test_more_commands(spark, sf):
    s = Interpreter(spark)
    s.run(f"load {sf}/nation.parquet\nwith_row_index at 1\ncast n_regionkey f64\nsum_horizontal t at n_regionkey\ngroupby n_regionkey at:count:n t:mean\nhead 2\nexplain_tree\nmermaid\ninfo\nglimpse 2\nnull_count\ncorr n n_regionkey\npartition_by n_regionkey\nframes\npwd\nhelp\nsize\ntiming\nlimit 1\ntail 1")
    assert s.frame.columns == ["n_regionkey", "n", "t_mean"] and any("flowchart TD" in x for x in s.out) and any("Aggregate" in x for x in s.out)


def test_command_line_functions(spark, people, tmp_path):
    from quillon.sources import files

    files.save(people, str(tmp_path / "people.parquet"))
    assert rows(cli.sql(spark, "SELECT max(age) AS m FROM people", str(tmp_path / "people.parquet"))) == [(30,)]
    changed = Frame.from_map(spark, {"name": ["a", "b", "e", "d"], "age": [10, 21, 1, -5], "dept": ["x", "x", "y", "y"]})
    assert sorted((r["change"], r["name"]) for r in cli.diff(people, changed, ["name"]).collect()) == [("added", "e"), ("changed", "b"), ("removed", "c")]
    assert sorted((r["change"], r["row"]) for r in cli.diff(people, changed.head(3)).collect()) == [("changed", 1), ("changed", 2), ("removed", 3)]
    cli.convert(spark, str(tmp_path / "people.parquet"), str(tmp_path / "people.csv"))
    assert cli.cat(spark, str(tmp_path / "people.csv"), str(tmp_path / "people.parquet")).height() == 8
    assert cli.main(["count", str(tmp_path / "people.parquet")]) == 0


def test_plans(people):
    from quillon import col

    f = people.filter(col("age") > 1).group_by("dept").agg(col("age").sum())
    assert "Physical" in introspect.explain(f) and "└─ " in introspect.explain_tree(f) and "-->" in introspect.mermaid(f)
    p = introspect.Profiler()
    p.collect("all", f)
    assert "all" in p.report() and '"name": "all"' in p.chrome_trace()


def test_tools_and_typed_columns(spark, people, sf):
    from quillon import tools
    from quillon.typed import Float, Int, Str

    path = f"{sf}/nation.parquet"
    assert tools.call(spark, "row_count", path=path) == 25 and tools.call(spark, "schema", path=path)[0] == {"name": "n_nationkey", "type": "int"}
    assert len(tools.call(spark, "head", path=path, n=3)["rows"]) == 3 and tools.call(spark, "null_counts", path=path)["n_name"] == 0
    assert tools.call(spark, "sql", query="SELECT count(*) AS n FROM nation", paths=[path]) == {"rows": [{"n": 25}], "next": None}
    assert {r["statistic"] for r in tools.call(spark, "describe", path=path)["rows"]} >= {"mean", "75%"}
    assert rows(people.filter(Int("age") > 15).select((Int("age") + 1).alias("x"), Str("name").str.upper().alias("u"))) == [(21, "B"), (31, "C")]
    with pytest.raises(TypeError):
        people.select(Float("age"))


def test_pages_follow_on_without_reading_again(spark, tmp_path):
    from quillon import tools

    path = str(tmp_path / "p.parquet")
    rows = 3 * tools.PAGE_ROWS + 5
    spark.range(0, rows, 1, 1).write.parquet(path)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("pages"))
    got, at = tools.call(spark, "rows", path=path, offset=10), 0
    seen = [r["id"] for r in got["rows"]]
    spark.sparkContext.setJobGroup("pages", "following pages")
    while got["next"] is not None:
        assert got["next"] == 10 + len(seen)
        got = tools.call(spark, "rows", path=path, offset=got["next"])
        seen += [r["id"] for r in got["rows"]]
    assert seen == list(range(10, rows)) and jobs() == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # a page far from any other, and one over files that have changed
    assert tools.call(spark, "rows", path=path, offset=rows - 2)["rows"] == [{"id": rows - 2}, {"id": rows - 1}]
    first = tools.call(spark, "rows", path=path)
    spark.range(5, 5 + rows, 1, 1).write.mode("overwrite").parquet(path)
    assert tools.call(spark, "rows", path=path, offset=first["next"])["rows"][0]["id"] == 5 + tools.PAGE_ROWS
