import pytest
from pyspark.sql import functions as F

from lakeweave.plans import actions
from lakeweave.sources import catalog, files, lake


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text('id,code,flag,day,at,amount,note\n1,007,t,2024-01-02,2024-01-02 03:04:05,1.50,"two\nlines, ""quoted"""\n2,010,f,2024-01-03,2024-01-03 00:00:00 UTC,2,\n')
    (tmp_path / "b.csv").write_text("key,a_id\nx,1\ny,2\n")
    (tmp_path / "empty.csv").write_text("p,q\n")
    return tmp_path


def test_types_keep_leading_zeros_and_read_flags(spark, folder):
    tables, errors = lake.load_lake(spark, str(folder))
    assert sorted(tables) == ["a", "b", "empty"] and not errors
    assert dict(tables["a"].dtypes) == {"id": "bigint", "code": "string", "flag": "boolean", "day": "date", "at": "timestamp_ntz", "amount": "double", "note": "string"}
    rows = tables["a"].orderBy("id").collect()
    assert rows[0].code == "007" and rows[0].flag is True and rows[1].flag is False and rows[0].note == 'two\nlines, "quoted"' and rows[1].note is None
    assert lake.header(spark, str(folder / "b.csv")) == ["key", "a_id"] and lake.has_column(tables["b"], "key")
    assert tables["empty"].count() == 0 and dict(tables["empty"].dtypes) == {"p": "string", "q": "string"}


def test_links(spark, folder, tmp_path):
    tables, _ = lake.load_lake(spark, str(folder))
    columns = lake.catalog_columns(tables)
    (tmp_path / "links.txt").write_text("a.csv,b,id,a_id,0.9\na,b,nope,a_id\na,zzz,id,x\n")
    strict = lake.read_links(spark, str(tmp_path / "links.txt"), columns)
    assert [tuple(r) for r in strict.collect()] == [("a", "id", "b", "a_id", 1)]
    loose = lake.read_links(spark, str(tmp_path / "links.txt"), columns, label=0, lenient=True)
    assert sorted(tuple(r) for r in loose.collect()) == [("a", "id", "b", "a_id", 0), ("a", "id", "b", "a_id", 0)]


def test_wildcard(spark, folder):
    got = lake.read_matching(spark, f"{folder}/*.csv")
    assert {r.source_relation: r.n for r in got.groupBy("source_relation").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 2}
    with pytest.raises(FileNotFoundError):
        lake.read_matching(spark, f"{folder}/none*.csv")


def test_command_line(spark, folder, capsys):
    from lakeweave.__main__ import main

    main(["overlap", str(folder), "a.id", "b.a_id"], spark)
    assert "1.0" in capsys.readouterr().out
    main(["candidates", str(folder), "--top", "1"], spark)
    assert "a_id" in capsys.readouterr().out
    main(["tree", str(folder), "a", "b"], spark)
    assert "JOIN" in capsys.readouterr().out
    main(["sql", str(folder), "SELECT count(*) AS n FROM a"], spark)
    assert capsys.readouterr().out.split() == ["n", "2"]
    main(["profile", str(folder)], spark)
    assert "amount" in capsys.readouterr().out


def test_versions_are_anchored(spark):
    one = spark.range(1).toDF("x")
    c = catalog.VersionedCatalog(spark, {"campaign": one, "campaign_history_2": one})
    assert c.latest("campaign") == "campaign" and c.latest("CAMPAIGN_HISTORY") == "campaign_history_2"
    assert c.add_version("campaign", one) == "campaign_1" and c.add_version("campaign", one) == "campaign_2"
    c.drop_latest("campaign")
    assert c.latest("campaign") == "campaign_1"
    c.drop_latest("campaign")
    c.drop_latest("campaign")
    assert c.latest("campaign") == "campaign" and c.latest("none") is None
    with pytest.raises(KeyError):
        c.current("none")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a": 1}')
    (tmp_path / "in/b.json").write_text('{"a": ')
    before = spark.createDataFrame(files.content_hashes(spark, str(tmp_path / "in")).collect())
    assert before.count() == 2
    assert files.valid(spark, str(tmp_path / "in/a.json"), "json") and not files.valid(spark, str(tmp_path / "in/b.json"), "json")
    with pytest.raises(ValueError):
        files.valid(spark, "x", "yaml")
    (tmp_path / "in/b.json").write_text("{}")
    (tmp_path / "in/c.json").write_text("{}")
    changed = files.changed_files(before, files.content_hashes(spark, str(tmp_path / "in")))
    assert sorted((r.path.rsplit("/", 1)[-1], r.change) for r in changed.collect()) == [("b.json", "changed"), ("c.json", "added")]
    df = spark.range(3).toDF("x")
    files.append_jsonl(df, str(tmp_path / "out"))
    files.append_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    files.write_csv(df, str(tmp_path / "csv"))
    with pytest.raises(Exception, match="exist"):
        files.write_csv(df, str(tmp_path / "csv"))
    files.create_table(spark, "made", df)
    assert spark.table("made").count() == 3


def test_edge_file(spark, tmp_path):
    (tmp_path / "b-a.json").write_text('{"table1": "b", "table2": "a", "candidates": {"x ↔ y": true, "p <-> q": "true", "r -> s": "False"}}')
    got = files.edge_file(spark, str(tmp_path / "b-a.json"), "a", "b")
    assert sorted((r.column1, r.column2) for r in got.collect()) == [("q", "p"), ("y", "x")]


def test_actions(spark):
    spark.range(3).toDF("x").createOrReplaceTempView("nums")
    assert actions.parse('Thought: go\nSQL(file_path="d.duckdb", command="SELECT sum(x) AS s FROM nums", output="direct")') == actions.Sql("SELECT sum(x) AS s FROM nums", "direct")
    assert actions.parse('SAMPLE_ROWS(table="nums", rows=2)') == actions.SampleRows("nums", 2)
    assert actions.parse("nothing") is None and actions.parse('Terminate(output="a")') == actions.Finish("a")
    assert actions.parse_pairs('["a - b", "c ↔ d-e"]') == [("a", "b"), ("c", "d-e")]
    texts = iter(['SQL(command="SELECT sum(x) AS s FROM nums")', 'GET_TABLE_INFO(table="nums")', "SQL(command='SELECT nope')", 'Terminate(output="3")'])
    loop = actions.Loop(spark, lambda messages: next(texts))
    assert loop.run("sum the numbers") == "3"
    assert [t["observation"].splitlines()[0] for t in loop.trajectory[:2]] == ["s", "path,type,nullable"] and loop.trajectory[2]["observation"].startswith("error")
    assert loop.log().where("plan_seconds >= 0 and run_seconds >= 0 and tokens_in > 0 and tokens_out > 0").count() == 4
    assert actions.true_pairs('{"a - b": true, "c ↔ d-e": "True", "f -> g": false, "h <-> i": "no"}') == [("a", "b"), ("c", "d-e")]
    slow = actions.Sql("SELECT count(*) AS n FROM range(3000000000) a WHERE sha2(cast(id AS string), 512) = ''")
    assert actions.run(spark, slow, seconds=1.0) == "error: stopped after 1 seconds"
    assert actions.run(spark, actions.Sql("SELECT 1 AS n"), seconds=60.0).split() == ["n", "1"]  # the session goes on
    again = actions.Loop(spark, lambda messages: 'SQL(command="SELECT 1")')
    assert again.run("x") is None and len(again.trajectory) == 2
    assert actions.Loop(spark, lambda messages: "hm").run("x") is None
    assert actions.observation("x" * 40_000).endswith("[cut]")


def test_listings(spark):
    spark.range(1).toDF("x").createOrReplaceTempView("listed")
    assert catalog.list_tables(spark).where("name = 'listed'").count() == 1
    nested = spark.createDataFrame([(1, [("a",)])], "i int, s array<struct<t:string>>")
    assert [r.path for r in catalog.table_info(nested).collect()] == ["i", "s", "s.t"]
    assert catalog.run_sql(spark, "SELECT 1 AS a, null AS b") == "a,b\n1,\n"
    assert catalog.quoted("a.b`c") == "`a`.`b``c`"
    assert lake.sample_rows(spark.range(9).toDF("x"), 2).count() == 2 and lake.first_rows(spark.range(9), 3).count() == 3
    assert spark.range(1).select(F.lit(1)).count() == 1
