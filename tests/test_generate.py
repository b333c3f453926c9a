from larkspur.plans.engine import Engine
from larkspur.sources import generate


def test_generated_tables_are_read_back(spark, tmp_path):
    wanted = generate.plans(3, rows=200, seed=5)
    assert wanted == generate.plans(3, rows=200, seed=5) != generate.plans(3, rows=200, seed=6)
    wanted[2].refers_to = ["table_1", "table_2"]
    generate.write(spark, str(tmp_path / "data"), wanted, seed=5)
    engine = Engine(spark)
    assert engine.load(str(tmp_path / "data")) == ["table_1", "table_2", "table_3"]
    kinds = {"N": "double", "T": "string", "D": "timestamp_ntz"}
    for plan in wanted:
        df = spark.table(plan.name)
        assert df.dtypes[: len(plan.columns) + 1] == [("id", "double"), *((n, kinds[k]) for n, k in plan.columns)]
        assert df.count() == df.select("id").distinct().count() == 200
        for name, _ in plan.columns:
            assert 150 < df.where(f"{name} is not null").count() <= 200
    assert engine.sql("select count(*) n from table_3 c, table_1 a, table_2 b where c.table_1_id = a.id and c.table_2_id = b.id").first().n == 200


def test_a_folder_of_queries(spark, tmp_path, capsys):
    from larkspur.__main__ import main

    generate.write(spark, str(tmp_path / "data"), generate.plans(1, rows=10), seed=1)
    (tmp_path / "q").mkdir()
    for k, text in enumerate(("select count(*) as n from table_1", "select id from table_1 where id > 7 order by id desc;")):
        (tmp_path / "q" / f"query{k}.txt").write_text(text)
    main([str(tmp_path / "data"), str(tmp_path / "q"), "--out", str(tmp_path / "out"), "--one-file"])
    assert [x.partition(":")[0] for x in capsys.readouterr().out.splitlines()] == ["query0", "query1"]
    texts = [next((tmp_path / "out" / f"query{k}").glob("part-*.csv")).read_text() for k in range(2)]
    assert texts == ["n\n10.00\n", "id\n10.00\n9.00\n8.00\n"]
