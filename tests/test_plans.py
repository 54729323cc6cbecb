"""Learners, files, command line, stream, and the queries' contract."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from arcwise.operators.relations import cooccurrence
from arcwise.plans import cli, queries
from arcwise.operators.walks import path_features
from arcwise.plans.learn import PathModel, _vectors, first_sightings, mutual_information, predict, train_predpath
from arcwise.plans.methods import score
from arcwise.sources.readers import read_candidates, read_dictionary, read_graph, read_matrix, read_triples
from arcwise.sources.writers import write_dictionary, write_graph, write_matrix, write_scores
from arcwise.storage import stored
from arcwise.streaming.candidates import score_stream
from tests.test_graph import C, facts, graph

SF = "/root/testdata/sf0.001"


def test_mutual_information_of_a_perfect_feature(spark):
    labels = spark.createDataFrame([(i, 0, 100, int(i < 2)) for i in range(4)], "sid long, pid int, oid long, class int")
    features = spark.createDataFrame([(0, 0, 100, [-1, 1], 2), (1, 0, 100, [-1, 1], 2), (0, 0, 100, [-1, 2], 1), (2, 0, 100, [-1, 2], 1)], "sid long, pid int, oid long, rels array<int>, n long")
    got = {tuple(r.rels): r.mi for r in mutual_information(features, labels).collect()}
    assert got[-1, 1] == pytest.approx(0.693147, abs=1e-6) and got[-1, 2] == pytest.approx(0.0, abs=1e-9)


def test_no_row_of_each_fact_goes_through_the_driver(spark):
    """Stored features are a few MB for millions of rows; by their size Spark would broadcast them."""
    g, c = graph(spark, C), facts(spark, [(0, 0, 3), (3, 0, 4), (1, 0, 6), (6, 0, 7)])
    features = stored(path_features(g, c, 5), "features")
    labels = stored(c.withColumn("class", (F.col("sid") % 2).cast("int")), "labels")
    values = features.select("sid", "pid", "oid", "rels", F.col("n").cast("double").alias("value"))
    model = train_predpath(g, labels, top=3, folds=2)
    for df in (mutual_information(features, labels), first_sightings(features, labels), _vectors(labels, values, [[-1, 1, 1]]), predict(model, g, labels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [sid" in plan and not re.search(r"BroadcastHashJoin \[sid#\d+L?, pid", plan)


def test_model_round_trip(spark, tmp_path):
    g = graph(spark, C)
    rows = [(s, 0, o, int((s + o) % 2)) for s in range(8) for o in range(8) if s != o]
    c = spark.createDataFrame(rows, "sid long, pid int, oid long, class int")
    model = train_predpath(g, c, top=10, folds=2)
    assert 0 <= model.auc <= 1 and len(model.paths) == 10
    model.save(spark, str(tmp_path / "m"))
    again = PathModel.load(spark, str(tmp_path / "m"))
    assert again.paths == model.paths
    a = {(r.sid, r.oid): r.score for r in predict(again, g, c).collect()}
    assert len(a) == len(rows) and all(0 <= x <= 1 for x in a.values())


def test_files_and_command_line(spark, tmp_path):
    (tmp_path / "t.nt").write_text("a likes b .\nb likes c .\nc knows a .\na knows d .\nd likes b .\n")
    assert read_triples(spark, str(tmp_path / "t.nt")).count() == 5
    assert cli.main(["build", "-d", str(tmp_path / "t.nt"), "-o", str(tmp_path / "g")], spark) == 0
    assert read_dictionary(spark, str(tmp_path / "g/nodes"), "node_id", "node_name").count() == 4
    assert read_graph(spark, str(tmp_path / "g")).edges.count() == 10
    (tmp_path / "c.csv").write_text('sid,sub,pid,pred,oid,obj,class\n0.0,a,1,likes,2.0,"c, of d",1.0\n1,b,0,knows,3,d,0\n,x,0,knows,1,b,0\n')
    c = read_candidates(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in c.select("sid", "oid", "class", "obj").orderBy("sid").collect()] == [(0, 2, 1, "c, of d"), (1, 3, 0, "d")]
    assert cli.main(["relsim", "-g", str(tmp_path / "g"), "-o", str(tmp_path / "r")], spark) == 0
    assert cli.main(["-m", "jaccard", "-g", str(tmp_path / "g"), "-d", str(tmp_path / "c.csv"), "-o", str(tmp_path / "o")], spark) == 0
    out = spark.read.option("header", True).csv(str(tmp_path / "o/scores"))
    assert out.count() == 2 and "softmaxscore" in out.columns
    write_scores(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).first().b == "[1,2]"
    write_dictionary(spark.createDataFrame([(0, "x y")], "i long, n string"), str(tmp_path / "d"))
    assert read_dictionary(spark, str(tmp_path / "d"), "i", "n").first().n == "x y"


def test_unknown_names(spark):
    g, c = graph(spark, C), facts(spark, [(0, 0, 3)])
    with pytest.raises(ValueError):
        score("none", g, c)
    with pytest.raises(ValueError):
        score("stream", g, c)


def test_stream_of_candidates(spark, tmp_path):
    facts(spark, [(0, 0, 3), (3, 0, 4)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("sid long, pid int, oid long").parquet(str(tmp_path / "in"))
    q = score_stream(live, graph(spark, C), "jaccard", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.625, 1.0]


def test_every_query_has_its_columns_in_sql():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["lp_jaccard", "lp_katz", "walk_features_capped", "rel_similarity_logtf", "lp_jaccard_effective", "lp_katz_effective", "closure_paths", "walk_listing_three", "pra_path_probability"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert sorted(got) == sorted(want)


def test_closures_follow_long_paths(spark, monkeypatch):
    chain = graph(spark, [(k, k + 1, 0) for k in range(6)])
    monkeypatch.setattr(queries, "_setup", lambda *_: (chain, facts(spark, [(0, 0, 6)])))
    assert [r.score > 0 for r in queries.closure_kl(spark, SF).collect()] == [True]


def test_command_line_scores_by_a_model_and_stored_tables(spark, tmp_path):
    write_graph(graph(spark, C), str(tmp_path / "g"))
    rows = "".join(f"{s},0,{o},{(s + o) % 2}\n" for s in range(8) for o in range(8) if s != o)
    (tmp_path / "c.csv").write_text("sid,pid,oid,class\n" + rows)
    g, c, out = (str(tmp_path / x) for x in ("g", "c.csv", "o"))
    write_matrix(cooccurrence(read_graph(spark, g)).select("r1", "r2", F.col("c").cast("double").alias("value")), str(tmp_path / "cooc"))
    assert cli.main(["relsim", "-g", g, "--cooc", str(tmp_path / "cooc"), "-o", str(tmp_path / "r")], spark) == 0
    sims = {(r.r1, r.r2): r.value for r in read_matrix(spark, str(tmp_path / "r/relsim")).collect()}
    assert sims[0, 1] == pytest.approx(0.522735, abs=1e-6)
    assert cli.main(["-m", "stream", "-g", g, "-r", str(tmp_path / "r/relsim"), "-d", c, "-o", out], spark) == 0
    assert spark.read.json(f"{out}/flows").where("size(paths) = size(flows) and size(paths) > 0").count() == 56
    assert cli.main(["-m", "relklinker", "-g", g, "-r", str(tmp_path / "r/relsim"), "-d", c, "-o", out], spark) == 0
    text = [r.path_text for r in spark.read.option("header", True).csv(f"{out}/scores").collect()]
    assert all(re.fullmatch(r"\d( -\[\d\]-> \d)+", t) for t in text)
    PathModel("pra", [[-1, 1, 1]], train_predpath(graph(spark, C), read_candidates(spark, c), top=1, folds=2).model, 1.0, 0.5).save(spark, str(tmp_path / "m"))
    assert cli.main(["-m", "pra", "--model", str(tmp_path / "m"), "-g", g, "-d", c, "-o", out], spark) == 0
    assert spark.read.option("header", True).csv(f"{out}/scores").where("double(softmaxscore) > 0").count() == 56


def test_training_without_the_predicates_edges(spark):
    rows = [(s, 0, o, int((s + o) % 2)) for s in range(8) for o in range(8) if s != o]
    c = spark.createDataFrame([*rows, (None, 0, 1, 1), (1, 0, 2, None)], "sid long, pid int, oid long, class int")
    assert all(0 not in p for p in train_predpath(graph(spark, C), c, folds=2, removal="effective").paths)
    with pytest.raises(ValueError):
        train_predpath(graph(spark, []), c, folds=2)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150 * 25
    sums = __spark_entry__.entry(spark).groupBy("sid").agg(F.sum("softmaxscore").alias("s")).collect()
    assert all(r.s == pytest.approx(1, abs=1e-4) for r in sums)
