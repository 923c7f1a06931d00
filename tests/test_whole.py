import hashlib
import json
from collections import Counter
from pathlib import Path

from conftest import by, rows, strings
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from tablescope import profile_dataset, quick_profile
from tablescope.operators import automl, quality
from tablescope.plans.dataset import write_profile
from tablescope.operators import report as report_rows
from tablescope.sources import delimited, files
from tablescope.streaming.profile import start_profile


def table(spark):
    return spark.range(120).selectExpr(
        "id", "id * 2.5 AS price", "CASE WHEN id = 7 THEN 9000 ELSE id % 9 END AS size", "concat('g', id % 3) AS kind"
    )


def test_full_profile_is_written_once(spark, tmp_path):
    report = profile_dataset(table(spark), order_by=["id"])
    text = report.summary.first()["summary"]
    assert text.startswith("The dataset contains 120 rows across 4 columns. Data quality score 1.00.")
    assert "Strongest correlation observed between id and price (r=1.00)." in text
    assert "Potential outliers detected in size: 9000.00." in text
    metrics = report.metrics.first()
    assert (metrics["rows"], metrics["columns"], metrics["completeness"]) == (120, 4, 1.0)
    assert report.preview.count() == 5 and report.scatter.count() == 3 * 120
    assert report.matrix.count() == 9

    path = str(tmp_path / "out")
    entries = report.write(path)
    names = {r["name"] for r in entries.collect()}
    assert {"profile_json", "results_descriptive_stats.csv", "results_graphs_histograms.csv", "results_manifest"} <= names
    keys = {r["key"] for r in entries.collect()}
    assert keys == {str(p.parent) for p in Path(path).rglob("part-*")}  # all that was written, and nothing else
    document = json.loads(spark.read.text(f"{path}/results/results.json").first()[0])
    assert document["summary"] == {"rows": 120, "columns": 4, "completeness": 1.0, "dq_score": 1.0}
    assert [c["name"] for c in document["schema"]] == ["id", "kind", "price", "size"]
    assert delimited.read_csv(spark, f"{path}/results/descriptive_stats.csv").count() == 3
    assert {r["key"] for r in write_profile(spark.range(0).selectExpr("raise_error('not read') AS x"), path).collect()} == keys
    profile_dataset(table(spark).limit(10)).write(path)
    assert json.loads(spark.read.text(f"{path}/results/results.json").first()[0])["summary"]["rows"] == 120


def test_lazy_and_settled_profiles_agree(spark):
    eager, lazy = profile_dataset(table(spark)), profile_dataset(table(spark), settle=False)
    for name in ("profile", "issues", "descriptive", "correlations", "histograms", "boxes", "summary"):
        assert sorted(map(str, rows(getattr(eager, name)))) == sorted(map(str, rows(getattr(lazy, name)))), name


def test_quick_report(spark, tmp_path):
    df = strings(spark, n=["1", "2", "3"], a=["1", "2", "3,000"], b=["2", "3", "x"])
    report = quick_profile(df, ["n"])
    assert {r["column"]: r["type"] for r in report.types.collect()} == {"n": "number", "a": "number", "b": "string"}
    assert rows(report.shape) == [(3, 3)] and rows(report.checks) == [("non_empty", "pass")]
    assert by(report.stats)["a"]["max"] == 3000
    assert json.loads(report.document().first()[0])["summary"] == {"rows": 3, "columns": 3}
    path = str(tmp_path / "quick")
    entries = dict(rows(report.write(path)))
    assert len(entries) == 6 and entries["results/correlations.csv"] == "text/csv"
    assert spark.read.text(f"{path}/results/report.txt").first()[0] == "Rows: 3, columns: 3"
    assert delimited.read_csv(spark, f"{path}/results/descriptive_stats.csv").count() == 2
    written = json.loads(spark.read.text(f"{path}/results/results.json").first()[0])
    assert written["links"]["manifest"] == f"{path}/results/manifest.json" and len(written["head"]) == 3
    # A finished result is kept; one whose list is missing is written anew as a whole.
    other = quick_profile(strings(spark, n=["1"], a=["5"], b=["6"]), ["n"], delimiter=";")
    assert dict(rows(other.write(path))) == entries and spark.read.text(f"{path}/results/report.txt").first()[0] == "Rows: 3, columns: 3"
    unfinished = str(tmp_path / "unfinished")
    report.shape.write.json(f"{unfinished}/results/report.txt")
    assert dict(rows(other.write(unfinished))) == entries
    assert spark.read.text(f"{unfinished}/results/report.txt").first()[0] == "Rows: 1, columns: 3"
    assert json.loads(other.document().first()[0])["delimiter"] == ";"


def test_metrics_take_the_source_size(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text("id\n1\n2\n")
    checked = quality.check_table(files.read_dataset(spark, str(path / "a.csv")))
    severities = quality.severity_summary(checked.issues())
    row = report_rows.dataset_metrics(checked.facts, severities, files.source_metadata(spark, str(path))).first()
    assert (row["bytes_read"], row["rows"], row["columns"], row["issue_count"]) == (7, 2, 1, 0)


def test_statuses_and_target_choice(spark):
    assert automl.train(strings(spark, a=[None, None])).status == "skipped"
    few = automl.train(spark.range(10).selectExpr("id", "id % 2 AS label"))
    assert few.status == "skipped" and few.target == "label" and few.rows_used == 10
    assert automl.cluster(spark.range(30).selectExpr("1 AS a")).status == "skipped"
    df = spark.range(100).selectExpr("id AS key", "concat('t', id % 50) AS half", "id % 2 AS flag")
    from tablescope.operators.profile import distinct_counts, kind_counts

    scores = automl.target_scores(kind_counts(df), distinct_counts(df))
    assert automl.choose_target(df.columns, scores) == "half"
    assert automl.choose_target(["Churn", "Y"], scores) == "Y"


def test_classification_with_missing_and_rich_categories(spark, monkeypatch):
    monkeypatch.setattr(automl, "TREES", 5)
    monkeypatch.setattr(automl, "LOGISTIC_ITERATIONS", 20)
    df = spark.range(300).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END AS label",
        "CASE WHEN id % 5 > 0 THEN id % 2 + rand(1) / 4 END AS signal",
        "CASE WHEN id % 7 > 0 THEN concat('c', id % 4) END AS few",
        "concat('m', id % 150) AS many",
    )
    report = automl.train(df)
    assert report.status == "succeeded" and report.problem_type == "classification" and report.rows_used == 300
    assert len(report.candidates) == 3 and all(c["status"] == "evaluated" for c in report.candidates)
    best = next(c for c in report.candidates if c["name"] == report.best)
    assert best["metrics"]["accuracy"] > 0.7 and 0 <= best["metrics"]["f1_macro"] <= 1
    assert report.predictions.count() == 300
    assert {"row_id", "prediction", "actual"} <= set(report.predictions.columns)


def test_equal_rows_are_split_and_chance_is_no_success(spark, monkeypatch):
    monkeypatch.setattr(automl, "TREES", 3)
    monkeypatch.setattr(automl, "LOGISTIC_ITERATIONS", 5)
    for m in (2, 3, 4, 5):
        df = spark.range(400).selectExpr("id", "id % 2 AS label", f"id % {m} AS feature")
        split = automl.split_rows(df.selectExpr("id AS row_id", "label AS target"), True).groupBy("target", "held_out").count().collect()
        assert len(split) == 4 and all(20 <= r["count"] <= 60 for r in split if r["held_out"])
        report = automl.train(df, "label", key=["id"])
        best = [c["metrics"]["accuracy"] for c in report.candidates if c["metrics"]]
        assert report.status == "failed" or max(best) > 0.3
        if m in (2, 4):  # the feature tells the class
            assert report.status == "succeeded" and max(best) == 1
            assert sorted(r["id"] for r in report.predictions.collect()) == list(range(400))


def test_positions_of_categories_are_settled_by_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(900).selectExpr("concat('é', id % 90) AS c0", "CASE WHEN id % 3 > 0 THEN concat(id % 5, repeat('x', 1200), id) END AS c1", "string(null) AS c2")
        found = automl.category_dictionary(frame, 3)
        windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        assert len(found.inputFiles()) > 1 and not any("value" in x for x in windows)
        listed = sorted(found.collect(), key=lambda r: r["position"])
        empty = automl.category_dictionary(frame.select("c2").toDF("c0"), 1)
        assert empty.count() == 0 and empty.schema == found.schema
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cells = Counter((i, r[i]) for r in frame.collect() for i in range(3) if r[i] is not None)
    wanted = sorted(((n, c, v) for (c, v), n in cells.items()), key=lambda x: (-x[0], x[1], x[2].encode()))
    assert [(r["n"], r["column"], r["value"]) for r in listed] == wanted and [r["position"] for r in listed] == list(range(len(wanted)))


def test_a_fifth_of_every_small_class_is_held_out(spark):
    sizes = {"a": 1, "b": 2, "c": 7, "d": 13, "e": 50, "f": 99}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)], "chance string, target string")
    split = automl.split_rows(df, True, ["chance"])
    found = {r["target"]: r["held"] for r in split.groupBy("target").agg(F.count_if("held_out").alias("held")).collect()}
    assert found == {"a": 0, "b": 1, "c": 1, "d": 3, "e": 10, "f": 20}
    assert split.columns == ["target", "chance", "held_out"] and split.count() == sum(sizes.values())


def test_long_categories_are_named_by_hash_and_told_apart(spark):
    frame = spark.range(60).selectExpr("concat(repeat('long ', 500), id % 6) AS c0", "CASE WHEN id % 2 = 0 THEN concat('s', id % 4) END AS c1", "string(null) AS c2")
    listed = automl._listed(frame, 3)
    assert len(listed) == len(set(listed)) == 8 and max(map(len, listed)) == 66 and {"1=s0", "1=s2"} <= set(listed)
    assert automl.category_modes(frame, 3) == {"c0": "long " * 500 + "0", "c1": "s0"}
    model = PipelineModel(automl.preprocessing(0, 3, listed))
    found = model.transform(frame.union(spark.sql("SELECT repeat('long ', 500), 's1', 'x'"))).select("c0", "c1", vector_to_array("features").alias("places"))
    for r in found.collect():
        named = {listed[i] for i, x in enumerate(r["places"]) if x}
        wanted = {f"0={hashlib.sha256(r['c0'].encode()).hexdigest()}", f"1={r['c1']}"} & set(listed)
        assert named == wanted and len(named) == (0 if r["c1"] == "s1" else 1 if r["c1"] is None else 2)


def test_modelling_failures_are_statuses(spark, monkeypatch):
    one = spark.range(40).selectExpr("id", "CASE WHEN id = 3 THEN 'rare' ELSE concat('c', id % 2) END AS label", "id % 5 AS x")
    assert automl.train(one, "label", key=["id"]).status in ("succeeded", "failed")
    assert automl.train(one.selectExpr("id", "string(null) AS label", "x"), "label", key=["id"]).status == "skipped"
    monkeypatch.setattr(automl, "preprocessing", lambda *a: 1 / 0)
    stopped = automl.train(one, "label", key=["id"])
    assert stopped.status == "failed" and "division" in stopped.message


def test_clusters(spark):
    df = spark.range(90).selectExpr("(id % 3) * 100 + rand(3) AS x", "(id % 3) * -50 + rand(4) AS y", "1 AS same")
    report = automl.cluster(df)
    assert report.best == "kmeans_3" and report.features == ["x", "y"]
    assert [r["size"] for r in automl.cluster_sizes(report).collect()] == [30, 30, 30]


def test_stream_profile_resumes(spark, tmp_path):
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []

    def run():
        stream = spark.readStream.schema("a string, n double").parquet(source)
        start_profile(stream, lambda current, _: seen.append(by(current)), state).awaitTermination()
        return seen[-1]

    spark.createDataFrame([("1", 1.0), ("x", None)], "a string, n double").write.parquet(source)
    assert run()["a"]["rows"] == 2
    spark.createDataFrame([("true", 3.0), (None, 5.0)], "a string, n double").write.mode("append").parquet(source)
    last = run()
    assert last["n"]["rows"] == 4 and last["n"]["mean"] == 3.0 and last["n"]["null_count"] == 1
    assert (last["a"]["numeric_count"], last["a"]["boolean_count"], last["a"]["text_count"], last["a"]["null_count"]) == (1, 1, 1, 1)
