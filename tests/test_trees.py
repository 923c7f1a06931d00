import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from tablescope.operators import automl, trees


def one_hot(spark, rows, classes=2, own=True):
    """A number of many values, one of five, a category of 40 values and, if wanted, one that every row has for itself."""
    df = spark.range(rows).selectExpr("id", "hash(id, 1) % 1000 / 7D AS a", "double(pmod(hash(id, 2), 5)) AS b", "pmod(hash(id, 3), 40) AS c", "pmod(hash(id, 9), 60) AS noise")
    df = df.selectExpr("*", f"array(concat('c', c), {'concat(id)' if own else 'concat(b)'}) AS present", f"double(least({classes - 1}, greatest(0, int((a + 20 * b + 3 * c + noise) / 130)))) AS label")
    listed = sorted(r[0] for r in df.selectExpr("explode(present)").distinct().collect())
    encoded = CountVectorizerModel.from_vocabulary(listed, "present", "encoded").setBinary(True).transform(df)
    out = VectorAssembler(inputCols=["a", "b", "encoded"], outputCol="features").transform(encoded)
    return out.select("id", F.col("features").alias("features", metadata={}), "label").localCheckpoint()


def splits(model):
    return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees]


def chances(model, df):
    return {r["id"]: r["p"] for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}


@pytest.mark.parametrize("classes", [2, 4])
def test_one_tree_is_that_of_spark(spark, classes):
    df = one_hot(spark, 1200, classes)
    wanted, found = (kind(numTrees=1, bootstrap=False, seed=3).fit(df) for kind in (RandomForestClassifier, trees.SparseForestClassifier))
    assert splits(found) == splits(wanted) and found.numClasses == classes
    assert chances(found, df) == chances(wanted, df)


def test_boosted_trees_are_those_of_spark(spark):
    df = one_hot(spark, 1200)
    wanted, found = (kind(maxIter=3, maxDepth=3, seed=3).fit(df) for kind in (GBTClassifier, trees.SparseBoostedClassifier))
    assert splits(found)[0] == splits(wanted)[0] and list(found.treeWeights) == list(wanted.treeWeights)
    p, q = chances(wanted, df), chances(found, df)
    assert sum(abs(p[i][1] - q[i][1]) for i in p) / len(p) < 0.01


def test_forests_are_repeatable_and_as_good_as_those_of_spark(spark):
    df = one_hot(spark, 1500, own=False)
    wanted, found, again = (kind(numTrees=30, seed=3).fit(df) for kind in (RandomForestClassifier, *[trees.SparseForestClassifier] * 2))
    assert splits(found) == splits(again) and found.getNumTrees == 30 and len(set(splits(found))) > 20
    right = [m.transform(df).where("prediction = label").count() / 1500 for m in (wanted, found)]
    assert right[1] > right[0] - 0.03
    many = OneVsRest(classifier=trees.SparseBoostedClassifier(maxIter=1, maxDepth=2)).fit(one_hot(spark, 200, 3, own=False))
    assert len(many.models) == 3


def test_bins_come_from_all_values(spark):
    # Spark looks at about 10,000 rows; 31 thresholds of 30,000 different values share all of them evenly.
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(30000).selectExpr("double(pmod(id * 7919, 30000)) AS x", "double(id % 2) AS label"))
    blocks, rows, width, classes = trees._blocks(trees.SparseForestClassifier(), df)
    assert (rows, width, classes) == (30000, 1, 2)
    found = trees.thresholds_of(blocks, rows, 32)
    assert [round(x, 1) for x in found[0]] == [pytest.approx(30000 * k / 32, abs=1) for k in range(1, 32)]
    # A value that fills several shares is one step; the thresholds left follow at once on it.
    heavy = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(900).selectExpr("CASE WHEN id < 500 THEN 7.5D ELSE double(id) END AS x", "double(id % 2) AS label"))
    blocks, rows, *_ = trees._blocks(trees.SparseForestClassifier(), heavy)
    wanted = RandomForestClassifier(numTrees=1, maxDepth=8, bootstrap=False).fit(heavy)
    assert splits(trees.SparseForestClassifier(numTrees=1, maxDepth=8, bootstrap=False).fit(heavy)) == splits(wanted)
    assert trees.thresholds_of(blocks, rows, 32)[0][:3].tolist() == [253.75, 500.5, 501.5]


def test_classifiers_hold_what_rows_hold(spark):
    # 9000 rows with a category of their own: Spark's trees keep 9000 numbers for each row.
    models = automl.candidate_models("classification", 2, None)
    df = one_hot(spark, 9000)
    blocks, rows, width, _ = trees._blocks(models["random_forest_classifier"], df)
    assert rows == 9000 and width > 9000 and isinstance(models["gradient_boosting_classifier"], trees.SparseBoostedClassifier)
    held = blocks.selectExpr("sum(" + " + ".join(f"length({c})" for c in ("labels", "features", "starts", "rows", "numbers")) + ") AS n").first()["n"]
    assert held < 100 * rows


def test_models_are_fitted_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(automl, "TREES", 2)
    monkeypatch.setattr(automl, "LOGISTIC_ITERATIONS", 5)
    df = spark.range(120).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'a' ELSE 'b' END AS label", "id % 3 AS x")
    asked = []
    monkeypatch.setattr(automl, "_bounded", lambda *given, real=automl._bounded: asked.append(given) or real(*given))
    assert automl.train(df, "label", key=["id"]).status == "succeeded" and not asked


def test_names_stand_for_values_and_modes_are_the_same(spark):
    frame = spark.range(40).selectExpr("CASE WHEN id % 4 > 0 THEN concat(repeat('long ', 40), id % 5) END AS c0", "CASE WHEN id > 9 THEN concat('v', id) END AS c1", "string(null) AS c2")
    named = automl.named_frame(frame, 3)
    modes = automl.frequent_values(named, frame, [0, 1, 2])
    assert {c: m["value"] for c, m in modes.items()} == automl.category_modes(frame, 3) and set(modes) == {"c0", "c1"}
    assert len(modes["c0"]["name"]) == 64 and modes["c1"] == {"value": "v10", "name": "v10"}
    assert sorted(automl._listed(named, 3, named=True)) == sorted(automl._listed(frame, 3)) and automl.frequent_values(named, frame, []) == {}
