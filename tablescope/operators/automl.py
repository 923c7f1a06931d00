"""Automated modelling preview on Spark ML: target choice, candidates, evaluation, clustering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    CountVectorizerModel,
    Imputer,
    IndexToString,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import values as V
from tablescope.functions.values import quoted
from tablescope.operators.cells import column_of, field_types, typed_columns
from tablescope.operators.profile import distinct_counts, kind_counts
from tablescope.operators.trees import SparseBoostedClassifier, SparseForestClassifier
from tablescope.session import at_once, materialize, pinned

# Fixed values of target choice and model selection.
TARGET_HINTS = ("target", "label", "y", "class", "outcome", "response", "default", "churn")
PROMOTE_SHARE = 0.6
PROMOTE_LEAST = 3
CLASSES_LIMIT = 10
LEAST_ROWS = 20
LEAST_CLUSTER_ROWS = 10
MOST_CLUSTERS = 6
VALIDATION_SHARE = 0.2
SEED = 42
TREES = 200
LOGISTIC_ITERATIONS = 500

# Classes with fewer rows than this are split by rank, larger ones by hash alone.
RANKED_CLASS = 100

# Values of this many characters or more go by their SHA-256 in the dictionary that models hold.
NAMED_BY_HASH = 64

# Rows that clusters are fitted on, about, unless the caller says otherwise.
FIT_ROWS = 200_000


@dataclass
class ModelReport:
    """Outcome of a modelling run; the frames are lazy."""

    status: str
    message: str
    target: str | None = None
    problem_type: str | None = None
    rows_used: int = 0
    features: list[str] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    best: str | None = None
    predictions: DataFrame | None = None
    feature_stats: DataFrame | None = None
    target_distribution: DataFrame | None = None
    model: PipelineModel | None = None


def usable_columns(df: DataFrame, counts: DataFrame) -> list[str]:
    """Columns with a value and no nested type, alphabetical; one short list."""
    types = field_types(df)
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    filled = {r["column"] for r in counts.where("non_null_count > 0").select("column").collect()}
    return sorted(n for n in filled if not isinstance(types[n], nested))


def promoted_sql() -> str:
    """Whether a column's values are treated as numbers: enough of them parse, or it is boolean."""
    return (
        "inferred_type = 'boolean' OR "
        f"(numeric_count > 0 AND numeric_count >= greatest({PROMOTE_LEAST}, int({PROMOTE_SHARE}D * non_null_count)))"
    )


def target_scores(counts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Score per possible target column, lowest best: distance of its distinct share from one half, plus penalties."""
    joined = counts.join(F.broadcast(distinct), "column").where("distinct >= 2")
    return joined.selectExpr(
        "column", "rows", "non_null_count", "distinct", "inferred_type", "distinct / non_null_count AS ratio"
    ).selectExpr(
        "*",
        "CASE WHEN inferred_type = 'text' THEN 0.1D ELSE 0D END "
        "+ CASE WHEN ratio > 0.98D AND rows > 50 THEN 0.2D ELSE 0D END "
        "+ CASE WHEN ratio < 0.02D THEN 0.2D ELSE 0D END + abs(0.5D - least(ratio, 1D)) AS score",
    )


def choose_target(names: Sequence[str], scores: DataFrame) -> str | None:
    """A column named like a target, else the best score, ties alphabetical."""
    by_lower = {n.lower(): n for n in names}
    for hint in TARGET_HINTS:
        if hint in by_lower:
            return by_lower[hint]
    best = scores.where(F.col("column").isin(list(names))).orderBy("score", "column").first()
    return best["column"] if best else None


def problem_type_sql() -> str:
    """By the target's values: numbers with more than ten different ones are regressed."""
    return (
        f"CASE WHEN distinct <= {CLASSES_LIMIT} THEN 'classification' "
        f"WHEN inferred_type = 'numeric' OR {promoted_sql()} THEN 'regression' ELSE 'classification' END"
    )


def feature_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values, coverage and distinct values per feature."""
    counts = kind_counts(df, names)
    return counts.join(F.broadcast(distinct_counts(df, names)), "column", "left").selectExpr(
        "column AS name",
        "non_null_count",
        "1 - null_ratio AS coverage",
        "coalesce(distinct, 0L) AS unique_values",
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    label = V.canonical_text(quoted(target), field_types(df)[target]).alias("label")
    return df.select(label).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def number_distribution(stats: DataFrame, quantiles: DataFrame) -> DataFrame:
    """min, max, mean and median of a numeric target."""
    median = quantiles.where("p = 0.5").selectExpr("column", "q AS median")
    return stats.join(F.broadcast(median), "column").select("column", "min", "max", "mean", "median")


def model_frame(
    df: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, as_number: bool, key: Sequence[str] = ()
) -> DataFrame:
    """Columns ``n0..`` as doubles, ``c0..`` as strings, the target and the key, rows with target and some feature only.

    The frame is written, and ``row_id`` numbers its rows there, so that every later step
    sees a row under the same number.
    """
    names = [*numbers, *categories, target]
    wide = typed_columns(df, names, key, ("kind", "text", "num"))
    out = [quoted(k) for k in key]
    for i, name in enumerate(names):
        flag = f"WHEN kind{i} = 'boolean' THEN CASE text{i} WHEN 'true' THEN 1D ELSE 0D END"
        number = f"CASE {flag} ELSE num{i} END"
        if i < len(numbers):
            out.append(f"{number} AS n{i}")
        elif name != target:
            out.append(f"text{i} AS c{i - len(numbers)}")
        else:
            out.append(f"{number} AS target" if as_number else f"text{i} AS target")
    features = [f"n{i}" for i in range(len(numbers))] + [f"c{i}" for i in range(len(categories))]
    some = " OR ".join(f"{f} IS NOT NULL" for f in features)
    rows = wide.selectExpr(*out).where(f"target IS NOT NULL AND ({some})")
    return materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")


def category_counts(frame: DataFrame, categories: int) -> DataFrame:
    """(column, value, n): how many rows hold each value of ``c0..``."""
    cells = ", ".join(f"struct({i} AS column, c{i} AS value)" for i in range(categories))
    return frame.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def category_dictionary(frame: DataFrame, categories: int) -> DataFrame:
    """(position, column, value, n): the values of ``c0..``, the most frequent first, ties by column and value.

    It holds no more values than the rows that models are fitted on. The values are sorted by many
    tasks and written; a position is the place in its task's part, after all rows of the parts before.
    """
    # Beginnings put long texts in the same order; the bounds of the parts, which the driver holds, stay short.
    parts = category_counts(frame, categories).repartitionByRange(F.desc("n"), "column", F.left("value", F.lit(1000)))
    ordered = parts.sortWithinPartitions(F.desc("n"), "column", "value")
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "dictionary")
    # monotonically_increasing_id holds the number of the part above the lower 33 bits, which number its rows.
    placed = placed.withColumn("part", F.shiftright("place", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    position = (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).cast("int").alias("position")
    return placed.join(F.broadcast(before), "part").select("column", "value", "n", position)


def named_sql(value: str) -> str:
    """A short name of a value, itself if short. A hash has 64 characters, so it is no other value's name."""
    return f"CASE WHEN length({value}) < {NAMED_BY_HASH} THEN {value} ELSE sha2({value}, 256) END"


def present_values(categories: int, named: bool = False) -> SQLTransformer:
    """The names of a row's categories (``column=value``); ``named`` if ``c0..`` hold names, not values."""
    names = [f"c{i}" if named else named_sql(f"c{i}") for i in range(categories)]
    present = ", ".join(f"concat('{i}=', {name})" for i, name in enumerate(names))
    return SQLTransformer(statement=f"SELECT *, filter(array({present}), x -> x IS NOT NULL) AS present FROM __THIS__")


def preprocessing(numbers: int, categories: int, dictionary: Sequence[str] = (), named: bool = False) -> list:
    """Stages to a ``features`` vector.

    Numbers: median for missing values, then standard scores. Categories: a column of its own
    for each value (``column=value``, long values by their hash) of the dictionary; other values are in none.
    """
    stages, parts = [], []
    if numbers:
        inputs, filled = [f"n{i}" for i in range(numbers)], [f"filled{i}" for i in range(numbers)]
        stages += [
            Imputer(strategy="median", inputCols=inputs, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        ]
        parts.append("scaled")
    if dictionary:
        stages.append(present_values(categories, named))
        stages.append(CountVectorizerModel.from_vocabulary(list(dictionary), "present", "encoded").setBinary(True))
        parts.append("encoded")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def category_modes(frame: DataFrame, categories: int) -> dict[str, str]:
    """The most frequent value of each category column, the smallest of equally frequent ones (one short row per column)."""
    if not categories:
        return {}
    most = F.min(F.struct((-F.col("n")).alias("negated"), "value"))["value"].alias("mode")
    return {f"c{r['column']}": r["mode"] for r in category_counts(frame, categories).groupBy("column").agg(most).collect()}


def named_frame(frame: DataFrame, categories: int) -> DataFrame:
    """``frame`` with the names of the values of ``c0..`` in their place, so no long text is moved or kept again."""
    return frame.withColumns({f"c{i}": F.expr(named_sql(f"c{i}")) for i in range(categories)})


def frequent_values(named: DataFrame, frame: DataFrame, columns: Sequence[int]) -> dict[str, dict]:
    """What ``category_modes`` says of these columns of ``named``, rows of a ``named_frame``: value and name of each."""
    if not columns:
        return {}
    cells = ", ".join(f"struct({i} AS column, c{i} AS name)" for i in columns)
    counts = named.selectExpr(f"inline(array({cells}))").where("name IS NOT NULL").groupBy("column", "name").agg(F.count("*").alias("n"))
    most = counts.groupBy("column").agg(F.max("n").alias("n"))
    cells = ", ".join(f"struct({i} AS column, {named_sql(f'c{i}')} AS name, c{i} AS value)" for i in columns)
    values = frame.selectExpr(f"inline(array({cells}))").join(counts.join(F.broadcast(most), ["column", "n"]), ["column", "name"], "left_semi")
    smallest = values.groupBy("column").agg(F.min(F.struct("value", "name")).alias("mode"))
    return {f"c{r['column']}": r["mode"].asDict() for r in smallest.collect()}


def split_rows(frame: DataFrame, by_class: bool, key: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """``frame`` (target and ``key``, or row_id) with ``held_out``: a fifth of the rows, and of every class.

    Rows are chosen by a hash of their key or number, whatever features they hold. Of a small class
    the rows with the smallest hashes are held out, a fifth of them and at least one row if it has
    two or more; a large class is split by the hash alone, so no class is sorted as a whole.
    """
    named_by = list(key) or ["row_id"]
    text = F.concat_ws(":", F.lit(str(seed)), *[column_of(k).cast("string") for k in named_by])
    chance = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1_000_000
    limit = int(VALIDATION_SHARE * 1_000_000)
    if not by_class:
        return frame.withColumn("held_out", chance < limit)
    sizes = frame.groupBy("target").agg(F.count("*").alias("__class_rows"))
    marked = frame.join(sizes, "target").withColumn("__chance", chance)
    large = marked.where(F.col("__class_rows") >= RANKED_CLASS).withColumn("held_out", F.col("__chance") < limit)
    order = Window.partitionBy("target").orderBy("__chance", *[column_of(k) for k in named_by])
    held = F.when(F.col("__class_rows") < 2, 0).otherwise(F.greatest(F.lit(1), F.round(VALIDATION_SHARE * F.col("__class_rows"))))
    small = marked.where(F.col("__class_rows") < RANKED_CLASS).withColumn("held_out", F.row_number().over(order) <= held)
    return large.unionByName(small).drop("__class_rows", "__chance")


def classification_metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy and unweighted mean F1 from the confusion matrix (one row per pair of classes)."""
    cells = predicted.groupBy("label", "prediction").agg(F.expr("count(1) AS n"))
    sides = cells.selectExpr(
        "inline(array(struct(label AS class, n AS actual, 0L AS given, CASE WHEN label = prediction THEN n ELSE 0L END AS hit), "
        "struct(prediction AS class, 0L AS actual, n AS given, 0L AS hit)))"
    )
    classes = sides.groupBy("class").agg(
        F.sum("actual").alias("actual"), F.sum("given").alias("given"), F.sum("hit").alias("hit")
    )
    return classes.selectExpr(
        "sum(hit) / sum(actual) AS accuracy", "avg(2D * hit / (actual + given)) AS f1_macro"
    )


def regression_metrics(predicted: DataFrame) -> DataFrame:
    return predicted.selectExpr(
        "1 - try_divide(sum(pow(label - prediction, 2)), regr_syy(label, label)) AS r2",
        "sqrt(avg(pow(label - prediction, 2))) AS rmse",
        "avg(abs(label - prediction)) AS mae",
    )


def candidate_models(problem: str, classes: int, boosted_classes: int | None) -> dict[str, object]:
    """The estimators by name; None for one that is not tried."""
    if problem == "regression":
        return {
            "random_forest_regressor": RandomForestRegressor(numTrees=TREES, seed=SEED),
            "gradient_boosting_regressor": GBTRegressor(seed=SEED),
            "linear_regression": LinearRegression(),
        }
    boosting = SparseBoostedClassifier(seed=SEED)
    return {
        "random_forest_classifier": SparseForestClassifier(numTrees=TREES, seed=SEED),
        "gradient_boosting_classifier": boosting if classes <= 2 else OneVsRest(classifier=boosting) if boosted_classes is None or classes <= boosted_classes else None,
        "logistic_regression": LogisticRegression(maxIter=LOGISTIC_ITERATIONS),
    }


def _evaluate(name: str, estimator, train: DataFrame, valid: DataFrame, problem: str) -> dict:
    """Fit one candidate; an error is recorded, not raised."""
    if estimator is None:
        return {"name": name, "status": "skipped", "metrics": {}, "message": "more classes than boosted_classes"}
    try:
        predicted = estimator.fit(train).transform(valid).select("label", "prediction")
        metrics = (classification_metrics if problem == "classification" else regression_metrics)(predicted)
        return {"name": name, "status": "evaluated", "metrics": metrics.first().asDict(), "message": None}
    except Exception as error:  # noqa: BLE001 - any failure of a candidate only disqualifies it
        return {"name": name, "status": "error", "metrics": {}, "message": str(error).splitlines()[0]}


def _skipped(message: str, **known) -> ModelReport:
    return ModelReport("skipped", message, **known)


def train(
    df: DataFrame,
    target: str | None = None,
    key: Sequence[str] = (),
    fit_rows: int | None = None,
    max_classes: int | None = None,
    boosted_classes: int | None = None,
) -> ModelReport:
    """Choose a target, compare three models on held-out rows, refit the best on all rows.

    ``key`` names columns that identify a row; they are no features and come with the
    predictions, with ``row_id``. Models are fitted on all labelled rows and tell all their
    categories apart. On request, ``fit_rows`` bounds, about, the labelled rows that models are
    fitted on, chosen by hash, and with them these categories; counts, held-out rows and
    predictions still cover all. On request, a target with more than ``max_classes`` classes is
    not modelled, and one with more than ``boosted_classes`` is not boosted, which takes a fit
    for each class.

    A failure of any step is reported in the status and never raised.
    """
    counts = pinned(kind_counts(df))
    names = [n for n in usable_columns(df, counts) if n not in key]
    if not names:
        return _skipped("No column is left to model after those without values were taken out.")
    distinct = distinct_counts(df, names)
    target = target or choose_target(names, target_scores(counts, distinct))
    if target is None:
        return _skipped("No column is fit to be a target; use clustering.")
    facts = {
        r["column"]: r
        for r in counts.join(F.broadcast(distinct), "column")
        .selectExpr("column", "distinct", f"{promoted_sql()} AS promoted", f"{problem_type_sql()} AS problem")
        .collect()
    }
    if target not in facts:
        return _skipped("The target has no values.", target=target)
    features = [n for n in names if n != target]
    if not features:
        return _skipped("No feature is left beside the target.", target=target)
    problem = facts[target]["problem"]
    known = dict(target=target, problem_type=problem)
    if problem == "classification" and max_classes is not None and facts[target]["distinct"] > max_classes:
        return _skipped("The target has too many classes to be modelled.", **known)
    try:
        return _compared(df, features, facts, key, fit_rows, boosted_classes, known)
    except Exception as error:  # noqa: BLE001 - a profile goes on without its models
        return ModelReport("failed", f"Modelling stopped: {str(error).splitlines()[0]}", **known)


def _compared(df, features, facts, key, fit_rows, boosted_classes, known) -> ModelReport:
    target, problem = known["target"], known["problem_type"]
    by_class = problem == "classification"
    numbers = [n for n in features if facts[n]["promoted"]]
    categories = [n for n in features if not facts[n]["promoted"]]
    frame = model_frame(df, numbers, categories, target, not by_class, key)
    filled = frame.selectExpr("count(1) AS rows", *[f"count(c{i}) AS c{i}" for i in range(len(categories))]).first()
    rows, blank = filled["rows"], [i for i in range(len(categories)) if filled[f"c{i}"] < filled["rows"]]
    known = known | dict(rows_used=rows, features=features)
    if rows < LEAST_ROWS:
        return _skipped(f"Fewer than {LEAST_ROWS} rows hold a target and a feature.", **known)

    split = materialize(split_rows(named_frame(frame, len(categories)), by_class, key), "split")
    learned = split.where("NOT held_out")
    if by_class:
        seen = split.groupBy("target").agg(F.count_if(~F.col("held_out")).alias("n")).selectExpr("count_if(n = 0) AS unseen", "count(1) AS n").first()
        if seen["unseen"] or seen["n"] < 2:
            return ModelReport("failed", "Training rows must hold every class, and two at least.", **known)
    everything = split
    if fit_rows is not None:
        learned, everything = learned.where(_bounded(rows, fit_rows)), split.where(_bounded(rows, fit_rows))
    # Class numbers cover all rows; they say nothing about features.
    label = [StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc").fit(split)] if by_class else []

    def prepared(part: DataFrame) -> tuple[dict, list]:
        """Modes and fitted stages from these rows alone."""
        modes = frequent_values(part, frame, blank)
        part = part.na.fill(_each(modes, "name"))
        stages = Pipeline(stages=preprocessing(len(numbers), len(categories), _listed(part, len(categories), named=True), True)).fit(part).stages
        return modes, [*stages, *label]

    def ready(part: DataFrame, modes: dict, stages: list) -> DataFrame:
        out = PipelineModel(stages).transform(part.na.fill(_each(modes, "name")))
        # Without the names of all features, which every later plan would hold on the driver.
        return (out if by_class else out.withColumn("label", F.col("target"))).select(F.col("features").alias("features", metadata={}), "label")

    modes, stages = prepared(learned)
    # Written rows leave nothing of the long plans behind them on the driver.
    held = partial(materialize, name="ready") if by_class else DataFrame.persist
    fitted_on, judged_on = held(ready(learned, modes, stages)), held(ready(split.where("held_out"), modes, stages))
    models = candidate_models(problem, facts[target]["distinct"], boosted_classes)
    steps = [partial(_evaluate, n, m, fitted_on, judged_on, problem) for n, m in models.items()]
    # Spark's own tree learners keep all rows and columns in memory, so those of a regression follow one another.
    tried = at_once(df.sparkSession, *steps) if by_class else [step() for step in steps]
    fitted_on.unpersist()
    judged_on.unpersist()
    score = "accuracy" if by_class else "r2"
    scored = [c for c in tried if c["metrics"].get(score) is not None]
    known = known | dict(candidates=tried, feature_stats=feature_stats(df, features))
    if not scored:
        return ModelReport("failed", "No candidate could be fitted and judged.", **known)
    best = max(scored, key=lambda c: c["metrics"][score])["name"]
    if by_class and max(c["metrics"][score] for c in scored) == 0:
        return ModelReport("failed", "No candidate told any held-out row's class.", **known)
    modes, stages = prepared(everything)
    last = ready(everything, modes, stages)
    fitted = models[best].fit(held(last) if by_class else last)
    # Rows that are predicted hold values, not their names.
    model = PipelineModel([*(present_values(len(categories)) if isinstance(s, SQLTransformer) else s for s in stages), fitted])
    return ModelReport(
        "succeeded", "The best of the candidates was fitted to all rows.", best=best, model=model,
        predictions=predictions(model, frame.na.fill(_each(modes, "value")), problem, key), **known,
    )


def predictions(model: PipelineModel, frame: DataFrame, problem: str, key: Sequence[str] = ()) -> DataFrame:
    """The key, row_id, prediction, actual and, for classes, one ``prob_<class>`` column each."""
    out = model.transform(frame)
    named_by = [column_of(k) for k in key] + [F.col("row_id")]
    if problem == "regression":
        return out.select(*named_by, "prediction", F.col("target").alias("actual"))
    indexers = [s for s in model.stages if isinstance(s, StringIndexerModel)]
    labels = next(s.labels for s in indexers if s.isSet("outputCol") and s.getOutputCol() == "label")
    named = IndexToString(inputCol="prediction", outputCol="named", labels=labels).transform(out)
    columns = [*named_by, F.col("named").alias("prediction"), F.col("target").alias("actual")]
    if "probability" in named.columns:
        chances = vector_to_array("probability")
        columns += [chances[i].alias(f"prob_{label}") for i, label in enumerate(labels)]
    return named.select(*columns)


def candidate_table(report: ModelReport, df: DataFrame) -> DataFrame:
    """Candidates as rows: name, status, metric, value and whether it won."""
    rows = [
        (report.target, report.problem_type, c["name"], c["status"], metric, value, c["name"] == report.best)
        for c in report.candidates
        for metric, value in (c["metrics"] or {"none": None}).items()
    ]
    schema = "target string, problem_type string, name string, status string, metric string, value double, best boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def _bounded(rows: int, fit_rows: int) -> Column:
    """Whether a row is one of about ``fit_rows`` that models are fitted on."""
    return F.pmod(F.xxhash64(F.lit(SEED + 1), "row_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / rows))


def _each(modes: dict[str, dict], part: str) -> dict[str, str]:
    return {c: mode[part] for c, mode in modes.items()}


def _listed(frame: DataFrame, categories: int, named: bool = False) -> list[str]:
    """The dictionary of ``frame`` in order, as ``column=value``; long values by their hash, so no text comes to the driver.

    ``named`` if ``frame`` holds names already; then equally frequent long values are in the order of their names.
    """
    if not categories:
        return []
    name = "value" if named else named_sql("value")
    names = category_dictionary(frame, categories).selectExpr("position", f"concat(column, '=', {name}) AS name")
    return names.orderBy("position").select("name").toArrow()["name"].to_pylist()


def cluster(df: DataFrame, columns: Sequence[str] | None = None, key: Sequence[str] = (), fit_rows: int = FIT_ROWS) -> ModelReport:
    """K-means for two to six clusters, fitted on about ``fit_rows`` rows; the best silhouette wins. Constant columns are left out."""
    counts = kind_counts(df)
    names = [n for n in usable_columns(df, counts) if n not in key and (columns is None or n in columns)]
    facts = {
        r["column"]: r
        for r in counts.join(F.broadcast(distinct_counts(df, names)), "column")
        .where("distinct > 1")
        .selectExpr("column", "distinct", f"{promoted_sql()} AS promoted")
        .collect()
    } if names else {}
    if not facts:
        return _skipped("No column with different values is left to cluster by.")
    features = sorted(facts)
    numbers = [n for n in features if facts[n]["promoted"]]
    categories = [n for n in features if not facts[n]["promoted"]]
    frame = model_frame(df.withColumn("_every", F.lit("1")), numbers, categories, "_every", as_number=False, key=key).drop("target")
    rows = frame.count()
    if rows < LEAST_CLUSTER_ROWS:
        return _skipped(f"Fewer than {LEAST_CLUSTER_ROWS} rows hold a feature.", rows_used=rows)
    frame = frame.na.fill(category_modes(frame, len(categories)))
    learned = frame.where(_bounded(rows, fit_rows))
    prepared = Pipeline(stages=preprocessing(len(numbers), len(categories), _listed(learned, len(categories)))).fit(learned)
    points = prepared.transform(learned).select("features").persist()
    try:
        tried, fitted = [], {}
        judge = ClusteringEvaluator()
        for k in range(2, min(MOST_CLUSTERS, rows - 1) + 1):
            name = f"kmeans_{k}"
            try:
                model = KMeans(k=k, seed=SEED).fit(points)
                assigned = model.transform(points)
                if sum(size > 0 for size in model.summary.clusterSizes) < 2:
                    tried.append({"name": name, "status": "degenerate", "metrics": {}, "message": None})
                    continue
                metrics = {"silhouette": judge.evaluate(assigned)}
                tried.append({"name": name, "status": "evaluated", "metrics": metrics, "message": None})
                fitted[name] = model
            except Exception as error:  # noqa: BLE001 - one failing size must not end the sweep
                tried.append({"name": name, "status": "error", "metrics": {}, "message": str(error).splitlines()[0]})
        known = dict(problem_type="clustering", rows_used=rows, features=features, candidates=tried)
        scored = [c for c in tried if c["metrics"]]
        if not scored:
            return ModelReport("failed", "No number of clusters could be fitted and judged.", **known)
        best = max(scored, key=lambda c: c["metrics"]["silhouette"])["name"]
        model = PipelineModel([*prepared.stages, fitted[best]])
        assigned = model.transform(frame).select(*[column_of(k) for k in key], "row_id", F.col("prediction").alias("cluster"))
        return ModelReport(
            "succeeded", "The number of clusters with the best silhouette was kept.", best=best, model=model,
            predictions=assigned, feature_stats=feature_stats(df, features), **known,
        )
    finally:
        points.unpersist()


def cluster_sizes(report: ModelReport) -> DataFrame:
    return report.predictions.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).orderBy("cluster")
