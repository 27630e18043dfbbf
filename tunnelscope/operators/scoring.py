"""Scoring with a boosted tree ensemble and per-class thresholds."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.fields import finite_or_zero

# Ensembles up to this many nodes become one generated expression; larger ones are walked in arrays.
EXPRESSION_NODES = 512


def load_model(text: str) -> dict:
    """Trees and base margin from the public JSON form of a boosted tree model.

    A model trained with early stopping counts up to its best round, and leaves of dropped-out trees have their weight. Models
    with several outputs, linear ones, and categorical splits are rejected.
    """
    learner = json.loads(text)["learner"]
    booster, param = learner["gradient_booster"], learner["learner_model_param"]
    if int(param.get("num_class", 0)) > 1 or int(param.get("num_target", 1)) > 1:
        raise ValueError("a model with several outputs is not supported")
    # Trees with weights hold an ordinary ensemble inside.
    inner = booster.get("gbtree", booster)
    if "model" not in inner or "trees" not in inner["model"]:
        raise ValueError(f"not a tree model: {booster.get('name')}")
    found = inner["model"]["trees"]
    weights = booster.get("weight_drop") or [1.0] * len(found)
    best = learner.get("attributes", {}).get("best_iteration")
    if best is not None:
        per_round = int(inner["model"].get("gbtree_model_param", {}).get("num_parallel_tree", 1))
        found = found[: (int(best) + 1) * max(per_round, 1)]
    trees = []
    for t, weight in zip(found, weights, strict=False):
        if t.get("categories") or any(t.get("split_type", [])):
            raise ValueError("categorical splits are not supported")
        value = [v * weight if left < 0 else v for v, left in zip(t["split_conditions"], t["left_children"], strict=True)]
        names = {"left": "left_children", "right": "right_children", "feature": "split_indices"}
        trees.append({**{k: t[v] for k, v in names.items()}, "value": value})
    base = float(str(param["base_score"]).strip("[]"))
    return {"base_margin": math.log(base / (1 - base)), "trees": trees}


def read_model(spark: SparkSession, path: str) -> dict:
    """The model in a file that Spark can read."""
    return load_model(spark.read.text(path, wholetext=True).head().value)


def feature_vector(df: DataFrame, feat_cols: list[str]) -> list[Column]:
    """Model inputs in order: absent features are 0, non-finite values too."""
    return [finite_or_zero(F.col(c)) if c in df.columns else F.lit(0.0) for c in feat_cols]


def _tree_expression(tree: dict, inputs: list[Column], node: int = 0) -> Column:
    if tree["left"][node] < 0:
        return F.lit(float(tree["value"][node]))
    split = F.lit(float(tree["value"][node])).cast("float")
    goes_left = inputs[tree["feature"][node]].cast("float") < split
    left = _tree_expression(tree, inputs, tree["left"][node])
    right = _tree_expression(tree, inputs, tree["right"][node])
    return F.when(goes_left, left).otherwise(right)


def score_by_expression(df: DataFrame, feat_cols: list[str], model: dict) -> DataFrame:
    inputs = feature_vector(df, feat_cols)
    margin = F.lit(model["base_margin"])
    for tree in model["trees"]:
        margin = margin + _tree_expression(tree, inputs)
    return df.withColumn("score", 1.0 / (1.0 + F.exp(-margin)))


def _depth(tree: dict) -> int:
    """Splits on the longest way from the root."""
    level, below = 0, [0]
    while True:
        below = [c for n in below if tree["left"][n] >= 0 for c in (tree["left"][n], tree["right"][n])]
        if not below:
            return level
        level += 1


def score_by_arrays(df: DataFrame, feat_cols: list[str], model: dict) -> DataFrame:
    """Walk a row down all trees at once, one level after another.

    The trees stand in flat arrays, which are one literal of the plan, so the plan has as many steps as the deepest tree has levels, however
    many trees there are. Leaves lead to themselves.
    """
    roots, left, right, feature, value = [], [], [], [], []
    for tree in model["trees"]:
        base = len(left)
        roots.append(base)
        for n, (to_left, to_right) in enumerate(zip(tree["left"], tree["right"], strict=True)):
            leaf = to_left < 0
            left.append(base + (n if leaf else to_left))
            right.append(base + (n if leaf else to_right))
            feature.append(0 if leaf else tree["feature"][n])
            value.append(float(tree["value"][n]))
    flat = json.dumps({"roots": roots, "left": left, "right": right, "feature": feature, "value": value})
    forest = "struct<roots:array<int>,left:array<int>,right:array<int>,feature:array<int>,value:array<double>>"
    # A literal, so the optimiser reads it once, and no row carries it.
    trees = f"from_json('{flat}', '{forest}')"
    x = F.array(*[c.cast("float") for c in feature_vector(df, feat_cols)]) if feat_cols else F.array(F.lit(0.0).cast("float"))
    at = f"{trees}.roots"
    for _ in range(max((_depth(t) for t in model["trees"]), default=0)):
        goes_left = f"get(_x, get({trees}.feature, n)) < CAST(get({trees}.value, n) AS FLOAT)"
        at = f"transform({at}, n -> IF({goes_left}, get({trees}.left, n), get({trees}.right, n)))"
    margin = F.expr(f"aggregate({at}, {float(model['base_margin'])!r}D, (sum, n) -> sum + get({trees}.value, n))")
    return df.withColumn("_x", x).withColumn("score", 1.0 / (1.0 + F.exp(-margin))).drop("_x")


def score(df: DataFrame, feat_cols: list[str], model: dict) -> DataFrame:
    """Add ``score``, the probability of an anomaly."""
    nodes = sum(len(t["left"]) for t in model["trees"])
    chosen = score_by_expression if nodes <= EXPRESSION_NODES else score_by_arrays
    return chosen(df, feat_cols, model)


def class_threshold(config: PipelineConfig) -> Column:
    """Threshold of the row's class; the global one if it has none of its own."""
    fallback = F.lit(config.thr_global)
    if not config.thr_map:
        return fallback
    pairs = [F.lit(x) for qfi, thr in config.thr_map.items() for x in (int(qfi), float(thr))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("qfi").cast("int")), fallback)


def decide(scored: DataFrame, config: PipelineConfig) -> DataFrame:
    """Add ``thr`` and ``pred``."""
    thr = class_threshold(config)
    return scored.withColumn("thr", thr).withColumn(
        "pred", (F.col("score") >= F.col("thr")).cast("int")
    )
