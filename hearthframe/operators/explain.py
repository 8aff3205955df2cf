"""Additive explanations of tree ensembles: exact Shapley values of each row's prediction.

A feature that is not known splits by the training rows' cover. A leaf then pays its value times, for each feature on
its path, o (1 where the row meets all the path's conditions on it, else 0) if the feature is known and z (the share of
training rows that go on) if not. The Shapley weights of all subsets of a leaf's other features add up to the integral
over t in [0, 1] of the product of z (1 - t) + o t, a polynomial that Gauss-Legendre nodes integrate exactly; so a leaf
of m features costs about m * m / 2 vector operations and no walk over subsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import filled, learner, middles

Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves(model) -> list[Leaf]:
    """(value, [(feature, above, at most, z)]) of every leaf of an ensemble's trees, values times the tree's weight.

    The driver walks the fitted trees, whose size the learner's parameters bound. Splits must be of numbers.
    """
    total = sum(model.treeWeights)
    scale = [w if type(model).__name__.startswith("GBT") else w / total for w in model.treeWeights]
    found: list[Leaf] = []
    for tree, weight in zip(model.trees, scale):
        walk = [(tree._java_obj.rootNode(), {})]
        while walk:
            node, path = walk.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                found.append((weight * node.prediction(), [(f, *c) for f, c in path.items()]))
                continue
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("a split of categories")
            f, cut = split.featureIndex(), split.threshold()
            sides = [node.leftChild(), node.rightChild()]
            count = [s.impurityStats().count() for s in sides]
            low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
            for side, c, bounds in zip(sides, count, ((low, min(high, cut)), (max(low, cut), high))):
                walk.append((side, path | {f: (*bounds, z * c / sum(count))}))
    return found


def shapley(x: np.ndarray, trees: list[Leaf]) -> tuple[np.ndarray, float]:
    """(values by row and feature, base): base plus a row's values is its prediction."""
    out, base = np.zeros(x.shape), 0.0
    for value, path in trees:
        z = np.array([c[3] for c in path])
        base += value * float(z.prod())
        if not path:
            continue
        at = x[:, [c[0] for c in path]]
        o = ((at > [c[1] for c in path]) & (at <= [c[2] for c in path])).astype(float)
        t, w = np.polynomial.legendre.leggauss((len(path) + 1) // 2)
        t, w = (t + 1) / 2, w / 2
        terms = z[:, None] * (1 - t) + o[:, :, None] * t
        before, after = np.ones((len(x), len(t))), [np.ones((len(x), len(t)))]
        for i in range(len(path) - 1, 0, -1):
            after.append(after[-1] * terms[:, i])
        for i, c in enumerate(path):
            out[:, c[0]] += value * (o[:, i] - z[i]) * ((before * after[-1 - i]) @ w)
            before = before * terms[:, i]
    return out, base


def tree_shap(df: DataFrame, model, features: list[str | Column]) -> tuple[Column, float]:
    """An array column of a row's values by feature, in their order, and the base."""
    trees = leaves(model)
    base = shapley(np.zeros((0, len(features))), trees)[1]

    def values(x: pd.Series) -> pd.Series:
        return pd.Series(list(shapley(np.array(x.tolist(), float).reshape(len(x), len(features)), trees)[0]))

    return F.pandas_udf(values, "array<double>")(F.array(*[F.col(f) if isinstance(f, str) else f for f in features])), base


def explained(df: DataFrame, features: list[str], y: str, trees: int = 20, seed: int = 42, boosted: bool = False) -> DataFrame:
    """Every row with the prediction of trees fitted on all rows that have a target, base, and s_<feature> of each feature.

    Missing features take the median. The reference value of an explanation is the training rows' cover.
    """
    train = df.filter(F.col(y).isNotNull())
    middle = middles(train, features)
    model = learner(features, y, trees, seed, boosted).fit(filled(train, features, middle))
    scored = model.transform(filled(df, features, middle))
    found, base = tree_shap(scored, model, [f"__in_{f}" for f in features])
    scored = scored.withColumn("__s", found).withColumns({"base": F.lit(float(base)), **{f"s_{f}": F.col("__s")[i] for i, f in enumerate(features)}})
    return scored.drop("__x", "__s", *[f"__in_{f}" for f in features])
