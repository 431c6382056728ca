"""Small fitted trees as plain data and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tree_rules(model) -> dict:
    """Nested {feature, threshold, left, right} / {value} of a fitted MLlib decision tree."""

    def walk(node) -> dict:
        if node.subtreeDepth() == 0:
            return {"value": float(node.prediction())}
        split = node.split()
        return {
            "feature": int(split.featureIndex()),
            "threshold": float(split.threshold()),
            "left": walk(node.leftChild()),
            "right": walk(node.rightChild()),
        }

    return walk(model._call_java("rootNode"))


def tree_column(rules: dict, values: Column) -> Column:
    """The tree's prediction from an array of feature values, inside generated code."""
    if "value" in rules:
        return F.lit(rules["value"])
    goes_left = values[rules["feature"]] <= F.lit(rules["threshold"])
    return F.when(goes_left, tree_column(rules["left"], values)).otherwise(
        tree_column(rules["right"], values)
    )
