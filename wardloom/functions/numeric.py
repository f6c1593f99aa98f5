"""Vector, logit and error helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(logits: Column, top: Column) -> Column:
    return F.transform(logits, lambda x: F.exp(x.cast("double") - top))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda done, x: done + x)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the maximum."""
    return _let(
        F.array_max(logits).cast("double"),
        lambda top: _let(
            _shifted(logits, top),
            lambda weights: _let(_total(weights), lambda total: F.transform(weights, lambda x: x / total)),
        ),
    )


def class_probability(logits: Column, index: int = 1) -> Column:
    """Softmax probability of one class."""
    return _let(
        F.array_max(logits).cast("double"),
        lambda top: _let(
            _shifted(logits, top), lambda weights: F.get(weights, F.lit(index)) / _total(weights)
        ),
    )


def argmax(values: Column) -> Column:
    """0-based position of the largest value; the first one wins."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def over_threshold(probability: Column, limit: float = 0.5) -> Column:
    """1 when strictly above the limit."""
    return (probability > F.lit(limit)).cast("int")


def first_vector(sequence: Column) -> Column:
    """First vector of a sequence of vectors, null for an empty sequence."""
    return F.try_element_at(sequence, F.lit(1))


def residual(actual: Column, predicted: Column) -> Column:
    return predicted - actual


def percent(share: Column) -> Column:
    return share * 100
