"""Model checks on changed and on foreign lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sql import texts
from ..functions.textual import Perturbation, perturb
from .classify import LogTypeModel, best_class, predictions, with_probabilities
from .evaluate import robustness_report


def perturbed_scores(sample: DataFrame, model: LogTypeModel, seed: int = 0, rules: Perturbation = Perturbation()) -> DataFrame:
    """Best class and confidence of every line and of its perturbed form, side by side: a line counts as often as it stands."""
    both = sample.selectExpr("label", "line", f"{perturb('line', seed, rules)} AS _changed")
    scored = with_probabilities(with_probabilities(both, "line", model, "_own"), "_changed", model, "_p")
    return scored.selectExpr(
        "label", f"{best_class('_own', model.classes)} AS prediction", "array_max(_own) AS confidence",
        f"{best_class('_p', model.classes)} AS p_prediction", "array_max(_p) AS p_confidence")


def robustness(sample: DataFrame, model: LogTypeModel, seed: int = 0, rules: Perturbation = Perturbation()) -> DataFrame:
    """How accuracy and confidence per label change when the lines are perturbed."""
    return robustness_report(perturbed_scores(sample, model, seed, rules))


def ood_probe(lines: DataFrame, model: LogTypeModel, known=()) -> DataFrame:
    """Best class and confidence of lines in formats the model was not trained on.

    Lines whose ``label`` is one of ``known`` are left out.
    """
    foreign = lines.filter(f"NOT array_contains({texts(known)}, label)") if known else lines
    scored = with_probabilities(foreign.selectExpr("label AS origin", "line"), "line", model)
    return predictions(scored, model.classes)
