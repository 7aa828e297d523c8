"""Second looks at a run: stress test of scores too good to be true, expansion of poor ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidecast.operators import metrics, training
from tidecast.operators.features import Feature
from tidecast.operators.leakage import CONFIRMED_R2
from tidecast.operators.split import Fold

# What an expansion round tries.
EXPANSION = ["elastic_net", "hist_gradient_boosting", "rbf_kernel"]


def stress_test(
    train: DataFrame, holdout: DataFrame, features: Sequence[str], plan: Sequence[Feature],
    candidate: str = "ridge", best_r2: float | None = None, known: Sequence[str] = (),
) -> tuple[DataFrame, bool]:
    """Refit without target-derived features, without rolling ones, and probe what is target-derived.

    Runs when the best R2 is above 0.98.  The target counts as leaked when a
    straight line through target-derived features rebuilds it, or when the rest
    alone scores too well.
    """
    schema = "probe string, features int, r2 double, status string"
    spark = train.sparkSession
    if best_r2 is not None and best_r2 <= metrics.TOO_PERFECT:
        return spark.createDataFrame([("not triggered", len(features), best_r2, "pass")], schema), False
    tags = {f.name: f.tags for f in plan}
    derived = [f for f in features if "target" in tags.get(f, ("target",)) and f not in known]
    rolling = [f for f in features if "rolling" in tags.get(f, ())]
    sets = {
        "without target-derived": ([f for f in features if f not in derived], candidate, metrics.TOO_PERFECT),
        "without rolling": ([f for f in features if f not in rolling], candidate, None),
        "target-derived only, linear": (derived, "ridge", CONFIRMED_R2),
    }
    rows, leaked = [], False
    for probe, (used, name, limit) in sets.items():
        if not used:
            rows.append((probe, 0, None, "pass"))
            continue
        params = {"regParam": 0.0} if name == "ridge" else training.parameter_sets(training.CANDIDATES[name].grid)[0]
        model = training.fit(training.CANDIDATES[name], train, used, params)
        r2 = training.score(model, holdout)["r2"]
        bad = limit is not None and r2 is not None and r2 > limit
        leaked |= bad
        rows.append((probe, len(used), r2, "leak" if bad else "pass"))
    return spark.createDataFrame(rows, schema), leaked


def expansion_round(
    trained: training.Trained, train: DataFrame, holdout: DataFrame, features: list[str],
    folds: Sequence[Fold], relaxed_features: list[str] | None = None, search: bool = True,
) -> tuple[training.Trained, str]:
    """Train the expansion set under the same split and grade the run again.

    ``relaxed_features`` replaces the features when the first set said nothing
    about the target.
    """
    more = training.train_candidates(train, holdout, relaxed_features or features, EXPANSION, folds, search)
    trained.fold_rows += more.fold_rows
    trained.results += more.results
    trained.models |= more.models
    trained.skipped += more.skipped
    best = max((r[4] for r in trained.results if r[4] is not None), default=None)
    if best is None or best < metrics.MARGINAL:
        return trained, "subpar_after_expansion"
    return trained, "acceptable" if best >= metrics.ACCEPTABLE else "marginal"
