"""Which features to keep: filters in a fixed order, a reason for every exclusion."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidecast.operators import information, profile

log = logging.getLogger(__name__)


def above_noise(ranking: Sequence[tuple[str, float]], baseline: float) -> tuple[list[str], float, bool]:
    """Features above the noise baseline; it is halved when nothing survives.

    If even that leaves nothing, the best feature stays, so the result is never
    empty.  Returns the features, the threshold used and whether it was loosened.
    """
    for threshold, loosened in ((baseline, False), (baseline * 0.5, True)):
        kept = [f for f, mi in ranking if mi > threshold]
        if kept:
            if loosened:
                log.warning("no feature above the noise baseline; threshold halved to %s", threshold)
            return kept, threshold, loosened
    log.warning("no feature above half the noise baseline; keeping the best one")
    best = max(ranking, key=lambda s: (s[1], s[0]), default=None)
    return ([best[0]] if best else []), baseline * 0.5, True


def redundant(pairs: Sequence[tuple[str, str, float]], mi: dict[str, float]) -> dict[str, str]:
    """For every strongly correlated pair, the feature that says less about the target."""
    flagged: dict[str, str] = {}
    for a, b, r in pairs:
        if r is not None and abs(r) >= profile.REDUNDANT_CORRELATION:
            weaker, kept = sorted((a, b), key=lambda f: (round(mi.get(f, 0.0), 6), f))
            flagged.setdefault(weaker, kept)
    return flagged


@dataclass
class Screening:
    recommended: list[str]
    excluded: list[tuple[str, str, int]]
    mi: dict[str, float]
    noise_baseline: float
    loosened: bool
    stage_counts: list[tuple[int, str, int]]

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(f, None, "recommended") for f in self.recommended]
        rows += [(f, reason, "excluded") for f, reason, _ in self.excluded]
        return df.sparkSession.createDataFrame(rows, "feature string, reason string, status string")

    def stages(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            self.stage_counts, "stage_no int, reason string, dropped int"
        )


# Share of the most that bins can say about the target; more than this is a copy in disguise.
HIGH_INFORMATION = 0.95

# Reasons in the order they are decided; the first one wins.
STAGES = ["low_variance", "high_cardinality", "leakage_suspect", "below_noise_baseline", "redundant"]


def screen_features(
    df: DataFrame, target: str, key: Column, features: Sequence[str] | None = None,
    text: Sequence[str] = (), exact: bool = False,
) -> Screening:
    """Run all filters.  Work on rows is three aggregates; the rest is per column."""
    numeric = list(features or [c for c in profile.numeric_columns(df) if c != target])
    reasons: dict[str, str] = {}
    for row in profile.low_variance(df, numeric).where("low_variance").collect():
        reasons[row["column"]] = STAGES[0]
    if text:
        for row in profile.high_cardinality(df, list(text), exact).where("high_cardinality").collect():
            reasons.setdefault(row["column"], STAGES[1])
    for row in profile.target_correlations(df, numeric, target).where("leakage_suspect").collect():
        reasons.setdefault(row["feature"], STAGES[2])
    ranking, baseline = information.information_ranking(df, numeric, target, key)
    mi = {row["feature"]: row["mi_score"] for row in ranking.collect()}
    for f in numeric:
        if (mi.get(f) or 0.0) >= HIGH_INFORMATION * math.log(information.BINS):
            reasons.setdefault(f, STAGES[2])
    open_to_noise = [(f, mi[f]) for f in numeric if f not in reasons]
    kept, _, loosened = above_noise(open_to_noise, baseline)
    for f, _ in open_to_noise:
        if f not in kept:
            reasons[f] = STAGES[3]
    if len(kept) > 1:
        pairs = [tuple(p) for p in profile.correlation_pairs(df, kept).collect()]
        for f in redundant(pairs, mi):
            reasons[f] = STAGES[4]
    excluded = [(f, r, STAGES.index(r) + 1) for f, r in sorted(reasons.items())]
    counts = [(i + 1, s, sum(r == s for r in reasons.values())) for i, s in enumerate(STAGES)]
    for _, stage, dropped in counts:
        log.info("%s: %d features dropped", stage, dropped)
    return Screening([f for f in numeric if f not in reasons], excluded, mi, baseline, loosened, counts)


def relaxed_screening(df: DataFrame, found: Screening, share: float = 0.5) -> Screening:
    """A second pass with ``share`` of the noise baseline, for runs whose features said too little.

    Features that only the baseline kept out come back if they say more than
    that share of it, unless they repeat a feature that says more.  What other
    filters excluded stays out.  Information is not measured again.
    """
    threshold = found.noise_baseline * share
    back = [f for f, reason, _ in found.excluded if reason == STAGES[3] and (found.mi.get(f) or 0.0) > threshold]
    pool = [*found.recommended, *back]
    reasons = {f: reason for f, reason, _ in found.excluded if f not in back}
    if back and len(pool) > 1:
        pairs = [tuple(p) for p in profile.correlation_pairs(df, pool).collect()]
        reasons |= {f: STAGES[4] for f in redundant(pairs, found.mi) if f in back}
    excluded = [(f, r, STAGES.index(r) + 1) for f, r in sorted(reasons.items())]
    counts = [(i + 1, s, sum(r == s for r in reasons.values())) for i, s in enumerate(STAGES)]
    return Screening([f for f in pool if f not in reasons], excluded, found.mi, found.noise_baseline, bool(back) or found.loosened, counts)
