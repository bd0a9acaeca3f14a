"""Consensus models of pairs of views with more candidates than one task should hold.

Hypotheses come from a sample of each pair's candidates, whose best ones (``FINALISTS``) are counted over all candidates by a
partial aggregate. The winner is refitted to the moments of all its inliers, one aggregate a round, until no model moves:
rows of a pair stay wherever they lie, and what is joined to them is a few models for each pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.functions import geometry as g
from volumetra.operators import graph
from volumetra.operators.kernels import models

PAIR = ["setup", "setup_b"]
KEY = "setup long, setup_b long"
PLACES = ("x", "y", "z", "x_b", "y_b", "z_b")
#: Candidates of a pair that hypotheses are made from, and hypotheses that are counted over all of its candidates.
SAMPLE, FINALISTS = 4096, 16
#: Models that are broadcast to the candidates: at most 20 MB or so.
BROADCAST_MODELS = 100_000


def link_moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, cov): of the matched places (x, y, z) and (x_b, y_b, z_b) of each link all that a least-squares fit sees."""
    cov = [F.covar_pop(a, b) for i, a in enumerate(PLACES) for b in PLACES[i:]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in PLACES]).alias("mean"), F.array(*cov).alias("cov"))


def sigma_points(mean: list[float], cov: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Twelve pairs of places with this mean and covariance: least-squares fits to them are those to all places."""
    c = np.zeros((6, 6))
    c[np.triu_indices(6)] = cov
    c = c + c.T - np.diag(np.diag(c))
    w, v = np.linalg.eigh(c)
    step = (v * np.sqrt(6 * np.maximum(w, 0))).T
    at = np.concatenate([np.array(mean) + step, np.array(mean) - step])
    return at[:, :3], at[:, 3:]


def _near(m: Column, max_error: float) -> Column:
    """Whether the model takes (x, y, z) to within ``max_error`` of (x_b, y_b, z_b)."""
    away = [a - F.col(f"{x}_b") for x, a in zip("xyz", g.apply(m, (F.col("x"), F.col("y"), F.col("z"))), strict=True)]
    return away[0] * away[0] + away[1] * away[1] + away[2] * away[2] <= max_error**2


def _small(df: DataFrame, each: int = 1) -> DataFrame:
    """A stored table of ``each`` models a row, marked for broadcast if it was counted to be small."""
    df = graph.stored(df)
    return F.broadcast(df) if df.count() * each <= BROADCAST_MODELS else df


def counted(rows: DataFrame, guesses: DataFrame, max_error: float) -> DataFrame:
    """(setup, setup_b, h, n, m): how many rows of its pair each of a pair's models (array ``ms``, h its place there) holds for.

    A row is met once, whatever the number of models: each has a count of its own in the aggregate.
    """
    counts = [F.count_if(_near(F.get("ms", F.lit(h)), max_error)) for h in range(FINALISTS)]
    n = rows.join(guesses, PAIR).groupBy(*PAIR).agg(F.array(*counts).alias("n"))
    each = n.join(guesses, PAIR).select(*PAIR, "n", F.posexplode("ms").alias("h", "m"))
    return each.withColumn("n", F.get("n", F.col("h")))


def sampled(rows: DataFrame, sizes: DataFrame, size: int = SAMPLE, seed: int = 1) -> DataFrame:
    """About ``size`` rows of each pair (all rows of smaller ones), chosen by a hash of ``row``, a key of each row."""
    chance = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(sizes, PAIR).filter(chance * F.col("total") < size).drop("total")


def _consensus(rows: DataFrame, sizes: DataFrame, model: str, regularizer: str, blend: float, iterations: int, max_error: float, min_ratio: float, min_inliers: int, seed: int, sample: int, rounds: int) -> DataFrame:
    """(setup, setup_b, n, m) of the pairs that have a consensus; stored."""
    needed = models.NEEDED[model]

    def hypotheses(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(PLACES))
        p, q = pdf[list("xyz")].to_numpy(float), pdf[["x_b", "y_b", "z_b"]].to_numpy(float)
        rng, found = np.random.default_rng(seed), []
        if len(p) >= needed:
            for _ in range(iterations):
                pick = rng.choice(len(p), needed, replace=False)
                m = models.fit_regularized(p[pick], q[pick], model, regularizer, blend)
                found = sorted([*found, (-int((models.errors(m, p, q) <= max_error).sum()), len(found), m.ravel().tolist())], key=lambda x: x[:2])[:FINALISTS]
        return pd.DataFrame([(*key, [m for _, _, m in found])], columns=[*PAIR, "ms"])

    def fit(parts):
        for pdf in parts:
            out = [models.fit_regularized(*sigma_points(r.mean, r.cov), model, regularizer, blend).ravel().tolist() for r in pdf.itertuples(index=False)]
            yield pdf[[*PAIR, "n"]].assign(m=out)

    guesses = _small(sampled(rows, sizes, sample, seed).groupBy(*PAIR).applyInPandas(hypotheses, f"{KEY}, ms array<array<double>>"), FINALISTS)
    counts = counted(rows, guesses, max_error)
    now = _small(counts.groupBy(*PAIR).agg(F.max_by(F.struct("n", "m"), F.struct("n", -F.col("h"))).alias("best")).select(*PAIR, "best.*").filter(F.col("n") >= max(needed, min_inliers)))
    for _ in range(rounds):
        inliers = rows.join(now.drop("n"), PAIR).filter(_near(F.col("m"), max_error))
        new = _small(link_moments(inliers, PAIR).filter(F.col("n") >= max(needed, min_inliers)).mapInPandas(fit, f"{KEY}, n long, m array<double>"))
        moved = F.exists(F.zip_with("m", "was", lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)
        still = new.join(now.select(*PAIR, F.col("m").alias("was")), PAIR).filter(moved).isEmpty()
        now = new
        if still:
            break
    return graph.stored(now.join(sizes, PAIR).filter(F.col("n") >= F.greatest(F.lit(min_inliers), min_ratio * F.col("total"))).select(*PAIR, "n", "m"))


def large_models(candidates: DataFrame, model: str = "AFFINE", multi: bool = False, regularizer: str = "NONE", blend: float = 0.1, iterations: int = 1000, max_error: float = 5.0, min_ratio: float = 0.1, min_inliers: int = 12, seed: int = 1, sample: int = SAMPLE, rounds: int = 50) -> DataFrame:
    """(setup, setup_b, consensus, n, model) as of ``registration.robust_models``, by passes over all candidates.

    A consensus that is too small to show in a sample of ``sample`` candidates can be missed. ``multi``: further consensus
    sets from what the former left over, all pairs at once. No candidates, or none in reach, give no row.
    """
    rows = candidates.select(*[F.col(c).cast("long").alias(c) for c in PAIR], *[F.col(c).cast("double").alias(c) for c in PLACES])
    rows, k, out = graph.stored(rows.withColumn("row", F.monotonically_increasing_id())), 0, None
    while True:
        sizes = _small(rows.groupBy(*PAIR).agg(F.count("*").alias("total")))
        found = _consensus(rows, sizes, model, regularizer, blend, iterations, max_error, min_ratio, min_inliers, seed, sample, rounds)
        named = found.select(*PAIR, F.lit(k).alias("consensus"), "n", F.col("m").alias("model"))
        out = named if out is None else out.unionByName(named)
        if not multi or found.isEmpty():
            return out
        rows, k = graph.stored(rows.join(_small(found.drop("n")), PAIR).filter(~_near(F.col("m"), max_error)).drop("m")), k + 1
