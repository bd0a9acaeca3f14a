"""Global optimisation of tile positions: relaxation of all tiles to the matches of their neighbours,
with removal of the worst link, and a second round that places tiles without links by their metadata.

The links of a project are few (pairs of overlapping views), so this runs on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from volumetra.operators.kernels import models


@dataclass
class Link:
    """Matched points of tiles a and b, each in its own tile's coordinates."""

    a: object
    b: object
    p: np.ndarray
    q: np.ndarray
    weight: float = 1.0


def solve(links: list[Link], tiles: list, fixed: set, model: str = "TRANSLATION", regularizer: str = "NONE", blend: float = 0.1, max_error: float = 5.0, iterations: int = 10_000, plateau: int = 200) -> tuple[dict, float]:
    """({tile: model}, mean error). Every round fits each free tile to where its neighbours put the matched points; it
    ends when the error is at most ``max_error`` and has not fallen over ``plateau`` rounds, or after ``iterations``."""
    m = {t: models.identity() for t in tiles}
    by: dict = {t: [] for t in tiles}
    for link in links:
        by[link.a].append((link.p, link.b, link.q, link.weight))
        by[link.b].append((link.q, link.a, link.p, link.weight))
    order = _from_fixed(tiles, fixed, by)
    history: list[float] = []
    for _ in range(iterations):
        for t in order:
            if t in fixed or not by[t]:
                continue
            p = np.concatenate([own for own, _, _, _ in by[t]])
            q = np.concatenate([models.apply(m[o], other) for _, o, other, _ in by[t]])
            w = np.concatenate([np.full(len(own), weight) for own, _, _, weight in by[t]])
            m[t] = models.fit_regularized(p, q, model, regularizer, blend, w)
        history.append(mean_error(links, m))
        if len(history) > plateau and history[-1] <= max_error and history[-plateau - 1] - history[-1] <= 1e-4 * max(1e-6, history[-1]):
            break
        if history[-1] < 1e-9 or len(history) > 2 * plateau and abs(history[-plateau] - history[-1]) < 1e-9:
            break
    return m, history[-1] if history else 0.0


def _from_fixed(tiles: list, fixed: set, by: dict) -> list:
    """Tiles in the order in which they are reached from the fixed ones, so that the first round already spreads positions."""
    seen, queue = set(), [t for t in tiles if t in fixed]
    for start in [*queue, *tiles]:
        todo = [start]
        while todo:
            t = todo.pop(0)
            if t in seen:
                continue
            seen.add(t)
            todo += [o for _, o, _, _ in by[t] if o not in seen]
    out, done = [], set(t for t in tiles if t in fixed)
    todo = list(done)
    while todo:
        t = todo.pop(0)
        for _, o, _, _ in by[t]:
            if o not in done:
                done.add(o)
                out.append(o)
                todo.append(o)
    return out + [t for t in tiles if t not in done]


def link_error(link: Link, m: dict) -> float:
    return float(np.sqrt(((models.apply(m[link.a], link.p) - models.apply(m[link.b], link.q)) ** 2).sum(axis=1)).mean())


def mean_error(links: list[Link], m: dict) -> float:
    return float(np.mean([link_error(x, m) for x in links])) if links else 0.0


def solve_iteratively(links: list[Link], tiles: list, fixed: set, relative: float = 3.5, absolute: float = 7.0, **options) -> tuple[dict, float, list[Link]]:
    """Solve, drop the link with the largest error while it is above ``absolute`` or ``relative`` times the mean, solve again.

    A link whose loss would cut the graph of the links apart stays.
    """
    links = list(links)
    while True:
        m, error = solve(links, tiles, fixed, **options)
        wrong = sorted(links, key=lambda x: -link_error(x, m))
        limit = lambda x: link_error(x, m) > absolute or link_error(x, m) > relative * max(error, 1e-6) and link_error(x, m) > 1.0
        bad = [x for x in wrong if limit(x) and len(subsets(tiles, [y for y in links if y is not x])) == len(subsets(tiles, links))]
        if not bad:
            return m, error, links
        links = [x for x in links if x is not bad[0]]


def subsets(tiles: list, links: list[Link]) -> list[list]:
    """Tiles connected by links."""
    parent = {t: t for t in tiles}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in links:
        parent[find(x.a)] = find(x.b)
    out: dict = {}
    for t in tiles:
        out.setdefault(find(t), []).append(t)
    return list(out.values())


def solve_two_rounds(links: list[Link], weak: list[Link], tiles: list, fixed: set, simple: bool = True, **options) -> tuple[dict, float]:
    """Solve by the links; then place the connected sets that hold no fixed tile by ``weak`` links (from metadata), each set
    as one body. ``simple`` leaves out the removal of links."""
    thresholds = {k: options.pop(k) for k in ("relative", "absolute") if k in options}
    if simple:
        m, error = solve(links, tiles, fixed, **options)
    else:
        m, error, links = solve_iteratively(links, tiles, fixed, **thresholds, **options)
    groups = subsets(tiles, links)
    body = {t: i for i, ts in enumerate(groups) for t in ts}
    between = [Link(body[x.a], body[x.b], models.apply(m[x.a], x.p), models.apply(m[x.b], x.q), x.weight) for x in weak if body[x.a] != body[x.b]]
    still = {body[t] for t in fixed}
    moved, _ = solve(between, list(range(len(groups))), still, model="TRANSLATION", **{k: v for k, v in options.items() if k in ("max_error", "iterations", "plateau")})
    return {t: models.compose(moved[body[t]], m[t]) for t in tiles}, error
