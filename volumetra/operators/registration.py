"""Jobs over image chunks, points and pairs: detection, stitching, matching, intensities, fusion.

Each job is one plan: range joins bring the chunks (cut to what is needed) or points of a block or pair together, a
numpy kernel runs on each group, and what it finds stays distributed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.operators import coefficients, spatial
from volumetra.operators.consensus import large_models, link_moments, sigma_points
from volumetra.operators.graph import stored
from volumetra.operators.kernels import deformation, detection, intensities, matching, models, solving, stitching
from volumetra.sources import chunks as ch

POINTS = "tp int, setup long, x double, y double, z double, intensity double"


def _spread(parts: Iterator[pd.DataFrame], wanted: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of a chunk joined to a box c{x}0..c{x}1 (in the chunk's image), cut to that box."""
    for pdf in parts:
        rows = []
        for r in pdf.itertuples(index=False):
            o, s = (r.ox, r.oy, r.oz), (r.sx, r.sy, r.sz)
            lo = [max(a, b) for a, b in zip(o, (r.cx0, r.cy0, r.cz0), strict=True)]
            hi = [min(a + n - 1, b) for a, n, b in zip(o, s, (r.cx1, r.cy1, r.cz1), strict=True)]
            if any(b < a for a, b in zip(lo, hi, strict=True)):
                continue
            a = ch.decode(r.payload, r.dtype, s)[tuple(slice(p - x, q - x + 1) for p, q, x in zip(lo, hi, o, strict=True))]
            rows.append([getattr(r, c) for c in wanted] + [*lo, *a.shape, r.dtype, np.ascontiguousarray(a).tobytes()])
        yield pd.DataFrame(rows, columns=[*wanted, "px", "py", "pz", "mx", "my", "mz", "dtype", "payload"])


PART = "px long, py long, pz long, mx long, my long, mz long, dtype string, payload binary"
PARTS = [c.split()[0] for c in PART.split(", ")]
#: Voxels of a block of detection: its halo adds about two fifths, and a task holds a few arrays of 40 MB.
DETECTION_BLOCK = (192, 192, 96)


def _assemble(pdf: pd.DataFrame, within: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, list[int]]:
    """The array made of the parts, and where it starts; voxels of missing chunks are 0. ``within`` gives its first and last
    voxels, else it holds just the parts; rows without payload are no parts."""
    pdf = pdf[pdf["payload"].notna()].astype({f"{c}{x}": "int64" for c in "pm" for x in "xyz"})
    lo = within[0] if within else [int(pdf[f"p{x}"].min()) for x in "xyz"]
    hi = [v + 1 for v in within[1]] if within else [int((pdf[f"p{x}"] + pdf[f"m{x}"]).max()) for x in "xyz"]
    a = np.zeros([h - o for h, o in zip(hi, lo, strict=True)])
    for r in pdf.itertuples(index=False):
        at = tuple(slice(p - o, p - o + m) for p, o, m in zip((r.px, r.py, r.pz), lo, (r.mx, r.my, r.mz), strict=True))
        a[at] = ch.decode(r.payload, r.dtype, (r.mx, r.my, r.mz))
    return a, lo


def _needed(r) -> tuple[list[int], list[int]]:
    """First and last voxels of an image (nx, ny, nz) in the box c{x}0..c{x}1."""
    return [max(0, int(r[f"c{x}0"])) for x in "xyz"], [min(int(r[f"n{x}"]) - 1, int(r[f"c{x}1"])) for x in "xyz"]


def _with_empty(parts: DataFrame, met: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The parts and a row without payload for every block and view, so that a view counts where its chunks are missing."""
    none = {n: k for n, k in (x.split() for x in PART.split(", "))}
    return parts.unionByName(met.select(*[F.col(c).cast(k) for c, k in keys.items()], *[F.lit(None).cast(k).alias(n) for n, k in none.items()]))


def _parts(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    kinds = ", ".join(f"{k} {v}" for k, v in wanted.items())
    return df.mapInPandas(lambda p: _spread(p, list(wanted)), f"{kinds}, {PART}")


def detect_points(chunks: DataFrame, sigma: float, threshold: float, low: float, high: float, kind: str = "MAX", localization: str = "QUADRATIC", median: int | None = None, level_factors: tuple[int, int, int] = (1, 1, 1), block: tuple[int, int, int] = DETECTION_BLOCK) -> DataFrame:
    """(tp, setup, x, y, z, intensity) of the blobs of all images, in full-resolution coordinates.

    Images are cut into blocks of a grid. A chunk sends each block what it holds of it and of the slabs of its halo, and the
    block keeps what lies in its own voxels, so that the result does not depend on where chunks end: one shuffle of the
    images and their slabs, no join.
    """
    reach = detection.halo(sigma) + (median or 0)

    def slabs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                o, s = (r.ox, r.oy, r.oz), (r.sx, r.sy, r.sz)
                a = ch.decode(r.payload, r.dtype, s)
                first = [max(0, (p - reach) // b) for p, b in zip(o, block, strict=True)]
                last = [(p + n - 1 + reach) // b for p, n, b in zip(o, s, block, strict=True)]
                for g in itertools.product(*[range(p, q + 1) for p, q in zip(first, last, strict=True)]):
                    lo = [max(p, i * b - reach) for p, i, b in zip(o, g, block, strict=True)]
                    hi = [min(p + n, (i + 1) * b + reach) for p, n, i, b in zip(o, s, g, block, strict=True)]
                    own = all(p < (i + 1) * b and q > i * b for p, q, i, b in zip(lo, hi, g, block, strict=True))
                    part = a[tuple(slice(p - x, q - x) for p, q, x in zip(lo, hi, o, strict=True))]
                    rows.append((r.tp, r.setup, *g, own, *lo, *part.shape, r.dtype, np.ascontiguousarray(part).tobytes()))
            yield pd.DataFrame(rows, columns=["tp", "setup", "bx", "by", "bz", "own", *PARTS])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():
            return pd.DataFrame([], columns=["tp", "setup", "x", "y", "z", "intensity"])
        a, lo = _assemble(pdf)
        if median:
            a = detection.median_ratio(a, median)
        at, values = detection.detect(a, sigma, threshold, low, high, kind, localization)
        at = at + lo
        # The block a voxel belongs to is that of the whole-number extremum nearest to the subpixel place.
        inside = np.ones(len(at), bool)
        for i, b in enumerate(block):
            inside &= np.floor((np.floor(at[:, i] + 0.5)) / b) == key[2 + i]
        at = at[inside] * np.array(level_factors) + (np.array(level_factors) - 1) / 2
        return pd.DataFrame({"tp": key[0], "setup": key[1], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "intensity": values[inside]})

    wanted = chunks.select("tp", "setup", "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")
    cut = wanted.mapInPandas(slabs, f"tp int, setup long, bx int, by int, bz int, own boolean, {PART}")
    return cut.groupBy("tp", "setup", "bx", "by", "bz").applyInPandas(run, POINTS)


def stitch_pairs(pairs: DataFrame, chunks: DataFrame, peaks: int = 5, subpixel: bool = True, max_shift=(None, None, None), cell: int = 256) -> DataFrame:
    """(tp, setup, tp_b, setup_b, dx, dy, dz, r) of pairs of translated views, from what their images show of the overlap.

    ``pairs``: tp, setup, tp_b, setup_b (timepoint 0 where a pair has none), the intersection i{x}0..i{x}1 in world coordinates and each view's translation t{x}, t{x}_b
    (whole numbers at the level of the chunks). Moving the second view by (dx, dy, dz) brings it onto the first.
    """
    pairs = pairs.withColumns({c: F.lit(0) for c in ("tp", "tp_b") if c not in pairs.columns})
    pair = {"tp": "int", "setup": "long", "tp_b": "int", "setup_b": "long"}
    named = [F.col(c).cast(k).alias(f"p_{c}") for c, k in pair.items()]
    sides = []
    for side, shift in ((0, ""), (1, "_b")):
        box = {f"{x}{i}": (F.col(f"i{x}{i}") - F.col(f"t{x}{shift}")).cast("long") for x in "xyz" for i in (0, 1)}
        sides.append(pairs.select(*named, F.lit(side).alias("side"), F.col(f"tp{shift}").alias("tp"), F.col(f"setup{shift}").alias("setup"), *[c.alias(n) for n, c in box.items()]))
    wanted = sides[0].unionByName(sides[1])
    boxed = ch.boxes(chunks).select("tp", "setup", "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    met = spatial.box_join(wanted, boxed, cell, ["tp", "setup"])
    met = met.select(*[f"p_{c}" for c in pair], "side", *[F.col(f"{x}0").alias(f"c{x}0") for x in "xyz"], *[F.col(f"{x}1").alias(f"c{x}1") for x in "xyz"], *[F.col(f"{c}_b").alias(c) for c in ("ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")])
    parts = _parts(met, {**{f"p_{c}": k for c, k in pair.items()}, "side": "int", "cx0": "long", "cy0": "long", "cz0": "long"})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        images, columns = [], [*pair, "dx", "dy", "dz", "r"]
        for side in (0, 1):
            own = pdf[pdf["side"] == side]
            if own.empty:
                return pd.DataFrame([], columns=columns)
            a, lo = _assemble(own)
            images.append((a, np.array(lo) - [own[f"c{x}0"].iat[0] for x in "xyz"]))
        found = stitching.phase_correlation(images[0][0], images[1][0], peaks, subpixel, max_shift)
        if found is None:
            return pd.DataFrame([], columns=columns)
        # Missing chunks at the border make the arrays start later than the intersection does.
        shift = found[0] + images[0][1] - images[1][1]
        return pd.DataFrame([(*key, *shift, found[1])], columns=columns)

    kinds = ", ".join(f"{c} {k}" for c, k in pair.items())
    return parts.groupBy(*[f"p_{c}" for c in pair]).applyInPandas(run, f"{kinds}, dx double, dy double, dz double, r double")


def stitch_rendered(pairs: DataFrame, chunks: DataFrame, factors: tuple[int, int, int] = (1, 1, 1), peaks: int = 5, subpixel: bool = True, max_shift=(None, None, None), cell: int = 256) -> DataFrame:
    """(tp, setup, tp_b, setup_b, dx, dy, dz, r) of pairs of views placed by any affine maps; shifts are in world units.

    ``pairs``: tp, setup, tp_b, setup_b, the intersection i{x}0..i{x}1 of the views' boxes in world coordinates, each view's map
    m from its image at full resolution to the world and its size n{x} there (m_b, n{x}_b); ``chunks``: the images downsampled
    by ``factors``. Both views are sampled on one grid over the intersection, in steps of ``factors``, from just those parts of
    their chunks that it touches; a view is its mean where it shows nothing. ``max_shift`` counts steps. Pairs that share no
    voxel of the grid give no row.
    """
    from volumetra.functions import geometry as g

    pair = {"tp": "int", "setup": "long", "tp_b": "int", "setup_b": "long"}
    step = dict(zip("xyz", factors, strict=True))
    half = {x: (f - 1) / 2 for x, f in step.items()}
    grid = {f"k{x}": F.floor((F.col(f"i{x}1") - F.col(f"i{x}0") + 1) / f).cast("long") for x, f in step.items()}

    def to_level(back):
        """From places of the grid to voxels of the downsampled image; ``back`` maps the world to the image."""
        origin = [F.col(f"i{x}0") + half[x] for x in "xyz"]
        cells = []
        for r, x in enumerate("xyz"):
            cells += [back[4 * r + c] * (step[y] / step[x]) for c, y in enumerate("xyz")]
            cells.append((sum((back[4 * r + c] * o for c, o in enumerate(origin)), back[4 * r + 3]) - half[x]) / step[x])
        return F.array(*cells)

    sides = []
    for side, s in ((0, ""), (1, "_b")):
        # Bound variables, so that no map is written out once for each of its uses.
        to = F.transform(F.transform(F.array(F.col(f"m{s}")), g.invert), to_level)[0]
        size = {f"n{x}": F.greatest(F.lit(1), F.floor(F.col(f"n{x}{s}") / f)).cast("long") for x, f in step.items()}
        named = [F.col(c).cast(k).alias(f"p_{c}") for c, k in pair.items()]
        sides.append(pairs.select(*named, F.lit(side).alias("side"), F.col(f"tp{s}").cast("int").alias("tp"), F.col(f"setup{s}").cast("long").alias("setup"), to.alias("to"), *[c.alias(n) for n, c in {**grid, **size}.items()]))
    met = sides[0].unionByName(sides[1]).filter("least(kx, ky, kz) > 0")

    def touched(to):
        """First and last voxels of the image that the grid touches."""
        lo, hi = g.bounds(to, [F.lit(0.0)] * 3, [(F.col(f"k{x}") - 1).cast("double") for x in "xyz"])
        first, last = [F.greatest(F.floor(a), F.lit(0)) for a in lo], [F.least(F.floor(b) + 1, F.col(f"n{x}") - 1) for b, x in zip(hi, "xyz", strict=True)]
        return F.array(*[c.cast("long") for c in (*first, *last)])

    met = met.withColumn("box", F.transform(F.array("to"), touched)[0])
    need = {f"c{x}{i}": F.col("box")[3 * i + a] for a, x in enumerate("xyz") for i in (0, 1)}
    met = met.withColumns(need)
    keys = {**{f"p_{c}": k for c, k in pair.items()}, "side": "int", "to": "array<double>", **{f"{n}{x}": "long" for n in "kn" for x in "xyz"}, **{f"c{x}{i}": "long" for x in "xyz" for i in (0, 1)}}
    in_image = met.select(*met.columns, *[F.col(f"c{x}{i}").alias(f"{x}{i}") for x in "xyz" for i in (0, 1)])
    boxed = ch.boxes(chunks).select("tp", "setup", "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    pieces = spatial.box_join(in_image, boxed, cell, ["tp", "setup"]).select(*keys, *[F.col(f"{c}_b").alias(c) for c in ("ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")])
    parts = _with_empty(_parts(pieces, keys), met, keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=[*pair, "dx", "dy", "dz", "r"])
        images, seen = [], []
        for side in (0, 1):
            own = pdf[pdf["side"] == side]
            r = own.iloc[0]
            lowest, highest = _needed(r)
            if any(q < p for p, q in zip(lowest, highest, strict=True)):
                return none
            shape = [int(r[f"k{x}"]) for x in "xyz"]
            size = np.array([r["nx"], r["ny"], r["nz"]], float)
            a, start = _assemble(own, (lowest, highest))
            to = np.array(r["to"], float).reshape(3, 4)
            image, inside = np.zeros(shape), np.zeros(shape, bool)
            plane = np.stack(np.meshgrid(*[np.arange(n, dtype=float) for n in shape[:2]], indexing="ij"), axis=-1).reshape(-1, 2)
            for z in range(shape[2]):  # plane by plane, so that places take little memory
                p = models.apply(to, np.column_stack([plane, np.full(len(plane), float(z))]))
                shows = ((p >= -0.5 - 1e-9) & (p <= size - 0.5 + 1e-9)).all(axis=1)
                values = np.zeros(len(p))
                values[shows] = detection.sample(a, p[shows] - start)
                image[:, :, z], inside[:, :, z] = values.reshape(shape[:2]), shows.reshape(shape[:2])
            images.append(image)
            seen.append(inside)
        both = seen[0] & seen[1]
        if not both.any():
            return none
        cut = []
        for axis in range(3):
            at = np.flatnonzero(both.any(axis=tuple(i for i in range(3) if i != axis)))
            cut.append(slice(at[0], at[-1] + 1))
        a, b = (np.where(own[tuple(cut)], image[tuple(cut)], image[tuple(cut)][own[tuple(cut)]].mean()) for image, own in zip(images, seen, strict=True))
        found = stitching.phase_correlation(a, b, peaks, subpixel, max_shift)
        if found is None:
            return none
        return pd.DataFrame([(*key, *(found[0] * np.array(factors)), found[1])], columns=none.columns)

    kinds = ", ".join(f"{c} {k}" for c, k in pair.items())
    return parts.groupBy(*[f"p_{c}" for c in pair]).applyInPandas(run, f"{kinds}, dx double, dy double, dz double, r double")


def combined_views(chunks: DataFrame, members: DataFrame, how: str) -> DataFrame:
    """Chunks of groups of views as those of one view each: the mean of the group's images (AVERAGE), or those of the view
    with the brightest mean (PICK_BRIGHTEST).

    ``members``: tp, setup and leader, the setup that the group's chunks get; images of a group have the same chunks.
    """
    named = chunks.join(members, ["tp", "setup"])
    if how == "PICK_BRIGHTEST":
        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame([(r.tp, r.setup, r.leader, float(a.sum(dtype=float)), a.size) for r in pdf.itertuples(index=False) for a in [ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz))]], columns=["tp", "setup", "leader", "total", "n"])

        means = named.mapInPandas(sums, "tp int, setup long, leader long, total double, n long").groupBy("tp", "leader", "setup").agg((F.sum("total") / F.sum("n")).alias("mean"))
        best = means.groupBy("tp", "leader").agg(F.max_by("setup", F.struct("mean", -F.col("setup"))).alias("setup"))
        return named.join(best, ["tp", "leader", "setup"]).withColumn("setup", F.col("leader")).select(*ch.NAMES)
    if how != "AVERAGE":
        raise ValueError("groups are combined by AVERAGE or PICK_BRIGHTEST")

    def mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.sort_values("setup").iloc[0]
        total = sum(ch.decode(r.payload, r.dtype, (r.sx, r.sy, r.sz)).astype(float) for r in pdf.itertuples(index=False))
        row = {c: first[c] for c in ch.NAMES} | {"setup": key[1], "payload": ch.encode(total / len(pdf), first["dtype"])}
        return pd.DataFrame([row], columns=ch.NAMES)

    return named.groupBy("tp", "leader", "level", "gx", "gy", "gz").applyInPandas(mean, ch.SCHEMA)


MATCHES = "setup long, setup_b long, consensus int, id long, id_b long, x double, y double, z double, x_b double, y_b double, z_b double, model array<double>"


def match_points(pairs: DataFrame, points: DataFrame, method: str = "FAST_ROTATION", tasks: int | None = None, **options) -> DataFrame:
    """Corresponding points of each pair (setup, setup_b) of views; ``points`` has setup, id, x, y, z in world coordinates.

    Every pair gets its views' points: its size is that of two views, whatever the project's. ``tasks``: deal the pairs
    over so many tasks, as their cost lies in the kernel and not in their bytes.
    """
    sides = [pairs.select(F.col("setup").alias("pa"), F.col("setup_b").alias("pb"), F.lit(s).alias("side"), F.col(c).alias("setup")) for s, c in ((0, "setup"), (1, "setup_b"))]
    rows = sides[0].unionByName(sides[1]).join(points.select("setup", "id", *[F.col(x).cast("double").alias(x) for x in "xyz"]), "setup")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == s].sort_values("id") for s in (0, 1))
        p, q = a[list("xyz")].to_numpy(float), b[list("xyz")].to_numpy(float)
        if method == "ICP":
            found = matching.closest_points(p, q, **options)
            sets = [found] if found else []
        else:
            sets = matching.match(p, q, method, **options)
        names = [c.split()[0] for c in MATCHES.split(", ")]
        out = [pd.DataFrame([], columns=names)]
        for n, (m, at) in enumerate(sets):
            i, j = np.asarray(at, int).reshape(-1, 2).T
            places = dict(zip(names[5:11], [*p[i].T, *q[j].T], strict=True))
            out.append(pd.DataFrame({"setup": key[0], "setup_b": key[1], "consensus": n, "id": a["id"].to_numpy()[i], "id_b": b["id"].to_numpy()[j], **places, "model": [m.ravel().tolist()] * len(i)}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    rows = rows.repartition(tasks, "pa", "pb") if tasks else rows
    return rows.groupBy("pa", "pb").applyInPandas(run, MATCHES)


def robust_models(candidates: DataFrame, model: str = "AFFINE", multi: bool = False, local: int = 200_000, **options) -> DataFrame:
    """(setup, setup_b, consensus, n, model): consensus models of the candidate pairs (x, y, z to x_b, y_b, z_b) of two views.
    Pairs of more than ``local`` candidates (counted) are solved by passes over all their rows, others in a task each."""
    pair = ["setup", "setup_b"]
    if local < 2**62:  # read up to four times below
        candidates = stored(candidates)
    large = candidates.groupBy(*pair).agg(F.count("*").alias("n")).filter(F.col("n") > local).select(*pair)
    if not large.isEmpty():
        small = robust_models(candidates.join(large, pair, "left_anti"), model, multi, 2**62, **options)
        return small.unionByName(large_models(candidates.join(large, pair, "left_semi"), model, multi, **options))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "z", "x_b", "y_b", "z_b"])
        p, q = pdf[list("xyz")].to_numpy(float), pdf[["x_b", "y_b", "z_b"]].to_numpy(float)
        sets = models.multi_consensus(p, q, model=model, **options) if multi else [x for x in [models.ransac(p, q, model, **options)] if x]
        return pd.DataFrame([(*key, n, int(good.sum()), m.ravel().tolist()) for n, (m, good) in enumerate(sets)], columns=["setup", "setup_b", "consensus", "n", "model"])

    return candidates.groupBy("setup", "setup_b").applyInPandas(run, "setup long, setup_b long, consensus int, n long, model array<double>")


def match_intensities(matches: DataFrame, method: str = "RANSAC", at_least: int = 1000, **options) -> DataFrame:
    """(setup, setup_b, cx, cy, cz, n, scale, offset), with tp and tp_b if there are any: linear relations per pair of views and
    cell, v_b = scale v + offset."""
    kinds = {"tp": "int", "setup": "long", "tp_b": "int", "setup_b": "long", "cx": "long", "cy": "long", "cz": "long"}
    by = [c for c in kinds if c in matches.columns]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "n", "scale", "offset"]
        if len(pdf) < at_least:
            return pd.DataFrame([], columns=cols)
        found = intensities.relation(pdf["v"].to_numpy(float), pdf["v_b"].to_numpy(float), method, **options)
        return pd.DataFrame([(*key, *found)] if found else [], columns=cols)

    return matches.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, scale double, offset double")


def solve_intensities(matches: DataFrame, blend: float = 0.1, iterations: int = 1000, local: int = coefficients.LOCAL) -> DataFrame:
    """(tp, setup, cx, cy, cz, scale, offset), without tp if ``matches`` has none. The second view's cell is (cx_b, cy_b, cz_b),
    or the same where these are not given."""
    kinds = {"tp": "int", "setup": "long", "cx": "int", "cy": "int", "cz": "int"}
    own = [*spatial.view_key(matches), "cx", "cy", "cz"]
    theirs = [f"{c}_b" if f"{c}_b" in matches.columns else c for c in own]
    ends = [F.struct(*[F.col(c).cast(kinds[k]).alias(k) for c, k in zip(names, own, strict=True)]) for names in (own, theirs)]
    rows = matches.select(ends[0].alias("a"), ends[1].alias("b"), F.col("scale").alias("k"), F.col("offset").alias("d"), (F.col("n") / 100).alias("w"))
    return coefficients.solve(rows, blend, iterations, local=local).select("cell.*", "scale", "offset")


def solve_links(links: DataFrame, tiles: list, fixed: set, method: str = "ONE_ROUND_SIMPLE", weak: list | None = None, relative: float = 3.5, absolute: float = 7.0, **options) -> tuple[dict, float]:
    """({tile: 3x4 model}, error) from links (a, b, weight) with lists p and q of matched places in tile coordinates, or with
    their ``link_moments``.

    Links are one row per pair of overlapping views, of fixed size with moments; the optimisation runs on the driver. With
    moments fits are the same as with all places, and errors are those of twelve places of the same spread.
    """
    rows = []
    for r in links.collect():
        if "cov" in links.columns:
            rows.append(solving.Link(r["a"], r["b"], *sigma_points(r["mean"], r["cov"]), r["weight"] * r["n"] / 12))
        else:
            rows.append(solving.Link(r["a"], r["b"], np.array(r["p"], float), np.array(r["q"], float), r["weight"]))
    if method == "ONE_ROUND_SIMPLE":
        return solving.solve(rows, tiles, fixed, **options)
    if method == "ONE_ROUND_ITERATIVE":
        return solving.solve_iteratively(rows, tiles, fixed, relative, absolute, **options)[:2]
    return solving.solve_two_rounds(rows, weak or [], tiles, fixed, simple=method == "TWO_ROUND_SIMPLE", **({} if method == "TWO_ROUND_SIMPLE" else {"relative": relative, "absolute": absolute}), **options)


STRATEGIES = ("AVG", "AVG_BLEND", "MAX_INTENSITY", "LOWEST_VIEWID_WINS", "HIGHEST_VIEWID_WINS", "CLOSEST_PIXEL_WINS")


def fuse_views(blocks: DataFrame, views: DataFrame, chunks: DataFrame, strategy: str = "AVG_BLEND", dtype: str = "FLOAT32", low: float = 0.0, high: float = 1.0, coefficients: DataFrame | None = None, cells: int = 8, masks: bool = False, mask_offset=(0.0, 0.0, 0.0), width: float = 40.0, cell: int = 256) -> DataFrame:
    """Output chunks of affine fusion: blocks without views give no row.

    ``blocks``: world box x0..z1, grid position gx.. and t_index, c_index of their volume; ``views``: tp, setup, world box,
    map m from image to world, image size nx.., t_index, c_index. Each block gets those parts of the views' chunks that
    the interpolation of its voxels touches.
    """
    from volumetra.functions import geometry as g

    volume = ["t_index", "c_index"]
    # Inverses are made below the join, once for each view.
    v = views.select("tp", "setup", *volume, g.invert(F.col("m")).alias("back"), "nx", "ny", "nz", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    met = spatial.box_join(blocks.select(*volume, "gx", "gy", "gz", *[f"{x}{i}" for x in "xyz" for i in (0, 1)]), v, cell, volume, expand=2)
    back = F.col("back_b")
    lo, hi = g.bounds(back, [F.col(f"{x}0") - max(0, o) for x, o in zip("xyz", mask_offset, strict=True)], [F.col(f"{x}1") + max(0, o) for x, o in zip("xyz", mask_offset, strict=True)])
    need = {f"c{x}{i}": (F.floor(a) - 1 if i == 0 else F.ceil(b) + 1).cast("long") for x, a, b in zip("xyz", lo, hi, strict=True) for i in (0, 1)}
    met = met.select(*volume, "gx", "gy", "gz", *[F.col(f"{x}{i}").alias(f"w{x}{i}") for x in "xyz" for i in (0, 1)], F.col("tp_b").alias("tp"), F.col("setup_b").alias("setup"), back.alias("back"), *[F.col(f"n{x}_b").alias(f"n{x}") for x in "xyz"], *[c.alias(n) for n, c in need.items()])
    in_image = met.select(*met.columns, *[F.col(f"c{x}{i}").alias(f"{x}{i}") for x in "xyz" for i in (0, 1)])
    boxed = ch.boxes(chunks).select("tp", "setup", "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    # The mapped block is no box along the axes of a turned view: chunks that only its bounds meet are not sent.
    touched = g.boxes_meet(F.col("back"), *[[F.col(f"w{x}{i}").cast("double") for x in "xyz"] for i in (0, 1)], *[[(F.col(f"{x}{i}_b") + d).cast("double") for x in "xyz"] for i, d in ((0, -1), (1, 1))])
    pieces = spatial.box_join(in_image, boxed, cell, ["tp", "setup"], touched).select(*met.columns, *[F.col(f"{c}_b").alias(c) for c in ("ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")])
    keys = {"t_index": "int", "c_index": "int", "gx": "int", "gy": "int", "gz": "int", **{f"w{x}{i}": "long" for x in "xyz" for i in (0, 1)}, "tp": "int", "setup": "long", "back": "array<double>", "nx": "long", "ny": "long", "nz": "long", **{f"c{x}{i}": "long" for x in "xyz" for i in (0, 1)}}
    cast = pieces.select(*[F.col(c).cast(k) for c, k in keys.items()], "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")
    parts = _with_empty(_parts(cast, keys), met, keys)
    correct = coefficients is not None
    if correct:
        of_view = spatial.view_key(coefficients)
        c = coefficients.groupBy(*of_view).agg(F.collect_list(F.struct("cx", "cy", "cz", "scale", "offset")).alias("correction"))
        parts = parts.join(c, of_view, "left")

    masking, offset = masks, np.array(mask_offset, float)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        w0, w1 = [int(first[f"w{x}0"]) for x in "xyz"], [int(first[f"w{x}1"]) for x in "xyz"]
        shape = [b - a + 1 for a, b in zip(w0, w1, strict=True)]
        at = np.stack(np.meshgrid(*[np.arange(a, b + 1, dtype=float) for a, b in zip(w0, w1, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)
        total, weight = np.zeros(len(at)), np.zeros(len(at))
        out, rank = np.zeros(len(at)), np.full(len(at), np.inf)
        for _, own in sorted(pdf.groupby(["tp", "setup"]), key=lambda x: x[0]):
            r = own.iloc[0]
            back = np.array(r["back"], float).reshape(3, 4)
            p = models.apply(back, at)
            top = np.array([r["nx"], r["ny"], r["nz"]], float) - 1
            if masking:
                step = np.abs(back[:, :3]) @ offset
                out[((p >= -step - 1e-9) & (p <= top + step + 1e-9)).all(axis=1)] = 1
                continue
            inside = ((p >= -1e-9) & (p <= top + 1e-9)).all(axis=1)
            if not inside.any():
                continue
            a, lo = _assemble(own, _needed(r))
            value = np.zeros(len(at))
            value[inside] = detection.sample(a, p[inside] - lo)
            if correct and r["correction"] is not None:
                value = _corrected(value, p, top, r["correction"], cells)
            if strategy == "AVG":
                total, weight = total + np.where(inside, value, 0), weight + inside
            elif strategy == "AVG_BLEND":
                edge = np.minimum(p, top - p)
                b = np.prod((1 - np.cos(np.pi * np.clip((edge + 1) / width, 0, 1))) / 2, axis=1) * inside
                total, weight = total + b * value, weight + b
            elif strategy == "MAX_INTENSITY":
                better = inside & ((rank == np.inf) | (value > out))
                out[better], rank[better] = value[better], 0
            else:
                mine = {"LOWEST_VIEWID_WINS": 0.0, "HIGHEST_VIEWID_WINS": 0.0}.get(strategy)
                mine = ((p - top / 2) ** 2).sum(axis=1) if mine is None else np.zeros(len(at))
                better = inside & ((rank == np.inf) | (strategy == "HIGHEST_VIEWID_WINS") | (mine < rank))
                out[better], rank[better] = value[better], mine[better]
        if strategy in ("AVG", "AVG_BLEND") and not masking:
            out = np.where(weight > 0, total / np.maximum(weight, 1e-12), 0)
        full = {"UINT8": 255, "UINT16": 65535}.get(dtype)
        if full:
            out = out * full if masking else np.clip((out - low) / (high - low), 0, 1) * full
        names = ["t_index", "c_index", *ch.NAMES[2:]]
        return pd.DataFrame([(*key[:2], 0, *key[2:], *w0, *shape, dtype, ch.encode(out.reshape(shape), dtype))], columns=names)

    schema = ch.SCHEMA.replace("tp int, setup long", "t_index int, c_index int")
    return parts.groupBy("t_index", "c_index", "gx", "gy", "gz").applyInPandas(run, schema)


def _corrected(value: np.ndarray, p: np.ndarray, top: np.ndarray, correction, cells: int) -> np.ndarray:
    """Values with linear coefficients interpolated between the centres of the cells they are given for."""
    grid = {"scale": np.ones((cells,) * 3), "offset": np.zeros((cells,) * 3)}
    for c in correction:
        at = (c["cx"], c["cy"], c["cz"])
        if max(at) < cells:
            grid["scale"][at], grid["offset"][at] = c["scale"], c["offset"]
    where = np.clip(p / (top + 1) * cells - 0.5, 0, cells - 1)
    return detection.sample(grid["scale"], where) * value + detection.sample(grid["offset"], where)


def fuse_nonrigid(blocks: DataFrame, views: DataFrame, chunks: DataFrame, points: DataFrame, spacing: float = 10.0, alpha: float = 1.0, dtype: str = "FLOAT32", low: float = 0.0, high: float = 1.0, cell: int = 256, near: int = 50) -> DataFrame:
    """Output chunks of non-rigid fusion. ``points``: the view (tp, setup; or setup alone) and corresponding places in the
    world, own (x, y, z) after the view's map and common (cx, cy, cz); views are looked up within ``near`` of a block.

    Blocks and views are of a volume (t_index, c_index), and only views of its volume go into a block; without these
    columns they are of volume (0, 0)."""
    from volumetra.functions import geometry as g

    volume = ["t_index", "c_index"]
    blocks, views = (t.withColumns({c: F.lit(0) for c in volume if c not in t.columns}) for t in (blocks, views))
    b = blocks.select(*volume, "gx", "gy", "gz", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    v = views.select("tp", "setup", *volume, "m", g.invert(F.col("m")).alias("back"), "nx", "ny", "nz", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    met = spatial.box_join(b, v, cell, volume, expand=near)
    back = F.col("back_b")
    lo, hi = g.bounds(back, [F.col(f"{x}0") - near for x in "xyz"], [F.col(f"{x}1") + near for x in "xyz"])
    need = {f"c{x}{i}": (F.floor(a) if i == 0 else F.ceil(c)).cast("long") for x, a, c in zip("xyz", lo, hi, strict=True) for i in (0, 1)}
    met = met.select(*volume, "gx", "gy", "gz", *[F.col(f"{x}{i}").alias(f"w{x}{i}") for x in "xyz" for i in (0, 1)], F.col("tp_b").alias("tp"), F.col("setup_b").alias("setup"), F.col("m_b").alias("m"), *[F.col(f"n{x}_b").alias(f"n{x}") for x in "xyz"], *[c.alias(n) for n, c in need.items()])
    in_image = met.select(*met.columns, *[F.col(f"c{x}{i}").alias(f"{x}{i}") for x in "xyz" for i in (0, 1)])
    boxed = ch.boxes(chunks).select("tp", "setup", "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload", *[f"{x}{i}" for x in "xyz" for i in (0, 1)])
    pieces = spatial.box_join(in_image, boxed, cell, ["tp", "setup"]).select(*met.columns, *[F.col(f"{c}_b").alias(c) for c in ("ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")])
    keys = {"t_index": "int", "c_index": "int", "gx": "int", "gy": "int", "gz": "int", **{f"w{x}{i}": "long" for x in "xyz" for i in (0, 1)}, "tp": "int", "setup": "long", "m": "array<double>", "nx": "long", "ny": "long", "nz": "long", **{f"c{x}{i}": "long" for x in "xyz" for i in (0, 1)}}
    cast = pieces.select(*[F.col(c).cast(k) for c, k in keys.items()], "ox", "oy", "oz", "sx", "sy", "sz", "dtype", "payload")
    of_view = spatial.view_key(points)
    lists = points.groupBy(*of_view).agg(F.sort_array(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("x", "y", "z", "cx", "cy", "cz")]))).alias("pts"))
    parts = _with_empty(_parts(cast, keys), met, keys).join(lists, of_view, "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        w0, w1 = [int(first[f"w{x}0"]) for x in "xyz"], [int(first[f"w{x}1"]) for x in "xyz"]
        images = []
        for _, own in sorted(pdf.groupby(["tp", "setup"]), key=lambda x: x[0]):
            r = own.iloc[0]
            lowest, highest = _needed(r)
            if any(q < p for p, q in zip(lowest, highest, strict=True)):
                continue
            a, start = _assemble(own, (lowest, highest))
            m = np.array(r["m"], float).reshape(3, 4)
            inverse = np.column_stack([np.linalg.inv(m[:, :3]), -np.linalg.inv(m[:, :3]) @ m[:, 3]])
            pts = np.array([list(p) for p in r["pts"]], float) if r["pts"] is not None else np.zeros((0, 6))
            corner = np.array([[0, 0, 0], [r["nx"] - 1, 0, 0], [0, r["ny"] - 1, 0], [0, 0, r["nz"] - 1]], float)
            mine, common = pts[:, :3], pts[:, 3:]
            if not len(pts):  # no deformation known: the view's map alone
                mine = common = models.apply(m, corner)
            images.append({"array": a, "own": models.apply(inverse, mine) - start, "common": common})
        if not images:
            return pd.DataFrame([], columns=["t_index", "c_index", *ch.NAMES[2:]])
        out = deformation.fuse_block(images, w0, w1, spacing, alpha)
        full = {"UINT8": 255, "UINT16": 65535}.get(dtype)
        if full:
            out = np.clip((out - low) / (high - low), 0, 1) * full
        shape = [q - p + 1 for p, q in zip(w0, w1, strict=True)]
        return pd.DataFrame([(*key[:2], 0, *key[2:], *w0, *shape, dtype, ch.encode(out, dtype))], columns=["t_index", "c_index", *ch.NAMES[2:]])

    schema = ch.SCHEMA.replace("tp int, setup long", "t_index int, c_index int")
    return parts.groupBy(*volume, "gx", "gy", "gz").applyInPandas(run, schema)
