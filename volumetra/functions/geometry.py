"""Affine maps and boxes as Column expressions.

An affine map is an ARRAY<DOUBLE> of 12 numbers, row by row. A box has inclusive bounds x0..x1, y0..y1, z0..z1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def affine(values) -> Column:
    """A constant map."""
    return F.array(*[F.lit(float(v)) for v in values])


def apply(m: Column, point: tuple[Column, Column, Column]) -> list[Column]:
    """The mapped point, one column per axis."""
    return [sum((m[4 * r + c] * point[c] for c in range(3)), m[4 * r + 3]) for r in range(3)]


def compose(outer: Column, inner: Column) -> Column:
    """outer after inner."""
    cells = []
    for r in range(3):
        for c in range(4):
            cell = sum((outer[4 * r + k] * inner[4 * k + c] for k in range(1, 3)), outer[4 * r] * inner[c])
            cells.append(cell + outer[4 * r + 3] if c == 3 else cell)
    return F.array(*cells)


def compose_list(maps: Column) -> Column:
    """The product of an ordered list of maps whose head is applied last."""
    return F.aggregate(maps, affine(IDENTITY), lambda done, m: compose(done, m))


def invert(m: Column) -> Column:
    """The inverse map; null where there is none."""
    a = lambda r, c: m[4 * r + c]
    cof = lambda r, c: a((r + 1) % 3, (c + 1) % 3) * a((r + 2) % 3, (c + 2) % 3) - a((r + 1) % 3, (c + 2) % 3) * a((r + 2) % 3, (c + 1) % 3)
    det = a(0, 0) * cof(0, 0) + a(0, 1) * cof(0, 1) + a(0, 2) * cof(0, 2)
    cells = []
    for r in range(3):
        row = [cof(c, r) / det for c in range(3)]
        cells += [*row, -(row[0] * a(0, 3) + row[1] * a(1, 3) + row[2] * a(2, 3))]
    return F.when(det != 0, F.array(*cells))


def step_sizes(m: Column) -> list[Column]:
    """How far a step of one along each source axis goes: the norms of the map's columns."""
    return [F.sqrt(m[c] * m[c] + m[4 + c] * m[4 + c] + m[8 + c] * m[8 + c]) for c in range(3)]


def bounds(m: Column, low: list[Column], high: list[Column]) -> tuple[list[Column], list[Column]]:
    """Real bounds of the mapped box."""
    lo = [sum((F.least(m[4 * r + c] * low[c], m[4 * r + c] * high[c]) for c in range(3)), m[4 * r + 3]) for r in range(3)]
    hi = [sum((F.greatest(m[4 * r + c] * low[c], m[4 * r + c] * high[c]) for c in range(3)), m[4 * r + 3]) for r in range(3)]
    return lo, hi


def containing_box(m: Column, low: list[Column], high: list[Column]) -> tuple[list[Column], list[Column]]:
    """The smallest whole-number box around the mapped box."""
    lo, hi = bounds(m, low, high)
    return [F.floor(c).cast("long") for c in lo], [F.ceil(c).cast("long") for c in hi]


def anisotropy_box(low: Column, high: Column, factor: float) -> tuple[Column, Column]:
    """The z range of a box once z is divided by the anisotropy factor."""
    return F.floor(low / F.lit(factor)).cast("long"), F.ceil(high / F.lit(factor)).cast("long")


def overlap(a: str = "", b: str = "_b", axes: tuple[str, ...] = AXES, expand: int = 0) -> Column:
    """Whether two boxes (columns with the suffixes a and b) share a cell, the first expanded on every side."""
    tests = [(F.col(f"{x}0{a}") - expand <= F.col(f"{x}1{b}")) & (F.col(f"{x}1{a}") + expand >= F.col(f"{x}0{b}")) for x in axes]
    return _all(tests)


def contains(point: tuple[str, ...] = AXES, box: str = "", axes: tuple[str, ...] = AXES) -> Column:
    """Whether the box holds the point."""
    return _all([F.col(p).between(F.col(f"{x}0{box}"), F.col(f"{x}1{box}")) for p, x in zip(point, axes, strict=True)])


def intersection(a: str = "", b: str = "_b", axes: tuple[str, ...] = AXES) -> list[Column]:
    """i0 and i1 columns of the intersection for each axis; empty if some i1 < i0."""
    out = []
    for x in axes:
        out += [F.greatest(F.col(f"{x}0{a}"), F.col(f"{x}0{b}")).alias(f"i{x}0"), F.least(F.col(f"{x}1{a}"), F.col(f"{x}1{b}")).alias(f"i{x}1")]
    return out


def volume(prefix: str = "", axes: tuple[str, ...] = AXES) -> Column:
    """Cells of a box."""
    out = F.lit(1).cast("long")
    for x in axes:
        out = out * (F.col(f"{prefix}{x}1") - F.col(f"{prefix}{x}0") + 1)
    return out


def round_up(value: Column, step: int) -> Column:
    """The smallest multiple of ``step`` that is not below the value."""
    return (F.ceil(value / F.lit(step)) * step).cast("long")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def registration_hash(*maps: Column) -> Column:
    """Names the maps a link was computed with."""
    return F.xxhash64(*maps)


def boxes_meet(m: Column, lo: list[Column], hi: list[Column], other_lo: list[Column], other_hi: list[Column]) -> Column:
    """Whether the box lo..hi, taken by the map m, meets the box other_lo..other_hi: no axis separates them, of the faces of
    either and of all pairs of their edges. Touching boxes meet."""
    middle, other = ([(a + b) / 2 for a, b in zip(*x, strict=True)] for x in ((lo, hi), (other_lo, other_hi)))
    half = [(b - a) / 2 for a, b in zip(other_lo, other_hi, strict=True)]
    away = [a - b for a, b in zip(apply(m, middle), other, strict=True)]
    # Edges of the mapped box, from its middle to a face.
    edges = [[m[4 * r + c] * (hi[c] - lo[c]) / 2 for r in range(3)] for c in range(3)]
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    cross = lambda a, b: [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]
    unit = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    axes = [*unit, *[cross(edges[i], edges[(i + 1) % 3]) for i in range(3)], *[cross(u, e) for u in unit for e in edges]]
    met = F.lit(True)
    for axis in axes:
        reach = sum((F.abs(dot(axis, e)) for e in edges), sum((F.abs(a) * h for a, h in zip(axis, half, strict=True)), F.lit(0.0)))
        met = met & (F.abs(dot(axis, away)) <= reach * (1 + 1e-9) + 1e-9)
    return met
