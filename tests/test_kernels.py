import numpy as np
import pytest

from volumetra.operators.kernels import deformation, detection, intensities, matching, models, solving, stitching

RNG = np.random.default_rng(42)


def rotation(angle, axis=2):
    c, s = np.cos(angle), np.sin(angle)
    i, j = [k for k in range(3) if k != axis]
    m = np.eye(3)
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    return m


def blobs(shape, centres, sigma=2.0):
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), axis=-1)
    return sum(np.exp(-0.5 * ((grid - c) ** 2).sum(axis=-1) / sigma**2) for c in np.asarray(centres)) * 200


def test_detection_finds_blobs():
    centres = np.array([[12.3, 15.6, 10.2], [30.7, 12.1, 14.4], [22.0, 30.4, 12.0]])
    a = blobs((44, 44, 26), centres)
    places, values = detection.detect(a, 1.8, 0.02, 0, 255)
    assert len(places) == 3
    d, i = models.nearest(centres, places)
    assert d.max() < 0.5 and (values > 150).all()
    dark, _ = detection.detect(-a, 1.8, 0.02, 0, 255, "MIN")
    assert np.allclose(np.sort(dark, axis=0), np.sort(places, axis=0))
    assert len(detection.detect(-a, 1.8, 0.02, 0, 255, "BOTH")[0]) >= 3
    rough, _ = detection.detect(a, 1.8, 0.02, 0, 255, localization="NONE")
    assert (rough == np.round(centres[models.nearest(rough, centres)[1][:, 0]])).all()


def test_blocks_with_halo_equal_the_whole():
    a = RNG.normal(size=(40, 32, 30)).cumsum(axis=0)
    h = detection.halo(1.5)
    whole, _ = detection.detect(a, 1.5, 0.01, 0, 10, localization="NONE")
    inside = {tuple(p) for p in whole.astype(int) if 16 <= p[0] < 24}
    lo = 16 - h
    part, _ = detection.detect(a[lo : 24 + h], 1.5, 0.01, 0, 10, localization="NONE")
    assert {tuple(p + np.array([lo, 0, 0])) for p in part.astype(int) if 16 <= p[0] + lo < 24} == inside


def test_small_images():
    assert len(detection.detect(np.ones((2, 2, 1)), 1.8, 0.1, 0, 1)[0]) == 0
    assert detection.halved(np.arange(8.0).reshape(4, 2, 1), (2, 2, 1)).ravel().tolist() == [1.5, 5.5]
    assert detection.median_ratio(np.full((5, 5, 2), 3.0), 1).min() == 1
    assert detection.median_ratio(np.zeros((5, 5, 2)), 1).max() == 0


@pytest.mark.parametrize("shift", [(20, 3, -2), (-17, 5, 1), (0, 22, 0)])
def test_phase_correlation_recovers_the_shift(shift):
    scene = detection.smooth(RNG.normal(size=(90, 90, 30)), 1.5)
    a = scene[30:70, 30:70, 8:22]
    b = scene[30 + shift[0] : 70 + shift[0], 30 + shift[1] : 70 + shift[1], 8 + shift[2] : 22 + shift[2]]
    found, r = stitching.phase_correlation(a, b)
    assert np.abs(found - shift).max() < 0.5 and r > 0.95
    assert stitching.phase_correlation(a, b, max_shift=(1, 1, 1))[1] < 0.9
    assert stitching.phase_correlation(a[:1], b) is None


@pytest.mark.parametrize("model", ["TRANSLATION", "RIGID", "AFFINE"])
def test_models_and_ransac(model):
    m = {"TRANSLATION": np.eye(3), "RIGID": rotation(0.4), "AFFINE": rotation(0.3) @ np.diag([1.1, 0.9, 1.2])}[model]
    truth = np.column_stack([m, [5, -3, 2]])
    p = RNG.uniform(0, 100, (60, 3))
    q = models.apply(truth, p) + RNG.normal(size=(60, 3)) * 0.01
    assert np.abs(models.fit(p, q, model) - truth).max() < 0.05
    q[:25] = RNG.uniform(0, 100, (25, 3))
    found, good = models.ransac(p, q, model, iterations=5000, max_error=1.0)
    assert good[25:].all() and good.sum() <= 37 and np.abs(models.apply(found, p[25:]) - q[25:]).max() < 0.2
    assert models.ransac(p[:8], q[:8], model) is None


def test_regularized_models_and_consensus_sets():
    p = RNG.uniform(0, 50, (80, 3))
    q = p + np.where(np.arange(80)[:, None] < 40, [10, 0, 0], [0, -20, 0])
    sets = models.multi_consensus(p, q, model="TRANSLATION", max_error=0.5, iterations=500)
    assert len(sets) == 2 and all(s.sum() == 40 for _, s in sets)
    half = models.fit_regularized(p, p + 4, "TRANSLATION", "IDENTITY", 0.5)
    assert np.allclose(half[:, 3], 2)


def test_clusters():
    p = np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [10, 0, 0], [10, 0.5, 0]], float)
    assert len(set(models.clusters(p, 1.1))) == 2


@pytest.mark.parametrize("method,m", [("FAST_ROTATION", rotation(0.7)), ("FAST_TRANSLATION", np.eye(3)), ("PRECISE_TRANSLATION", np.eye(3))])
def test_descriptors_match_moved_clouds(method, m):
    p = RNG.uniform(0, 200, (80, 3))
    truth = np.column_stack([m, [12, -7, 4]])
    order = RNG.permutation(80)
    q = np.concatenate([models.apply(truth, p)[order][:65], RNG.uniform(0, 200, (10, 3))])
    [(found, pairs)] = matching.match(p, q, method, redundancy=1, model="RIGID", max_error=2.0, iterations=2000)
    right = sum(order[j] == i for i, j in pairs if j < 65)
    assert len(pairs) >= 20 and right == len(pairs)
    assert np.abs(found - truth).max() < 0.1


def test_closest_points():
    p = RNG.uniform(0, 100, (120, 3))
    truth = np.column_stack([rotation(0.01), [1.0, -0.8, 0.5]])
    q = models.apply(truth, p)[RNG.permutation(120)]
    for use in (False, True):
        found, pairs = matching.closest_points(p, q, "RIGID", max_error=5, use_ransac=use)
        assert len(pairs) > 100 and np.abs(found - truth).max() < 0.01
    assert matching.closest_points(p[:0], q) is None


def grid_links(n=4, wrong=True):
    true = {(i, j): np.array([i * 80.0, j * 80.0, 0]) + RNG.normal(size=3) * 4 for i in range(n) for j in range(n)}
    true[(0, 0)] = np.zeros(3)
    links = []
    for i, j in true:
        for o in ((i + 1, j), (i, j + 1)):
            if o in true:
                world = RNG.uniform(0, 100, (15, 3)) + true[(i, j)]
                links.append(solving.Link((i, j), o, world - true[(i, j)], world - true[o]))
    if wrong:
        links.append(solving.Link((0, 0), (1, 1), links[0].p, links[0].p + 60))
    return true, links


def test_global_solution_and_wrong_link():
    true, links = grid_links()
    tiles = sorted(true)
    m, error, kept = solving.solve_iteratively(links, tiles, {(0, 0)}, model="TRANSLATION")
    assert len(kept) == len(links) - 1 and error < 0.1
    assert max(np.abs(m[t][:, 3] - true[t]).max() for t in tiles) < 0.1


def test_two_rounds_place_unlinked_tiles():
    true, links = grid_links(3, wrong=False)
    tiles = sorted(true)
    lonely = (2, 2)
    linked = [x for x in links if lonely not in (x.a, x.b)]
    weak = [solving.Link((1, 2), lonely, np.array([[80.0, 0, 0]]), np.zeros((1, 3)))]
    m, _ = solving.solve_two_rounds(linked, weak, tiles, {(0, 0)}, model="TRANSLATION")
    assert np.abs(m[lonely][:, 3] - m[(1, 2)][:, 3] - [80, 0, 0]).max() < 1e-6
    assert len(solving.subsets(tiles, linked)) == 2


def test_intensities():
    x = RNG.uniform(0, 200, 300)
    y = 1.3 * x - 12 + RNG.normal(size=300)
    y[:80] = RNG.uniform(0, 255, 80)
    s, o, good = intensities.ransac(x, y)
    assert abs(s - 1.3) < 0.03 and abs(o + 12) < 3 and good[80:].mean() > 0.9
    s, o = intensities.histogram(x, 0.7 * x + 20)
    assert abs(s - 0.7) < 1e-6 and abs(o - 20) < 1e-4
    solved = intensities.solve([("a", "b", 2.0, 10.0, 50.0)], ["a", "b"], blend=0.01)
    for i in (20, 100):
        left, right = solved["a"][0] * i + solved["a"][1], solved["b"][0] * (2 * i + 10) + solved["b"][1]
        assert abs(left - right) < 3


def test_deformation():
    source = RNG.uniform(0, 60, (60, 3))
    bend = lambda p: p + np.column_stack([2 * np.sin(p[:, 1] / 20), np.zeros(len(p)), np.zeros(len(p))])
    at = RNG.uniform(10, 50, (40, 3))
    assert np.abs(deformation.deform(at, source, bend(source)) - bend(at)).max() < 1.0
    assert np.allclose(deformation.deform(at, source[:0], source[:0]), at)
    a = blobs((40, 40, 20), [[20, 20, 10]])
    own = np.array([[x, y, z] for x in (5, 35) for y in (5, 35) for z in (3, 17)], float)
    out = deformation.fuse_block([{"array": a, "own": own, "common": own + [4, 0, 0]}], (0, 0, 0), (39, 39, 19))
    assert np.unravel_index(out.argmax(), out.shape) == (24, 20, 10)


@pytest.mark.parametrize("k", [1, 6])
def test_nearest_of_many_points_is_exact(k):
    for p, q in ((RNG.integers(0, 12, (700, 3)), RNG.integers(0, 12, (900, 3))), (RNG.normal(size=(300, 9)), RNG.normal(size=(2000, 9)))):
        d = ((p[:, None] - q[None]) ** 2).sum(axis=2)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist, found = models.nearest(p.astype(float), q.astype(float), k)
        assert (found == want).all() and np.allclose(dist, np.sqrt(np.take_along_axis(d, want, 1)))
