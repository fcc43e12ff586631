"""Morphology, skeletons and outlines against plain loops over small frames."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import morphology as mo
from kinetrace.operators import pixels
from kinetrace.operators import skeletons as sk
from kinetrace.plans import imaging
from kinetrace.sources.store import kept


def dense(spark, images):
    rows = [(f, r, c, int(im[r, c])) for f, im in enumerate(images) for r in range(im.shape[0]) for c in range(im.shape[1])]
    return spark.createDataFrame(rows, "frame long, r int, c int, v int")


def sparse(spark, images):
    return dense(spark, images).where("v = 1").select("frame", "r", "c")


def back(frames, images, value="v"):
    out = [np.zeros(im.shape, int) for im in images]
    for x in frames.collect():
        out[x.frame][x.r, x.c] = x[value] if value else 1
    return out


def same(got, want):
    for a, b in zip(got, want, strict=True):
        np.testing.assert_array_equal(a, b)


def blobs(seed, shape=(20, 26), n=3):
    """Random bodies with holes and rough borders."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, int)
    for _ in range(n):
        a, b, s = rng.uniform(2, shape[0] - 2), rng.uniform(2, shape[1] - 2), rng.uniform(2, 5)
        out |= ((y - a) ** 2 + 0.4 * (x - b) ** 2 < s * s).astype(int)
    return out ^ (rng.random(shape) < 0.06)


IMAGES = [blobs(1), blobs(2), np.random.default_rng(3).integers(0, 2, (8, 8)), np.zeros((5, 6), int), np.ones((6, 5), int)]
SHIFTS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def extreme(im, element, pick):
    out = im.copy()
    for r, c in np.ndindex(im.shape):
        out[r, c] = pick(im[r + dr, c + dc] for dr, lo, hi in element for dc in range(lo, hi + 1) if 0 <= r + dr < im.shape[0] and 0 <= c + dc < im.shape[1])
    return out


def reach(seeds, allowed, steps):
    seen, todo = set(), [p for p in seeds if p in allowed]
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += [q for a, b in steps if (q := (p[0] + a, p[1] + b)) in allowed]
    return seen


def border(im):
    return [p for p in np.ndindex(im.shape) if p[0] in (0, im.shape[0] - 1) or p[1] in (0, im.shape[1] - 1)]


def cleared(im):
    gone = reach(border(im), {p for p in np.ndindex(im.shape) if im[p]}, SHIFTS)
    return np.array([[im[r, c] if (r, c) not in gone else 0 for c in range(im.shape[1])] for r in range(im.shape[0])])


def whole(im):
    outside = reach(border(im), {p for p in np.ndindex(im.shape) if not im[p]}, [(0, 1), (1, 0), (0, -1), (-1, 0)])
    return np.array([[0 if (r, c) in outside else 1 for c in range(im.shape[1])] for r in range(im.shape[0])])


def most(im):
    pad = np.pad(im, 1, mode="symmetric")
    return (sum(pad[1 + a : 1 + a + im.shape[0], 1 + b : 1 + b + im.shape[1]] for a, b in SHIFTS) >= 4).astype(int)


def code(im, r, c):
    return int("".join(str(im[r + a, c + b]) if 0 <= r + a < im.shape[0] and 0 <= c + b < im.shape[1] else "0" for a in (-1, 0, 1) for b in (-1, 0, 1)), 2)


def undiagonal(im):
    """Body pixels go whose neighbours are all body, but for two at their sides which meet at a corner."""
    inv = 1 - im
    hit = [[code(inv, r, c) in (0b010100000, 0b000100010, 0b000001010, 0b010001000) for c in range(im.shape[1])] for r in range(im.shape[0])]
    return im & ~np.array(hit).astype(int) & 1


def test_elements_and_grey_filters(spark):
    rng = np.random.default_rng(0)
    grey = [rng.integers(0, 256, (17, 13)), rng.integers(0, 256, (4, 30)), np.full((3, 3), 7)]
    frames = dense(spark, grey)
    for element in (mo.ellipse(6, 6), mo.ellipse(3, 5), mo.box(2, 3), mo.box(1, 1), mo.ellipse(1, 1)):
        same(back(mo.dilated(frames, element), grey), [extreme(im, element, max) for im in grey])
        same(back(mo.opened(frames, element), grey), [extreme(extreme(im, element, min), element, max) for im in grey])
    disk = mo.ellipse(6, 6)
    want = [255 - (extreme(extreme(im, disk, max), disk, min) - im) for im in grey]
    same(back(mo.background_removed(frames, 5), grey), want)
    same(back(mo.thresholded(frames, 0.5), grey), [(im <= 127.5).astype(int) for im in grey])
    inside = lambda y, x, n: (y / (n // 2)) ** 2 + (x / (n // 2)) ** 2
    for n in (5, 9, 15):  # about an ellipse: every run within half a pixel of the curve
        assert all(abs(math.sqrt(max(0, 1 - (dr / (n // 2)) ** 2)) * (n // 2) - hi) <= 0.5 and lo == -hi for dr, lo, hi in mo.ellipse(n, n)) and inside(0, n // 2, n) == 1


@pytest.mark.parametrize("k", range(len(IMAGES)))
def test_binary_steps(spark, k):
    im = IMAGES[k]
    h, w = im.shape
    frames, one = dense(spark, [im]), [im]
    same(back(mo.border_cleared(frames, h, w), one), [cleared(im)])
    same(back(mo.filled(frames, h, w), one), [whole(im)])
    same(back(mo.majority(frames), one), [most(im)])
    disk = mo.ellipse(3, 3)
    all_steps = undiagonal(most(whole(extreme(extreme(cleared(im), disk, max), disk, min))))
    same(back(mo.cleaned(frames, 2, h, w), one), [all_steps])
    want = np.array([[min(((r - a) ** 2 + (c - b) ** 2 for a, b in np.ndindex(im.shape) if not im[a, b]), default=-1) for c in range(w)] for r in range(h)])
    same(back(mo.distances(frames).na.fill(-1), one, "squared"), [want])


def test_all_neighbourhoods(spark):
    images = [np.array(list(map(int, f"{k:09b}"))).reshape(3, 3) for k in range(512)]
    frames = mo.hits(mo.neighbourhoods(dense(spark, images)), mo.DIAGONAL).where("r = 1 AND c = 1").collect()
    assert all(x.hood == x.frame and x.hit == (x.frame in {0b010100000, 0b000100010, 0b000001010, 0b010001000}) for x in frames) and len(frames) == 512
    same(back(mo.diagonals_filled(dense(spark, images[:200])), images[:200]), [1 - undiagonal(1 - im) for im in images[:200]])


def thin(im):
    im = np.pad(im, 1)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = im.copy()
        for second in (0, 1):
            gone = []
            for r, c in zip(*np.nonzero(im), strict=True):
                p = [im[r + a, c + b] for a, b in ring]
                n, turns = sum(p), sum(p[i] == 0 and p[(i + 1) % 8] == 1 for i in range(8))
                ok = (p[0] * p[2] * p[6] == 0 and p[0] * p[4] * p[6] == 0) if second else (p[0] * p[2] * p[4] == 0 and p[2] * p[4] * p[6] == 0)
                if 2 <= n <= 6 and turns == 1 and ok:
                    gone.append((r, c))
            for g in gone:
                im[g] = 0
        if (im == before).all():
            return im[1:-1, 1:-1]


def bar(shape, points, radius):
    """A body along straight parts between points."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, int)
    for (a, b), (c, d) in itertools.pairwise(points):
        for t in np.linspace(0, 1, 60):
            out |= ((y - a - t * (c - a)) ** 2 + (x - b - t * (d - b)) ** 2 <= radius * radius).astype(int)
    return out


def ring_image(n=15, out=6, inner=3):
    y, x = np.mgrid[:n, :n]
    d = (y - n // 2) ** 2 + (x - n // 2) ** 2
    return ((d <= out * out) & (d > inner * inner)).astype(int)


BODIES = [bar((20, 30), [(4, 4), (6, 14), (15, 25)], 2.2), bar((16, 30), [(8, 3), (8, 26)], 1.5), ring_image(), bar((24, 24), [(4, 4), (18, 18), (4, 20)], 1.6), bar((20, 20), [(3, 10), (16, 10), (10, 10), (10, 17)], 1.2), blobs(9), np.eye(7, dtype=int)]


def shortest(im):
    cells = {tuple(map(int, p)) for p in zip(*np.nonzero(im), strict=True)}
    ends = sorted(p for p in cells if sum((p[0] + a, p[1] + b) in cells for a, b in SHIFTS) == 1)
    if len(ends) != 2:
        return len(ends), None, None
    best, todo = {}, [(0.0, 0, 0, ends[0])]
    while todo:
        cost, s, d, p = heapq.heappop(todo)
        if p not in best:
            best[p] = (cost, s, d)
            for a, b in SHIFTS:
                if (q := (p[0] + a, p[1] + b)) in cells and q not in best:
                    n, m = s + (not (a and b)), d + bool(a and b)
                    heapq.heappush(todo, (n + m * math.sqrt(2), n, m, q))
    return 2, ends, best.get(ends[1])


def test_skeletons_and_paths(spark):
    skeletons = [thin(im) for im in BODIES]
    got = sk.thinned(sparse(spark, BODIES))
    same(back(got, BODIES, None), skeletons)
    verdict = {x.frame: x for x in sk.verdicts(got).collect()}
    path = sk.path_between_ends(got)
    length = {x.frame: x.length for x in sk.path_length(path).collect()}
    paths = {}
    for x in path.orderBy("frame", "place").collect():
        paths.setdefault(x.frame, []).append((x.place, (x.r, x.c)))
    kinds = set()
    for f, im in enumerate(skeletons):
        n, ends, best = shortest(im)
        kinds.add(min(n, 3))
        assert (verdict[f].n_ends, verdict[f].bad, verdict[f].crossed) == (n, n != 2, n < 2)
        assert (f in paths) == (best is not None)
        if best:
            places, cells = zip(*paths[f], strict=True)
            assert list(places) == list(range(len(cells))) and [cells[0], cells[-1]] == ends and all(im[p] for p in cells)
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in itertools.pairwise(cells))
            assert abs(length[f] - best[0]) < 1e-9
    assert {0, 2, 3} <= kinds | {0}


def test_order_of_lines(spark):
    square = np.zeros((9, 9), int)
    square[1, 1:8] = square[7, 1:8] = square[1:8, 1] = square[1:8, 7] = 1
    stairs = np.zeros((9, 9), int)
    for i in range(4):
        stairs[i + 2, i + 1 : i + 3] = 1
    two = np.zeros((9, 12), int)
    two[0, 0:5] = two[8, 3:11] = two[4, 6] = 1
    branch = np.zeros((9, 9), int)
    branch[4, 1:8] = branch[1:5, 4] = 1
    long = np.zeros((3, 200), int)
    long[1] = 1
    images = [square, stairs, two, branch, long]
    lines = {}
    for x in sk.in_order(sparse(spark, images)).collect():
        lines.setdefault((x.frame, tuple(x.label)), []).append((x.place, (x.r, x.c)))
    assert all(p is None for p, _ in lines.pop((3, (1, 4))))
    assert len(lines) == 6 and sum(map(len, lines.values())) == sum(im.sum() for im in images) - branch.sum()
    for (f, _), line in lines.items():
        line.sort()
        places, cells = zip(*line, strict=True)
        assert list(places) == list(range(len(cells)))
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in itertools.pairwise(cells))
        if f == 0:  # closed: from the least column and row, clockwise as the first neighbour seen from the left is above or right
            assert cells[0] == (1, 1) and cells[1] == (1, 2) and cells[-1] == (2, 1)
        else:
            assert (cells[0][1], cells[0][0]) == min((c, r) for r, c in (cells[0], cells[-1]))


def test_outlines_and_widths(spark):
    body = sparse(spark, BODIES)
    edges = sk.outlines(body).persist()
    around = {}
    for x in edges.orderBy("frame", "place").collect():
        around.setdefault((x.frame, tuple(x.label)), []).append((x.r, x.c, x.way, x.place))
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    sums = {f: 0 for f in range(len(BODIES))}
    for (f, label), line in around.items():
        assert [e[3] for e in line] == list(range(len(line))) and line[0][:3] == label
        assert all((a[0] + steps[a[2]][0], a[1] + steps[a[2]][1]) == (b[0], b[1]) for a, b in zip(line, line[1:] + line[:1], strict=True))
        sums[f] += len(line)
    for f, im in enumerate(BODIES):
        p = np.pad(im, 1)
        assert sums[f] == sum(int((p != np.roll(p, 1, axis)).sum()) for axis in (0, 1))
    measured = sk.outline_measures(edges).collect()
    for f, im in enumerate(BODIES):
        inside = cleared(1 - im)  # background that does not touch the border, joined at corners or not
        own = [m for m in measured if m.frame == f]
        assert sum(-m.area if m.inner else m.area for m in own) == im.sum()
        if f == 2:
            assert len(own) == 2 and [m.area for m in own if m.inner] == [inside.sum()]
    path = sk.path_between_ends(sk.thinned(body))
    widths = {(x.frame, x.place): x.width for x in sk.perpendicular_widths(path, body, 6).collect()}
    straight = [w for (f, _), w in widths.items() if f == 1]
    assert straight and set(straight[2:-2]) == {3}
    points = path.where("frame = 1 AND place = 10").select("frame", F.col("r").alias("y"), F.col("c").alias("x"))
    assert [x.width for x in sk.width_at(points, body).collect()] == [2.0]


def test_skeletons_paths_and_outlines_across_tiles(spark, monkeypatch):
    """Tiles of 8 pixels cut every body; what comes is what the plain loops give, and what one tile gives."""
    images = [*BODIES, *(np.random.default_rng(k).random((23, 31)).__lt__(0.55).astype(int) for k in range(3))]
    body = sparse(spark, images)
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = lambda: [rows(sk.thinned(body)), rows(sk.path_between_ends(sk.thinned(body))), rows(sk.outlines(body)), rows(sk.in_order(sk.thinned(body)))]
    whole = found()
    monkeypatch.setattr(pixels, "TILE", 8)
    assert found() == whole and all(whole)
    same(back(sk.thinned(body), images, None), [thin(im) for im in images])
    test_order_of_lines(spark)


def test_frames_within_a_tile_take_one_round(spark, monkeypatch):
    """However long a body or its outline is: each round is stored, so the stored tables are counted."""
    stored = []
    monkeypatch.setattr(sk, "kept", lambda rows, name: (stored.append(name), kept(rows, name))[1])
    body = sparse(spark, [bar((60, 60), [(5, 5), (50, 20), (10, 50)], 3)])
    path = sk.path_between_ends(sk.thinned(body))
    assert path.count() > 50 and len(stored) <= 6, stored
    stored.clear()
    assert sk.outlines(body).count() > 200 and len(stored) <= 4, stored


def test_cleaning_computes_each_step_once(spark):
    """What comes before a marking is stored, so the last plan holds the windows after it alone."""
    frames = dense(spark, [blobs(4)])
    plan = mo.cleaned(mo.background_removed(frames, 2), 2, 20, 26)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 4, plan


def test_empty_frames(spark):
    none = sparse(spark, [np.zeros((2, 2), int)])
    assert sk.thinned(none).count() == sk.path_between_ends(none).count() == sk.in_order(none).count() == sk.outlines(none).count() == 0
    empty = dense(spark, [])
    assert mo.cleaned(empty, 2, 4, 4).count() == mo.distances(empty).count() == 0


def components(im):
    left, out = {tuple(map(int, p)) for p in zip(*np.nonzero(im), strict=True)}, []
    while left:
        part = reach([min(left)], left, SHIFTS)
        left -= part
        out.append(part)
    return out


def test_measured_bodies_with_reasons(spark):
    """The chain after cleaning: the largest body of each region, its length and width, or why they lack."""
    images = [np.zeros((24, 40), int) for _ in range(5)]
    images[0][4:7, 2:18] = 1  # a bar on the left, a ring on the right
    images[0][4:19, 22:37] |= ring_image()
    images[1][2:4, 2:4] = 1  # too small; a branched body
    images[1][:, 20:] |= bar((24, 20), [(3, 10), (20, 10), (11, 10), (11, 18)], 1.2)
    images[2] |= bar((24, 40), [(4, 4), (10, 14)], 2.2) | bar((24, 40), [(18, 3), (18, 9)], 1.5) | bar((24, 40), [(4, 24), (20, 34)], 1.7)
    images[3][:] = 1
    settings = imaging.Settings(24, 40, areas=(10, 400), cell=7)
    regions = spark.createDataFrame([("left", 0, 0, 20, 24), ("right", 20, 0, 20, 24)], "animal string, left int, top int, w int, h int")
    got = {(x.frame, x.animal): x for x in imaging.measured(dense(spark, images), regions, settings).collect()}
    assert len(got) == 10
    reasons = set()
    for (f, animal), x in got.items():
        own = []
        for p in components(images[f]):
            cx = sum(c for _, c in p) / len(p)
            if (cx < 19.5) == (animal == "left"):
                own.append((len(p), p))
        fit = [p for n, p in own if 10 <= n <= 400]
        if not fit:
            assert x.reason == ("size" if own else "nothing") and x.length is None
            reasons.add(x.reason)
            continue
        body = max(fit, key=len)
        im = np.zeros(images[f].shape, int)
        im[tuple(zip(*body, strict=True))] = 1
        n, _, best = shortest(thin(im))
        assert (x.n_ends, x.area) == (n, len(body)) and x.reason == ("measured" if n == 2 else "crossed" if n < 2 else "spurs")
        reasons.add(x.reason)
        if n == 2:
            assert abs(x.length - best[0]) < 1e-9 and 1 < x.width < 6
            assert len(x.posture) == 15 and abs(sum(x.posture)) < 1e-9 and im[round(x.mid_y), round(x.mid_x)]
        else:
            assert x.posture is None and x.mid_x is None
    assert reasons == {"nothing", "size", "crossed", "spurs", "measured"}
