"""Queries of the image operators: embeddings as strips of 16 pixels, eight to a frame of 32 by 16, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import morphology, pixels, skeletons
from kinetrace.plans import imaging
from kinetrace.plans.queries import digits, query
from kinetrace.sources import tables
from kinetrace.sources.store import kept

HEIGHT, WIDTH = 32, 16
SETTINGS = imaging.Settings(HEIGHT, WIDTH, threshold=0.9, background_radius=4, body_radius=2, areas=(8, 300), cell=8)
DARK = 0.37


def strips(spark: SparkSession, d: str) -> DataFrame:
    cells = tables.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "a"))
    return cells.select(
        F.expr("vec_id div 8").alias("frame"), (F.col("vec_id") % 8 * 4 + F.floor(F.col("i") / WIDTH)).cast("int").alias("r"), (F.col("i") % WIDTH).cast("int").alias("c"),
        F.round((F.col("a").cast("double") + 1) * 100).cast("int").alias("v"),
    )


def dark(spark: SparkSession, d: str) -> DataFrame:
    return morphology.thresholded(strips(spark, d), DARK)


def smooth(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of the dark pixels, put right by the majority of their neighbours."""
    return kept(morphology.majority(dark(spark, d)), "smooth")


def _around(source: str, name: str, element: morphology.Element, extreme: str) -> str:
    at = ", ".join(f"({dr}, {dc})" for dr, lo, hi in element for dc in range(lo, hi + 1))
    return f"{name} AS (SELECT a.frame, a.r, a.c, {extreme}(b.v) AS v FROM {source} a CROSS JOIN (VALUES {at}) e(dr, dc) JOIN {source} b ON b.frame = a.frame AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL)"


STRIPS = """st AS (SELECT vec_id // 8 AS frame, CAST(vec_id % 8 * 4 + i // 16 AS INTEGER) AS r, CAST(i % 16 AS INTEGER) AS c, CAST(round((a + 1) * 100) AS INTEGER) AS v
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings))"""
DARK_SQL = f"{STRIPS}, dk AS (SELECT frame, r, c, CASE WHEN v <= 255 * {DARK} THEN 1 ELSE 0 END AS v FROM st)"
EDGE = f"(r IN (0, {HEIGHT - 1}) OR c IN (0, {WIDTH - 1}))"


def _flood(source: str, name: str, value: int, eight: bool) -> str:
    near = "abs(b.r - f.r) <= 1 AND abs(b.c - f.c) <= 1" if eight else "abs(b.r - f.r) + abs(b.c - f.c) = 1"
    return f"{name} AS (SELECT frame, r, c FROM {source} WHERE v = {value} AND {EDGE} UNION SELECT b.frame, b.r, b.c FROM {name} f JOIN {source} b ON b.frame = f.frame AND b.v = {value} AND {near})"


def _majority(source: str, name: str) -> str:
    """Places beyond the border are those next to them."""
    return f"""{name} AS (SELECT a.frame, a.r, a.c, CASE WHEN sum(b.v) >= 4 THEN 1 ELSE 0 END AS v FROM (SELECT *, max(r) OVER (PARTITION BY frame) AS low FROM {source}) a
  CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) e(dr, dc) JOIN {source} b ON b.frame = a.frame AND b.r = least(greatest(a.r + dr, 0), low) AND b.c = least(greatest(a.c + dc, 0), {WIDTH - 1}) GROUP BY ALL)"""


def _hoods(source: str, name: str) -> str:
    return f"""{name} AS (SELECT a.frame, a.r, a.c, a.v, CAST(sum(b.v * (1 << (4 - 3 * (b.r - a.r) - (b.c - a.c)))) AS INTEGER) AS hood FROM {source} a JOIN {source} b ON b.frame = a.frame AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY ALL)"""


HOODS = ", ".join(map(str, morphology.DIAGONAL))


def _cleaned(source: str, radius: int) -> str:
    disk = morphology.ellipse(radius + 1, radius + 1)
    return f"""{_flood(source, "fb", 1, True)}, c1 AS (SELECT s.frame, s.r, s.c, CASE WHEN fb.frame IS NULL THEN s.v ELSE 0 END AS v FROM {source} s LEFT JOIN fb ON fb.frame = s.frame AND fb.r = s.r AND fb.c = s.c),
{_around("c1", "c2", disk, "max")}, {_around("c2", "c3", disk, "min")}, {_flood("c3", "fo", 0, False)},
c4 AS (SELECT s.frame, s.r, s.c, CASE WHEN fo.frame IS NULL THEN 1 ELSE 0 END AS v FROM c3 s LEFT JOIN fo ON fo.frame = s.frame AND fo.r = s.r AND fo.c = s.c),
{_majority("c4", "c5")}, c6 AS (SELECT frame, r, c, 1 - v AS v FROM c5), {_hoods("c6", "c7")}, cleaned AS (SELECT frame, r, c, CASE WHEN v = 1 OR hood IN ({HOODS}) THEN 0 ELSE 1 END AS v FROM c7)"""


BACKGROUND = f"""{STRIPS}, {_around("st", "b1", morphology.ellipse(5, 5), "max")}, {_around("b1", "b2", morphology.ellipse(5, 5), "min")}, bg AS (SELECT b2.frame, b2.r, b2.c, 255 - (b2.v - st.v) AS v FROM b2 JOIN st ON st.frame = b2.frame AND st.r = b2.r AND st.c = b2.c)"""
CLEANED = f"""{BACKGROUND}, bd AS (SELECT frame, r, c, CASE WHEN v <= 255 * {SETTINGS.threshold} THEN 1 ELSE 0 END AS v FROM bg), {_cleaned("bd", 2)}"""
SMOOTH = f"""{DARK_SQL}, {_majority("dk", "sm")}"""


def _thinned(source: str) -> str:
    """Frames as lists of 34 by 18 bits with a blank margin; each round takes the pixels of both half steps from the list."""
    p = [f"p[i + {a * 18 + b}]" for a, b in skeletons.AROUND]
    count, turns = " + ".join(p), " + ".join(f"(CASE WHEN {p[i]} < {p[(i + 1) % 8]} THEN 1 ELSE 0 END)" for i in range(8))

    def half(*products: tuple[int, int, int]) -> str:
        away = " AND ".join(f"{p[a]} * {p[b]} * {p[c]} = 0" for a, b, c in products)
        return f"list_transform(range(1, 613), lambda i: CASE WHEN p[i] = 1 AND {count} BETWEEN 2 AND 6 AND {turns} = 1 AND {away} THEN 0 ELSE p[i] END)"

    bits = "list_transform(range(0, 612), lambda k: CASE WHEN list_contains(on_, k) THEN 1 ELSE 0 END)"
    return f"""l0 AS (SELECT frame, list((r + 1) * 18 + c + 1) AS on_ FROM {source} WHERE v = 1 GROUP BY frame), l1 AS (SELECT frame, {bits} AS p FROM l0),
th AS (SELECT frame, p, 0 AS k FROM l1 UNION ALL SELECT frame, q, k + 1 FROM (SELECT frame, was, {half((0, 2, 6), (0, 4, 6))} AS q, k FROM (SELECT frame, p AS was, {half((0, 2, 4), (2, 4, 6))} AS p, k FROM th)) WHERE q <> was),
sk AS (SELECT frame, CAST(i // 18 - 1 AS INTEGER) AS r, CAST(i % 18 - 1 AS INTEGER) AS c FROM (SELECT frame, unnest(range(0, 612)) AS i, unnest(p) AS b FROM (SELECT frame, arg_max(p, k) AS p FROM th GROUP BY frame)) WHERE b = 1)"""


@query(f"WITH {BACKGROUND} SELECT * FROM bg")
def background_filter(spark: SparkSession, d: str) -> DataFrame:
    """Grey frames less their closing by an ellipse: only narrow dark spots stay dark."""
    return morphology.background_removed(strips(spark, d), SETTINGS.background_radius)


@query(f"WITH RECURSIVE {CLEANED} SELECT frame, r, c FROM cleaned WHERE v = 1")
def morphological_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of bodies after background, threshold, border, closing, holes, majority and diagonals."""
    return imaging.bodies(strips(spark, d), SETTINGS).where("v = 1").select("frame", "r", "c")


@query(f"""WITH {DARK_SQL}, {_around("dk", "o1", morphology.box(2, 2), "min")}, {_around("o1", "o2", morphology.box(2, 2), "max")} SELECT frame, count(*) FILTER (WHERE v = 1) AS n_body, CAST(sum(v * (r * 16 + c)) AS BIGINT) AS places FROM o2 GROUP BY frame""")
def box_opening(spark: SparkSession, d: str) -> DataFrame:
    """Dark pixels that an opening by a box of two by two leaves, by number and places."""
    left = morphology.opened(dark(spark, d), morphology.box(2, 2))
    return left.groupBy("frame").agg(F.sum("v").alias("n_body"), F.sum(F.col("v") * (F.col("r") * 16 + F.col("c"))).alias("places"))


@query(f"WITH {DARK_SQL}, {_hoods('dk', 'nh')} SELECT frame, r, c, hood, hood IN ({HOODS}) AS hit FROM nh")
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """Each pixel's neighbourhood, and whether it joins two pixels that meet only at a corner."""
    found = morphology.hits(morphology.neighbourhoods(dark(spark, d)), morphology.DIAGONAL)
    return found.select("frame", "r", "c", "hood", "hit")


@query(f"""WITH {SMOOTH} SELECT a.frame, a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS squared FROM sm a JOIN sm b ON b.frame = a.frame AND b.v = 0 WHERE a.v = 1 GROUP BY ALL""")
def distance_transform(spark: SparkSession, d: str) -> DataFrame:
    """The squared distance of each body pixel to the background; twice its root at most is a body's width."""
    return morphology.distances(smooth(spark, d)).where("v = 1 AND squared IS NOT NULL").select("frame", "r", "c", "squared")


@query(f"WITH RECURSIVE {SMOOTH}, {_thinned('sm')} SELECT * FROM sk")
def thinned_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Skeletons one pixel wide."""
    return skeletons.thinned(smooth(spark, d).where("v = 1"))


@query(f"""WITH RECURSIVE {SMOOTH}, {_thinned('sm')}, n AS (SELECT a.frame, a.r, a.c, count(*) - 1 AS n FROM sk a JOIN sk b ON b.frame = a.frame AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY ALL),
e AS (SELECT frame, count(*) FILTER (WHERE n = 1) AS n_ends FROM n GROUP BY frame) SELECT frame, n_ends, n_ends <> 2 AS bad, n_ends < 2 AS crossed FROM e""")
def skeleton_ends(spark: SparkSession, d: str) -> DataFrame:
    """How many ends the skeletons of a frame have, and what that says."""
    return skeletons.verdicts(skeletons.thinned(smooth(spark, d).where("v = 1")))


#: Neighbours along a line: diagonal ones only where no straight one joins them; ways counted from the left neighbour clockwise.
LINKS = """al AS (SELECT a.frame, a.r, a.c, b.r AS r2, b.c AS c2, list_position([30, 0, 1, 2, 32, 62, 61, 60], (b.r - a.r + 1) * 30 + b.c - a.c + 1) AS way FROM sk a JOIN sk b ON b.frame = a.frame AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c)),
lk AS (SELECT * FROM al WHERE r = r2 OR c = c2 OR NOT EXISTS (SELECT 1 FROM sk s WHERE s.frame = al.frame AND ((s.r = al.r AND s.c = al.c2) OR (s.r = al.r2 AND s.c = al.c)))),
dg AS (SELECT s.frame, s.r, s.c, count(lk.r2) AS n FROM sk s LEFT JOIN lk ON lk.frame = s.frame AND lk.r = s.r AND lk.c = s.c GROUP BY ALL)"""
LABELS = """zz AS (SELECT frame, r, c, r * 100 + c AS k FROM sk UNION SELECT b.frame, b.r, b.c, z.k FROM zz z JOIN sk b ON b.frame = z.frame AND abs(b.r - z.r) <= 1 AND abs(b.c - z.c) <= 1),
lb AS (SELECT frame, r, c, min(k) AS label FROM zz GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {SMOOTH}, {_thinned('sm')}, {LINKS}, {LABELS}, q AS (SELECT lb.frame, lb.r, lb.c, label, n FROM lb JOIN dg ON dg.frame = lb.frame AND dg.r = lb.r AND dg.c = lb.c),
l AS (SELECT frame, label, max(n) > 2 AS branched, arg_min(r, (CASE WHEN n > 1 THEN 1 ELSE 0 END) * 10000 + c * 100 + r) AS sr, arg_min(c, (CASE WHEN n > 1 THEN 1 ELSE 0 END) * 10000 + c * 100 + r) AS sc FROM q GROUP BY ALL),
w AS (SELECT frame, label, sr, sc, sr AS r, sc AS c, -1 AS pr, -1 AS pc, 0 AS place FROM l WHERE NOT branched UNION ALL
  SELECT * FROM (SELECT w.frame, w.label, w.sr, w.sc, lk.r2 AS r, lk.c2 AS c, w.r AS pr, w.c AS pc, w.place + 1 AS place FROM w JOIN lk ON lk.frame = w.frame AND lk.r = w.r AND lk.c = w.c AND NOT (lk.r2 = pr AND lk.c2 = pc) AND NOT (lk.r2 = sr AND lk.c2 = sc)
    QUALIFY row_number() OVER (PARTITION BY w.frame, w.label ORDER BY lk.way) = 1))
SELECT q.frame, q.label // 100 AS label_r, q.label % 100 AS label_c, q.r, q.c, w.place FROM q LEFT JOIN w ON w.frame = q.frame AND w.r = q.r AND w.c = q.c AND w.label = q.label""")
def skeleton_order(spark: SparkSession, d: str) -> DataFrame:
    """Each skeleton pixel's place along its line."""
    placed = skeletons.in_order(skeletons.thinned(smooth(spark, d).where("v = 1")))
    return placed.select("frame", F.col("label.r").alias("label_r"), F.col("label.c").alias("label_c"), "r", "c", "place")


EDGES = """bo AS (SELECT frame, r, c FROM sm WHERE v = 1), ed AS (SELECT b.frame, b.r + y AS r, b.c + x AS c, way, b.r + y2 AS r2, b.c + x2 AS c2 FROM bo b CROSS JOIN (VALUES (0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 1), (2, 1, 0, 1, 1, 1, 0), (3, 0, -1, 1, 0, 0, 0)) s(way, dr, dc, y, x, y2, x2)
  WHERE NOT EXISTS (SELECT 1 FROM bo o WHERE o.frame = b.frame AND o.r = b.r + dr AND o.c = b.c + dc)),
nx AS (SELECT a.frame, a.r, a.c, a.way, a.r * 10000 + a.c * 10 + a.way AS e, arg_min(b.r * 10000 + b.c * 10 + b.way, (b.way - a.way + 5) % 4) AS n FROM ed a JOIN ed b ON b.frame = a.frame AND b.r = a.r2 AND b.c = a.c2 GROUP BY ALL),
wk AS (SELECT frame, e AS s, e AS p, 0 AS place FROM nx UNION ALL SELECT wk.frame, wk.s, nx.n, wk.place + 1 FROM wk JOIN nx ON nx.frame = wk.frame AND nx.e = wk.p AND nx.n <> wk.s),
cy AS (SELECT wk.frame, s, place, p // 10000 AS r, p // 10 % 1000 AS c, p % 10 AS way FROM wk WHERE (frame, s) IN (SELECT (frame, s) FROM wk GROUP BY frame, s HAVING min(p) = s))"""


@query(f"WITH RECURSIVE {SMOOTH}, {EDGES} SELECT frame, s // 10000 AS label_r, s // 10 % 1000 AS label_c, r, c, way, place FROM cy")
def body_outlines(spark: SparkSession, d: str) -> DataFrame:
    """The edges of all outlines, in order."""
    edges = skeletons.outlines(smooth(spark, d).where("v = 1"))
    return edges.select("frame", F.col("label.r").alias("label_r"), F.col("label.c").alias("label_c"), "r", "c", "way", "place")


@query(f"""WITH RECURSIVE {SMOOTH}, {EDGES}, m AS (SELECT frame, s, count(*) AS perimeter, sum(CASE way WHEN 0 THEN -r WHEN 1 THEN c WHEN 2 THEN r ELSE -c END) AS twice FROM cy GROUP BY frame, s)
SELECT frame, s // 10000 AS label_r, s // 10 % 1000 AS label_c, perimeter, abs(twice) / 2 AS area, twice < 0 AS "inner" FROM m""")
def outline_measures(spark: SparkSession, d: str) -> DataFrame:
    """Perimeter and area of bodies and of their holes."""
    edges = skeletons.outline_edges(smooth(spark, d).where("v = 1"))
    found = skeletons.outline_measures(edges.select("frame", "label", "node.*"))
    return found.select("frame", F.col("label.r").alias("label_r"), F.col("label.c").alias("label_c"), "perimeter", "area", "inner")


def largest_bodies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The largest body of each frame, and the path between its ends if it has two."""
    labels = kept(pixels.labelled(smooth(spark, d).where("v = 1").select("frame", "r", "c")), "labels")
    largest = labels.groupBy("frame", "label").count().groupBy("frame").agg(F.max_by("label", F.struct("count", "label")).alias("label"))
    body = kept(labels.join(largest, ["frame", "label"], "left_semi").select("frame", "r", "c"), "body")
    return body, kept(skeletons.path_between_ends(skeletons.thinned(body)), "path")


@query()
def body_paths(spark: SparkSession, d: str) -> DataFrame:
    """Of frames whose largest body has two ends: the path between them with its width across at each inner point."""
    body, path = largest_bodies(spark, d)
    widths = skeletons.perpendicular_widths(path, body, 8)
    return path.join(widths, ["frame", "place"], "left").join(skeletons.path_length(path), "frame").select("frame", "place", "r", "c", "width", digits("length"))


REGIONS = [("left", 0, 0, WIDTH // 2, HEIGHT), ("right", WIDTH // 2, 0, WIDTH // 2, HEIGHT)]


@query(f"""WITH RECURSIVE {CLEANED}, sk AS (SELECT frame, r, c FROM cleaned WHERE v = 1), {LABELS}, pt AS (SELECT frame, label, count(*) AS area, avg(c) AS x, avg(r) AS y FROM lb GROUP BY ALL),
rg AS (SELECT frame, animal FROM (SELECT DISTINCT frame FROM st) CROSS JOIN (VALUES ('left'), ('right')) a(animal)), pa AS (SELECT *, CASE WHEN x < {WIDTH // 2 - 0.5} THEN 'left' ELSE 'right' END AS animal FROM pt),
be AS (SELECT frame, animal, count(*) AS parts, max(area) FILTER (WHERE area BETWEEN {SETTINGS.areas[0]} AND {SETTINGS.areas[1]}) AS area, max(area * 10000 + label) FILTER (WHERE area BETWEEN {SETTINGS.areas[0]} AND {SETTINGS.areas[1]}) AS best FROM pa GROUP BY ALL)
SELECT rg.frame, rg.animal, CASE WHEN parts IS NULL THEN 'nothing' WHEN best IS NULL THEN 'size' ELSE 'body' END AS reason, be.area, round(pt.x, 6) AS x, round(pt.y, 6) AS y FROM rg LEFT JOIN be ON be.frame = rg.frame AND be.animal = rg.animal LEFT JOIN pt ON pt.frame = be.frame AND pt.label = best % 10000""")
def frame_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Frames from grey pixels to the body of each region, with why there is none."""
    found = _measured(spark, d)
    body = F.when(F.col("reason").isin("nothing", "size"), F.col("reason")).otherwise("body")
    return found.select("frame", "animal", body.alias("reason"), "area", digits("x"), digits("y"))


@query()
def frame_measures(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, with ends, length and width of each body and the reason where they lack."""
    return _measured(spark, d)


def _measured(spark: SparkSession, d: str) -> DataFrame:
    clean = kept(imaging.bodies(strips(spark, d), SETTINGS), "clean")
    regions = spark.createDataFrame(REGIONS, "animal string, left int, top int, w int, h int")
    return imaging.measured(clean, regions, SETTINGS)
