"""The library's queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import focus, grid, labels, matching, spatial, stats
from tilewright.plans import views
from tilewright.plans.storage import materialize, table
from tilewright.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

OBJECTS = """objects AS (SELECT o_orderkey, o_orderkey // 500 AS slide, (o_orderkey * 7919) % 2000 AS x, (o_custkey * 10473 + o_orderkey * 131) % 2000 AS y,
  24 + o_orderkey % 41 AS w, 24 + o_custkey % 41 AS h, o_orderpriority AS label FROM orders)"""
TILES = """axis AS (SELECT i, i * 384 AS p FROM range(5) t(i)),
tiles AS (SELECT y.i * 10 + x.i AS tile, x.p AS tx, y.p AS ty, x.i AS ix, y.i AS iy FROM axis x, axis y)"""
DETECTIONS = f"""{OBJECTS}, {TILES}, moved AS (SELECT *, ((o_orderkey * 31 + ix * 17 + iy * 13) % 5) - 2 AS dx, ((o_orderkey * 29 + ix * 11 + iy * 19) % 5) - 2 AS dy
  FROM objects, tiles WHERE x < tx + 512 AND tx < x + w AND y < ty + 512 AND ty < y + h),
clipped AS (SELECT *, least(greatest(x + dx - tx, 0), 512) AS c1, least(greatest(y + dy - ty, 0), 512) AS c2, least(greatest(x + w + dx - tx, 0), 512) AS c3,
  least(greatest(y + h + dy - ty, 0), 512) AS c4 FROM moved),
det AS MATERIALIZED (SELECT slide, tile, slide * 1000000000 + o_orderkey * 100 + iy * 10 + ix AS det_id, (c1 + tx)::DOUBLE AS x1, (c2 + ty)::DOUBLE AS y1, (c3 + tx)::DOUBLE AS x2,
  (c4 + ty)::DOUBLE AS y2, ((o_orderkey * 7919 + ix * 911 + iy * 3571) % 10007) / 10007.0::DOUBLE AS score FROM clipped WHERE c3 > c1 AND c4 > c2)"""
IOU = "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
_I = IOU.format(a="a", b="b")
_UNION = "((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - " + _I + ")"
MEET = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
EDGES = f"""{DETECTIONS}, cells AS MATERIALIZED (SELECT *, unnest(range((x1 // 64)::BIGINT, (x2 // 64)::BIGINT + 1)) AS cell FROM det),
edges AS MATERIALIZED (SELECT DISTINCT a.det_id AS a, b.det_id AS b FROM cells a JOIN cells b ON a.slide = b.slide AND a.cell = b.cell AND a.tile <> b.tile AND a.det_id < b.det_id AND {MEET} AND {_I} / ({_UNION} + 1e-7) > 0.5)"""
COMPONENTS = f"""{EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
labelled AS (SELECT det.*, coalesce(c.component, det_id) AS component FROM det LEFT JOIN (SELECT n, min(m) AS component FROM reach GROUP BY n) c ON c.n = det.det_id)"""
BEST = f"""{COMPONENTS}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, det_id) AS rn FROM labelled) WHERE rn = 1)"""
MATCHES = f"""{BEST}, gt AS (SELECT slide, o_orderkey AS gt_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM objects),
cand AS (SELECT a.slide, a.det_id AS pred_id, b.gt_id, {_I} / ({_UNION} + 1e-7) AS iou FROM kept a JOIN gt b ON a.slide = b.slide AND {MEET}),
first_pass AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide, pred_id ORDER BY iou DESC, gt_id DESC) AS n FROM cand WHERE iou > 0.5) WHERE n = 1),
matches AS (SELECT slide, pred_id, gt_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY slide, gt_id ORDER BY iou DESC, pred_id DESC) AS k FROM first_pass) WHERE k = 1)"""
_PLAIN = f"({_I} / {_UNION})"
RANKED = f"""{BEST}, gt AS (SELECT slide, o_orderkey AS gt_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM objects),
ranked AS MATERIALIZED (SELECT slide, det_id AS pred_id, score, x1, y1, x2, y2, row_number() OVER (PARTITION BY slide ORDER BY score DESC, det_id) AS rank FROM kept),
near AS MATERIALIZED (SELECT a.slide, a.pred_id, b.gt_id, {_PLAIN} AS iou FROM ranked a JOIN gt b ON a.slide = b.slide AND {MEET} WHERE {_PLAIN} >= 0.5)"""
GREEDY = f"""{RANKED}, turns AS MATERIALIZED (SELECT r.slide, t.t, r.rank, r.pred_id, coalesce(list(n.gt_id ORDER BY n.iou DESC, n.gt_id) FILTER (n.gt_id IS NOT NULL), []) AS options
  FROM ranked r CROSS JOIN (SELECT unnest({{thresholds}})::DOUBLE AS t) t LEFT JOIN near n ON n.slide = r.slide AND n.pred_id = r.pred_id AND n.iou >= t.t {{most}} GROUP BY ALL),
fold AS (SELECT slide, t, 0::BIGINT AS rank, []::BIGINT[] AS used, NULL::BIGINT AS pred_id, NULL::BIGINT AS gt_id FROM (SELECT DISTINCT slide, t FROM turns)
  UNION ALL SELECT slide, t, rank, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pred_id, pick
  FROM (SELECT u.slide, u.t, u.rank, f.used, u.pred_id, list_filter(u.options, lambda g: NOT list_contains(f.used, g))[1] AS pick FROM fold f JOIN turns u ON u.slide = f.slide AND u.t = f.t AND u.rank = f.rank + 1)),
totals AS (SELECT slide, count(*) AS n_gt FROM gt GROUP BY slide)"""
CURVE = GREEDY.format(thresholds="[0.5]", most="") + """, hits AS (SELECT slide, rank, pred_id, (gt_id IS NOT NULL)::INT AS hit, sum((gt_id IS NOT NULL)::INT) OVER (PARTITION BY slide ORDER BY rank)::BIGINT AS tp FROM fold WHERE rank > 0),
points AS (SELECT slide, rank, pred_id, hit, tp, rank - tp AS fp, tp / rank AS precision, tp / n_gt AS recall, n_gt FROM hits JOIN totals USING (slide))"""
REGIONS = """regions AS (SELECT c_custkey AS region, c_custkey // 10 AS slide, (c_custkey * 37) % 500 - 20 AS x, (c_custkey * 53) % 500 - 20 AS y, 60 + (c_custkey * 7) % 900 AS w,
  60 + (c_custkey * 11) % 700 AS h, 1000 AS width, 800 AS height FROM customer)"""
PLANES = "planes AS (SELECT vec_id // 5 AS tile, vec_id % 5 AS z, [CAST(floor((v::DOUBLE + 1) * 127.5) AS INT) FOR v IN embedding] AS px FROM embeddings)"


def _sql_taps(kernel, name: str) -> str:
    reach = len(kernel) // 2
    mirror = lambda e: f"(7 - abs(7 - abs({e})))"
    taps = [f"({k}) * {name}[{mirror(f'i // 8 + ({r - reach})')} * 8 + {mirror(f'i % 8 + ({c - reach})')} + 1]" for r, row in enumerate(kernel) for c, k in enumerate(row) if k]
    return " + ".join(taps)


SCORES = f"""{PLANES}, stencils AS (SELECT tile, z, px, [{_sql_taps(focus.LAPLACE, 'px')} FOR i IN range(64)] AS lap, [{_sql_taps(focus.SOBEL_X, 'px')} FOR i IN range(64)] AS gx,
  [{_sql_taps(focus.SOBEL_Y, 'px')} FOR i IN range(64)] AS gy, [({_sql_taps(focus.BLUR, 'px')} + 128) // 256 FOR i IN range(64)] AS bl FROM planes),
energy AS (SELECT tile, z, px, lap, [gx[i + 1] * gx[i + 1] + gy[i + 1] * gy[i + 1] FOR i IN range(64)] AS grad, [{_sql_taps(focus.LAPLACE_5, 'bl')} FOR i IN range(64)] AS lg FROM stencils),
sorted AS (SELECT *, list_sort([abs(v) FOR v IN lap]) AS la, list_sort(grad) AS ga FROM energy),
scores AS (SELECT tile, z, list_sum([v * v FOR v IN lap]) / 64.0::DOUBLE - (list_sum(lap) / 64.0::DOUBLE) * (list_sum(lap) / 64.0::DOUBLE) AS vol, list_sum(grad) / 64.0::DOUBLE AS tenengrad,
  la[48] + (la[49] - la[48]) * 0.25::DOUBLE AS pvol, ga[48] + (ga[49] - ga[48]) * 0.25::DOUBLE AS ptenengrad, list_sum([abs(v) FOR v IN lg]) / 64.0::DOUBLE AS log FROM sorted)"""


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def _regions(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey as region", "c_custkey div 10 as slide", "(c_custkey * 37) % 500 - 20 as x", "(c_custkey * 53) % 500 - 20 as y", "60 + (c_custkey * 7) % 900 as w", "60 + (c_custkey * 11) % 700 as h", "1000 as width", "800 as height")


META = ("0.2272D as mpp_x", "40D as objective_power", "123456 as x_offset_nm", "-65432 as y_offset_nm", "90000 as full_width", "60000 as full_height")
_STEP, _OX, _OY = "(0.2272::DOUBLE * 1000 * 40 / 20)", "(123456 - 90000 / 2 * (0.2272::DOUBLE * 1000))", "(-65432 - 60000 / 2 * (0.2272::DOUBLE * 1000))"


@query(f"WITH {OBJECTS} SELECT o_orderkey, " + ", ".join(f"CAST(round_even({e} / {_STEP}, 0) AS INT) AS {n}" for e, n in ((f"(x * 997 - {_OX})", "px"), (f"(y * 991 - {_OY})", "py"), ("(w * 500)", "pw"), ("(h * 500)", "ph"))) + " FROM objects")
def bounds_to_pixels(spark, d):
    o = views.objects(spark, d).selectExpr("o_orderkey", "x * 997 as x", "y * 991 as y", "w * 500 as w", "h * 500 as h", *META)
    return o.select("o_orderkey", *[c.alias(n) for c, n in zip(G.bounds_to_pixels("x", "y", "w", "h", 20.0), ("px", "py", "pw", "ph"), strict=True)])


@query(f"WITH {OBJECTS} SELECT o_orderkey, round({_OX} + x * {_STEP}, 6) AS x_nm, round({_OY} + y * {_STEP}, 6) AS y_nm, round(greatest(0, (w - 30) * {_STEP}), 6) AS width_nm, round(h * {_STEP}, 6) AS height_nm FROM objects")
def pixels_to_nm(spark, d):
    o = views.objects(spark, d).selectExpr("o_orderkey", "x as x1", "y as y1", "x + w - 30 as x2", "y + h as y2", *META)
    return o.select("o_orderkey", *[F.round(c, 6).alias(n) for c, n in zip(G.pixels_to_nm("x1", "y1", "x2", "y2", 20.0), ("x_nm", "y_nm", "width_nm", "height_nm"), strict=True)])


@query(f"""WITH {REGIONS}, sy AS (SELECT *, unnest(range(greatest(1, CAST(ceil(h / 192.0) AS INT)))) AS ky FROM regions), sx AS (SELECT *, unnest(range(greatest(1, CAST(ceil(w / 192.0) AS INT)))) AS kx FROM sy)
SELECT region, least(x + kx * 192 + 256, x + w) - 256 AS x, least(y + ky * 192 + 256, y + h) - 256 AS y FROM sx""")
def tile_grid(spark, d):
    return grid.dataset_tiles(_regions(spark, d), 256, 0.25, ["region"])


@query(f"""WITH {REGIONS} SELECT region, unnest(CASE WHEN w <= 256 THEN [0] ELSE list_distinct(list_concat(range(0, w - 256 + 1, 100), [w - 256])) END) AS pos FROM regions""")
def axis_positions(spark, d):
    return _regions(spark, d).select("region", F.explode(grid.axis_positions("w", 256, 100)).alias("pos"))


@query(f"""WITH {REGIONS}, clamped AS (SELECT slide, region, greatest(0, x) AS rx, greatest(0, y) AS ry, least(w, width - greatest(0, x)) AS rw, least(h, height - greatest(0, y)) AS rh FROM regions),
pos AS (SELECT *, CASE WHEN rw <= 256 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, rw - 256 + 1, 192), [rw - 256]))) END AS xs,
  CASE WHEN rh <= 256 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, rh - 256 + 1, 192), [rh - 256]))) END AS ys FROM clamped WHERE rw > 0 AND rh > 0),
off AS (SELECT *, coalesce(sum(len(ys) + 1) OVER (PARTITION BY slide ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS iy0 FROM pos),
ey AS (SELECT *, unnest(range(len(ys))) AS iy FROM off), ex AS (SELECT *, unnest(range(len(xs))) AS ix FROM ey)
SELECT slide, region, rx + xs[ix + 1] AS x, ry + ys[iy + 1] AS y, ix, CAST(iy0 + iy AS BIGINT) AS iy FROM ex""")
def roi_grid(spark, d):
    return grid.roi_tiles(_regions(spark, d), 256, 0.25, "slide", "region").drop("w", "h")


@query(f"WITH {OBJECTS}, {TILES} SELECT slide, tile, o_orderkey FROM objects, tiles WHERE x < tx + 512 AND tx < x + w AND y < ty + 512 AND ty < y + h")
def tile_annotation_join(spark, d):
    o, t = views.objects(spark, d).withColumn("k", F.lit(1)), views.tiles(spark).withColumn("k", F.lit(1))
    return spatial.spatial_join(o, t, ["k"], 512.0).select("a.slide", "b.tile", "a.o_orderkey")


@query(f"""WITH {OBJECTS}, {TILES}, j AS (SELECT *, x - tx AS ux, y - ty AS uy FROM objects, tiles WHERE x < tx + 512 AND tx < x + w AND y < ty + 512 AND ty < y + h),
c AS (SELECT *, greatest(ux, 0) AS cx, greatest(uy, 0) AS cy, least(ux + w, 512) - greatest(ux, 0) AS cw, least(uy + h, 512) - greatest(uy, 0) AS ch FROM j)
SELECT slide, tile, o_orderkey, ux, uy, cx, cy, cw, ch, cw * ch >= 16 AND (cw * ch)::DOUBLE / (w * h) > 0.25 AS valid FROM c""")
def crop_boxes(spark, d):
    o, t = views.objects(spark, d).withColumn("k", F.lit(1)), views.tiles(spark).withColumn("k", F.lit(1))
    j = spatial.spatial_join(o, t, ["k"], 512.0)
    cropped, full = G.crop([F.col(f"b.{c}") for c in "xywh"], [F.col(f"a.{c}") for c in "xywh"])
    s = j.select("a.slide", "b.tile", "a.o_orderkey", full[0].alias("ux"), full[1].alias("uy"), *[c.alias(n) for c, n in zip(cropped, ("cx", "cy", "cw", "ch"), strict=True)], F.col("a.w").alias("w"), F.col("a.h").alias("h"))
    return s.withColumn("valid", G.is_valid_box("cw", "ch", "w", "h")).drop("w", "h")


@query(f"WITH {EDGES} SELECT a, b FROM edges")
def dedup_edges(spark, d):
    return spatial.dedup_edges(views.detections(spark, d), 0.5)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT det_id, component FROM labelled")
def dedup_components(spark, d):
    det = materialize(views.detections(spark, d))
    return spatial.with_components(det, spatial.component_labels(det, 0.5)).select("det_id", "component")


@query(f"WITH RECURSIVE {BEST} SELECT slide, tile, det_id, x1, y1, x2, y2, round(score, 6) AS score FROM kept")
def dedup_detections(spark, d):
    return spatial.deduplicate(materialize(views.detections(spark, d))).withColumns(_r6("score"))


def _pred_gt(spark, d) -> tuple[DataFrame, DataFrame]:
    pred = materialize(spatial.deduplicate(materialize(views.detections(spark, d)))).withColumnRenamed("det_id", "pred_id")
    return pred, views.objects(spark, d).select("slide", F.col("o_orderkey").alias("gt_id"), *spatial.BOX)


@query(f"WITH RECURSIVE {MATCHES} SELECT slide, pred_id, gt_id, round(iou, 6) AS iou FROM matches")
def best_of_match(spark, d):
    return matching.best_of_match(*_pred_gt(spark, d), 0.5, ["slide"]).withColumns(_r6("iou"))


@query(f"""WITH RECURSIVE {MATCHES} SELECT p.slide, n_pred - n AS fp, n_gt - n AS fn, n AS tp FROM (SELECT slide, count(*) AS n_pred FROM kept GROUP BY slide) p JOIN (SELECT slide, count(*) AS n_gt FROM gt GROUP BY slide) g
ON p.slide = g.slide JOIN (SELECT slide, count(*) AS n FROM matches GROUP BY slide) m ON m.slide = p.slide""")
def match_fp_fn(spark, d):
    pred, gt = _pred_gt(spark, d)
    m = matching.best_of_match(pred, gt, 0.5, ["slide"])
    count = lambda df, n: df.groupBy("slide").agg(F.count("*").alias(n))
    missed = count(matching.false_positives(pred, m, ["slide"]), "fp").join(count(matching.false_negatives(gt, m, ["slide"]), "fn"), "slide", "full")
    return count(m, "tp").join(missed, "slide", "left").na.fill(0, ["fp", "fn"]).select("slide", "fp", "fn", "tp")  # no misses: no row there


def _greedy(spark, d) -> tuple[DataFrame, DataFrame]:
    pred, gt = _pred_gt(spark, d)
    return matching.greedy_match(pred, gt, 0.5), gt


@query(f"""WITH RECURSIVE {CURVE}, s AS (SELECT slide, sum(hit)::BIGINT AS tp, count(*) AS n, sum(hit * precision) AS area FROM points GROUP BY slide),
r AS (SELECT slide, coalesce(tp, 0) AS tp, coalesce(n, 0) AS n, n_gt, coalesce(area, 0) / n_gt AS ap, coalesce(tp, 0) / greatest(coalesce(n, 0), 1) AS p, coalesce(tp, 0) / n_gt AS r FROM totals LEFT JOIN s USING (slide))
SELECT slide, tp, n - tp AS fp, n_gt - tp AS fn, round(ap, 6) AS ap, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def greedy_match_ap(spark, d):
    return matching.summary(*_greedy(spark, d)).withColumns(_r6("ap", "precision", "recall", "f1"))


@query(f"WITH RECURSIVE {CURVE} SELECT slide, rank, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points")
def pr_curve(spark, d):
    return matching.curve(*_greedy(spark, d)).select("slide", "rank", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall")])


@query(f"""WITH RECURSIVE {CURVE}, f AS (SELECT p.*, r.score, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM points p JOIN ranked r USING (slide, pred_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY f1 DESC, rank) AS n FROM f)
SELECT slide, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(score, 6) AS score, rank FROM b WHERE n = 1""")
def max_f1(spark, d):
    return matching.max_f1(matching.curve(*_greedy(spark, d))).withColumns(_r6("f1", "precision", "recall", "score"))


@query(f"""WITH RECURSIVE {CURVE}, ticks AS (SELECT i / 100.0::DOUBLE AS t FROM range(101) r(i)), best AS (SELECT slide, t, coalesce(max(precision) FILTER (recall >= t), 0) AS p FROM points, ticks GROUP BY slide, t)
SELECT slide, round(sum(p) / 101, 6) AS ap FROM best GROUP BY slide""")
def coco_ap101(spark, d):
    return matching.ap_101(matching.curve(*_greedy(spark, d))).withColumns(_r6("ap"))


@query(f"""WITH RECURSIVE {GREEDY.format(thresholds="[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]", most="WHERE r.rank <= 100")},
p AS (SELECT f.t, (f.gt_id IS NOT NULL)::INT AS hit, row_number() OVER (PARTITION BY f.t ORDER BY r.score DESC, f.slide, f.pred_id) AS pos FROM fold f JOIN ranked r ON r.slide = f.slide AND r.pred_id = f.pred_id WHERE f.rank > 0),
c AS (SELECT t, pos, sum(hit) OVER (PARTITION BY t ORDER BY pos) AS tp FROM p), x AS (SELECT t, tp / pos AS precision, tp / (SELECT count(*) FROM gt) AS recall FROM c),
ticks AS (SELECT i / 100.0::DOUBLE AS r FROM range(101) k(i)), best AS (SELECT t, r, coalesce(max(precision) FILTER (recall >= r), 0) AS p FROM x, ticks GROUP BY t, r), each AS (SELECT t, sum(p) / 101 AS ap FROM best GROUP BY t)
SELECT t AS threshold, round(ap, 6) AS ap FROM each UNION ALL SELECT NULL, round(avg(ap), 6) FROM each""")
def coco_ap(spark, d):
    return matching.coco_ap(*_pred_gt(spark, d)).withColumns(_r6("ap"))


def _scores(spark, d) -> DataFrame:
    return focus.score_planes(views.planes(spark, d), 8, 8)


METRICS = ("vol", "tenengrad", "pvol", "ptenengrad", "log")


@query(f"WITH {SCORES} SELECT tile, z, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM scores")
def focus_scores(spark, d):
    return _scores(spark, d).withColumns(_r6(*METRICS))


@query(f"WITH {SCORES} SELECT tile, z, row_number() OVER (PARTITION BY tile ORDER BY log DESC, z DESC) AS rank FROM scores")
def plane_ranking(spark, d):
    return focus.rank_planes(_scores(spark, d), "log", ["tile"]).select("tile", "z", "rank")


@query(f"WITH {SCORES} SELECT tile, z FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY tenengrad DESC, z DESC) AS rank FROM scores) WHERE rank <= 3")
def top_k_planes(spark, d):
    return focus.rank_planes(_scores(spark, d), "tenengrad", ["tile"]).where("rank <= 3").select("tile", "z")


_BEST_Z = "(SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {m} DESC, z) AS n FROM scores)"


@query(f"WITH {SCORES} SELECT tile, z AS best_z FROM {_BEST_Z.format(m='vol')} WHERE n = 1")
def best_plane(spark, d):
    return focus.best_plane(_scores(spark, d), "vol", ["tile"])


@query(f"WITH {PLANES}, long AS (SELECT tile, z, unnest(px) AS v, unnest(range(64)) AS i FROM planes), m AS (SELECT tile, i, max(v) AS v FROM long GROUP BY tile, i) SELECT tile, i, v FROM m")
def mip(spark, d):
    return focus.max_projection(views.planes(spark, d), ["tile"]).select("tile", F.posexplode("px").alias("i", "v"))


@query(f"""WITH {SCORES}, long AS (SELECT tile, z, unnest(px) AS v, unnest(lg) AS r, unnest(range(64)) AS i FROM energy)
SELECT tile, i, v FROM (SELECT *, row_number() OVER (PARTITION BY tile, i ORDER BY abs(r) DESC, z) AS n FROM long) WHERE n = 1""")
def focus_stack(spark, d):
    return focus.focus_stack(views.planes(spark, d), 8, 8, ["tile"]).select("tile", F.posexplode("px").alias("i", "v"))


@query(f"WITH {SCORES} SELECT z, round(avg(vol), 6) AS mean, round(stddev_pop(vol), 6) AS std, count(*) AS n FROM scores GROUP BY z")
def score_by_z(spark, d):
    return stats.score_by_z(_scores(spark, d), "vol").withColumns(_r6("mean", "std"))


@query(f"WITH {SCORES}, a AS (SELECT tile, z FROM {_BEST_Z.format(m='vol')} WHERE n = 1), b AS (SELECT tile, z FROM {_BEST_Z.format(m='tenengrad')} WHERE n = 1) SELECT count(*) FILTER (a.z = b.z) AS agree, count(*) AS n, round(count(*) FILTER (a.z = b.z) * 100.0 / greatest(count(*), 1), 6) AS percent FROM a JOIN b USING (tile)")
def metric_agreement(spark, d):
    best = _scores(spark, d).groupBy("tile").agg(F.max_by("z", F.struct("vol", -F.col("z"))).alias("vol_z"), F.max_by("z", F.struct("tenengrad", -F.col("z"))).alias("ten_z"))
    return stats.metric_agreement(best, "vol_z", "ten_z").withColumns(_r6("percent"))


@query(f"WITH {SCORES} SELECT tile, " + ", ".join(f"round(coalesce(max(tenengrad) FILTER (z = {k}), 0), 6) AS z{k}" for k in range(5)) + " FROM scores GROUP BY tile")
def score_matrix(spark, d):
    return stats.score_matrix(_scores(spark, d), "tile", "tenengrad", [0, 1, 2, 3, 4]).withColumns(_r6(*[f"z{k}" for k in range(5)]))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY vol DESC, z) AS n, row_number() OVER (PARTITION BY tile ORDER BY vol, z) AS m FROM scores),
s AS (SELECT tile, max(z) FILTER (n = 1) AS best_z, max(z) FILTER (m = 1) AS worst_z, max(vol) - min(vol) AS spread FROM r GROUP BY tile)
SELECT tile, best_z, worst_z, round(spread, 6) AS spread FROM s ORDER BY spread DESC, tile LIMIT 20""")
def best_worst_spread(spark, d):
    return stats.widest(stats.best_worst(_scores(spark, d), ["tile"], "vol"), "tile", 20).withColumns(_r6("spread"))


@query("SELECT event_type, round(sum(value), 4) AS total, round(sum(value) * 100.0 / sum(sum(value)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def class_distribution(spark, d):
    return stats.distribution(table(spark, d, "events"), "event_type", F.col("value")).withColumns({"total": F.round("total", 4), "percent": F.round("percent", 6)})


@query(f"""WITH {OBJECTS}, {REGIONS}, t AS (SELECT slide, sum(ceil(w / 256.0) * ceil(h / 256.0))::BIGINT AS n_tiles FROM regions GROUP BY slide), a AS (SELECT slide, count(*) AS n FROM objects GROUP BY slide)
SELECT t.slide, n_tiles, coalesce(n, 0) AS n_annotations, round(coalesce(n, 0) / n_tiles, 6) AS density FROM t LEFT JOIN a ON a.slide = t.slide""")
def density(spark, d):
    return stats.annotation_density(_regions(spark, d), views.objects(spark, d), "slide", 256).withColumns(_r6("density"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), p AS (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::INT AS bin, lo, hi FROM events, e WHERE value IS NOT NULL)
SELECT bin, round(min(lo + bin * ((hi - lo) / 30)), 6) AS low, count(*) AS n FROM p GROUP BY bin""")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 30).withColumns(_r6("low"))




@query("SELECT source AS split, count(*) AS n, " + ", ".join(f"count(*) FILTER (lang = '{k}') AS n_{k}" for k in ("en", "de", "fr", "es")) + ", count(*) FILTER (n_chars > 2000) AS n_flagged, round(count(*) FILTER (n_chars > 2000) * 100.0 / count(*), 6) AS percent_flagged, round(median(n_chars), 6) AS median_size, round(avg(n_chars), 6) AS mean_size FROM documents GROUP BY source")
def split_summary(spark, d):
    s = stats.split_summary(table(spark, d, "documents").withColumnRenamed("source", "split"), "split", "lang", ["en", "de", "fr", "es"], F.col("n_chars") > 2000, "n_chars")
    return s.withColumns(_r6("percent_flagged", "median_size", "mean_size"))


@query("""WITH l AS (SELECT lower(p_name) AS name, arg_max(p_type, p_partkey) AS category FROM part GROUP BY 1), c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS label FROM (SELECT DISTINCT p_type AS category FROM part))
SELECT name, category, label::INT AS label FROM l JOIN c USING (category)""")
def label_map(spark, d):
    return labels.label_map(table(spark, d, "part"), "p_name", "p_type", "p_partkey").withColumn("label", F.col("label").cast("int"))


@query(f"""WITH {OBJECTS}, k AS (SELECT slide, row_number() OVER (ORDER BY md5(slide || ':67'), slide) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT slide FROM objects))
SELECT slide, CASE WHEN k <= n - 2 * floor(n * 0.15::DOUBLE) THEN 'train' WHEN k <= n - floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def split_assign(spark, d):
    return labels.assign_splits(views.objects(spark, d), "slide")


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(replace(p_name || '.NDPI.ndpa', '.NDPI.ndpa', '')) || '-' || lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part""")
def normalize_name(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.normalize_name(F.concat("p_name", F.lit("-"), "p_brand", F.lit(".NDPI.ndpa"))).alias("name"))


@query("""WITH n AS (SELECT DISTINCT lower(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_')) AS a, p_name FROM part), c AS (SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS b, p_type FROM part),
s AS (SELECT p_name, p_type, a, b, string_split(a, '_') AS ta, string_split(b, '_') AS tb FROM n, c),
t AS (SELECT *, CASE WHEN a = b THEN 4 WHEN starts_with(a, b) OR starts_with(b, a) THEN 3 WHEN contains(a, b) OR contains(b, a) THEN 2 ELSE 1 END AS tier FROM s),
o AS (SELECT *, CASE tier WHEN 4 THEN 9999 WHEN 1 THEN len(list_intersect(list_distinct(ta), list_distinct(tb))) ELSE least(length(a), length(b)) END AS overlap,
  CASE tier WHEN 4 THEN 0 WHEN 1 THEN -abs(len(list_distinct(ta)) - len(list_distinct(tb))) ELSE -abs(length(a) - length(b)) END AS less FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY tier DESC, overlap DESC, less DESC, p_type) AS n FROM o)
SELECT p_name, CASE WHEN tier >= 2 OR overlap >= 1 THEN p_type END AS match, tier::INT AS tier, overlap::INT AS overlap FROM r WHERE n = 1""")
def fuzzy_match(spark, d):
    p = table(spark, d, "part")
    return labels.best_match(p.select("p_name").distinct(), p.select("p_type").distinct(), "p_name", "p_type", 1)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE round(o_totalprice, 2) END AS confidence FROM orders")
def parse_confidence(spark, d):
    text = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'confidence=abc' ELSE concat('source=x; confidence=nope;  confidence=', cast(round(o_totalprice, 2) as string), ' ; k') END")
    return table(spark, d, "orders").select("o_orderkey", labels.parse_confidence(text).alias("confidence"))


def _dataset(spark, d) -> tuple[DataFrame, DataFrame]:
    boxes = views.objects(spark, d).selectExpr("concat('s', cast(slide as string)) as file_name", "o_orderkey as ann_idx", "cast(o_orderkey % 3 + 1 as int) as label", "x", "y", "w", "h")
    images = writers.coco_images(views.objects(spark, d).selectExpr("concat('s', cast(slide as string)) as file_name", "2100 as width", "2100 as height"))
    return images, writers.coco_annotations(images, writers.select_boxes(boxes, False))


_IMAGES = "images AS (SELECT row_number() OVER (ORDER BY file_name) - 1 AS id, file_name FROM (SELECT DISTINCT 's' || slide AS file_name FROM objects))"


@query(f"WITH {OBJECTS}, {_IMAGES} SELECT id, file_name, 2100 AS width, 2100 AS height FROM images")
def coco_images(spark, d):
    return _dataset(spark, d)[0]


_ANNS = "anns AS (SELECT row_number() OVER (ORDER BY file_name, o_orderkey) - 1 AS id, i.id AS image_id, o_orderkey % 3 AS category_id, x, y, w, h, w * h AS area, 0 AS iscrowd, file_name FROM objects JOIN images i ON file_name = 's' || slide)"


@query(f"WITH {OBJECTS}, {_IMAGES}, {_ANNS} SELECT id, image_id, category_id, x, y, w, h, area, iscrowd FROM anns")
def coco_annotations(spark, d):
    return _dataset(spark, d)[1].withColumn("category_id", F.col("category_id").cast("long"))


@query(f"""WITH {OBJECTS}, {_IMAGES}, {_ANNS} SELECT file_name, string_agg(printf('%d %.6f %.6f %.6f %.6f', category_id, (x + w / 2) / 2100, (y + h / 2) / 2100, w / 2100, h / 2100), chr(10) ORDER BY id) AS text FROM anns GROUP BY file_name""")
def yolo_labels(spark, d):
    return writers.label_lines(*_dataset(spark, d))


@query("""WITH j AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) SELECT user_id, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) AS n FROM j WHERE k IS NOT NULL) WHERE n = 1""")
def json_log_best(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k")).where("k is not null")
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "k"), F.struct("k", -F.col("event_id"))).alias("m"))
    return best.select("user_id", "m.*")
