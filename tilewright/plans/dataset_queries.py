"""Queries over slides, pages, tile stores, exports and products, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import catalogue, focus, labels, products, scan_order, spatial, stats
from tilewright.plans import export, views
from tilewright.plans.queries import METRICS, MEET, OBJECTS, PLANES, SCORES, _r6, _scores, _sql_taps, query
from tilewright.plans.storage import table
from tilewright.sources import documents, readers, writers

SLIDES = """slides AS (SELECT n_nationkey AS slide, 40000 + n_nationkey * 137 AS full_width, 30000 + n_nationkey * 91 AS full_height, (20 + 20 * (n_nationkey % 2))::DOUBLE AS objective_power,
  (n_nationkey % 4) * 0.125::DOUBLE AS mpp_x, (1 + n_nationkey % 3) * 0.25::DOUBLE AS mpp_y FROM nation)"""
PAGES = """pages AS (SELECT n_nationkey AS slide, (40 / 2 ^ m)::DOUBLE AS magnification, z - 2 AS z, k * 50 + m * 5 + z AS page
  FROM nation, range(4) a(m), range(5) b(z), range(2) c(k) WHERE m < 2 + n_nationkey % 3)"""
STORE = """store AS (SELECT vec_id // 5 AS tile, vec_id % 5 AS z, 's' || (vec_id // 5 // 20) AS stem, CASE WHEN vec_id // 5 % 7 = 0 THEN 'meta_' ELSE 'tile_' END || (vec_id // 5) AS "group",
  '/store/s' || (vec_id // 5 // 20) AS path FROM embeddings)"""
PLACED = f"{OBJECTS}, placed AS (SELECT *, (y // 384) * 10 + x // 384 AS tile FROM objects)"


def _slides(spark, d) -> DataFrame:
    return table(spark, d, "nation").selectExpr(
        "n_nationkey as slide", "40000 + n_nationkey * 137 as full_width", "30000 + n_nationkey * 91 as full_height", "cast(20 + 20 * (n_nationkey % 2) as double) as objective_power",
        "(n_nationkey % 4) * 0.125D as mpp_x", "(1 + n_nationkey % 3) * 0.25D as mpp_y",
    )


def _pages(spark, d) -> DataFrame:
    p = table(spark, d, "nation").selectExpr("n_nationkey as slide", "explode(sequence(0, cast(1 + n_nationkey % 3 as int))) as m").selectExpr("*", "explode(sequence(0, 4)) as z").selectExpr("*", "explode(sequence(0, 1)) as k")
    return p.selectExpr("slide", "40 / pow(2, m) as magnification", "z - 2 as z", "k * 50 + m * 5 + z as page")


def _store(spark, d) -> DataFrame:
    """Tiles of a store by plane: path, stem, group, tile, z and px."""
    p = views.planes(spark, d).selectExpr("tile", "z", "px", "concat('s', tile div 20) as stem", "concat(CASE WHEN tile % 7 = 0 THEN 'meta_' ELSE 'tile_' END, tile) as group")
    return p.withColumn("path", F.concat(F.lit("/store/"), "stem"))


def _placed(spark, d) -> DataFrame:
    return views.objects(spark, d).withColumn("tile", F.expr("(y div 384) * 10 + x div 384"))


@query(f"WITH {PAGES} SELECT o_orderkey, p.page FROM orders LEFT JOIN (SELECT slide, magnification, z, min(page) AS page FROM pages GROUP BY ALL) p ON p.slide = o_custkey % 25 AND p.magnification = 40 / 2 ^ (o_orderkey % 4) AND p.z = o_orderkey % 7 - 3")
def page_lookup(spark, d):
    asked = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 25 as slide", "40 / pow(2, o_orderkey % 4) as magnification", "o_orderkey % 7 - 3 as z")
    return catalogue.page_index(asked, _pages(spark, d)).select("o_orderkey", "page")


@query(f"WITH {SLIDES}, {PAGES} SELECT s.slide, CASE WHEN n > 0 THEN round_even(full_width * 10::DOUBLE / objective_power, 0)::INT END AS width, CASE WHEN n > 0 THEN round_even(full_height * 10::DOUBLE / objective_power, 0)::INT END AS height FROM slides s JOIN (SELECT slide, count(*) FILTER (magnification = 10) AS n FROM pages GROUP BY slide) p USING (slide)")
def image_sizes(spark, d):
    return catalogue.image_size(_slides(spark, d), _pages(spark, d), 10.0)


@query(f"WITH {PAGES} SELECT slide, string_agg(magnification::INT::VARCHAR, ',' ORDER BY magnification) AS magnifications FROM (SELECT DISTINCT slide, magnification FROM pages) GROUP BY slide")
def available_magnifications(spark, d):
    m = catalogue.available_magnifications(_pages(spark, d))
    return m.select("slide", F.array_join(F.transform("magnifications", lambda x: x.cast("int").cast("string")), ",").alias("magnifications"))


@query(f"WITH {PAGES} SELECT s_suppkey AS tile, z, page, row_number() OVER (PARTITION BY s_suppkey ORDER BY z)::INT - 1 AS nth FROM supplier JOIN pages ON slide = s_nationkey AND magnification = 20 AND page < 50")
def tile_planes(spark, d):
    tiles = table(spark, d, "supplier").selectExpr("s_suppkey as tile", "s_nationkey as slide")
    return catalogue.tile_planes(tiles, _pages(spark, d).where("magnification = 20 and page < 50"), ["slide"]).select("tile", "z", "page", "nth")


@query(f"WITH {PLANES} SELECT tile, string_agg(z::VARCHAR || ':' || px[1]::VARCHAR || ':' || len(px)::VARCHAR, ' ' ORDER BY z) AS stack FROM planes WHERE tile % 10 = 3 GROUP BY tile")
def stack_read(spark, d):
    p = views.planes(spark, d)
    read = catalogue.read_planes(p.where("tile % 10 = 3").select("tile"), p, ["tile"])
    parts = F.zip_with("zs", "stack", lambda z, s: F.concat_ws(":", z.cast("string"), s[0].cast("string"), F.size(s).cast("string")))
    return read.select("tile", F.array_join(parts, " ").alias("stack"))


@query(f"""WITH {STORE} SELECT DISTINCT path, stem, "group" FROM store WHERE starts_with("group", 'tile_')""")
def tile_jobs(spark, d):
    return catalogue.tile_jobs(_store(spark, d))


@query(f"""WITH {STORE} SELECT stem, "group", z FROM store WHERE stem = 's1' AND "group" = 'tile_25'""")
def tile_lookup(spark, d):
    return catalogue.tile_at(_store(spark, d), "s1/tile_25").select("stem", "group", "z")


@query(f"WITH {PLANES}, m AS (SELECT tile, max(px[1]) AS first FROM planes WHERE tile % 2 = 0 GROUP BY tile) SELECT DISTINCT tile, first FROM planes LEFT JOIN m USING (tile)")
def tile_products(spark, d):
    p = views.planes(spark, d)
    made = focus.max_projection(p.where("tile % 2 = 0"), ["tile"]).select("tile", F.col("px")[0].alias("first"))
    return catalogue.with_product(p.select("tile").distinct(), made, ["tile"])


@query(f"WITH {PLACED}, t AS (SELECT DISTINCT slide, k AS tile FROM objects, range(0, 60, 5) r(k)) SELECT t.slide, t.tile, count(o_orderkey) AS num_annotations FROM t LEFT JOIN placed p ON p.slide = t.slide AND p.tile = t.tile GROUP BY t.slide, t.tile")
def tile_annotation_counts(spark, d):
    o = _placed(spark, d)
    return catalogue.tile_counts(_tile_numbers(o), o, ["slide", "tile"], "slide")[0]


def _tile_numbers(o: DataFrame) -> DataFrame:
    return o.select("slide").distinct().selectExpr("slide", "explode(sequence(0L, 55L, 5L)) as tile")


@query(f"WITH {OBJECTS} SELECT DISTINCT slide, 12::BIGINT AS num_tiles FROM objects")
def slide_tile_counts(spark, d):
    o = _placed(spark, d)
    return catalogue.tile_counts(_tile_numbers(o), o, ["slide", "tile"], "slide")[1]


@query("SELECT max(n) AS max_planes FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id // 5)")
def max_planes(spark, d):
    return catalogue.max_planes(views.planes(spark, d), ["tile"])


@query(f"""WITH {PLACED}, c AS (SELECT slide * 100 + tile AS key, count(*) AS n FROM placed GROUP BY ALL)
SELECT key, 256 AS x, 156 AS y, 512 AS w, 512 AS h FROM c WHERE n > 2 ORDER BY md5(key || ':67'), key LIMIT 1""")
def picked_tile(spark, d):
    c = _placed(spark, d).groupBy((F.col("slide") * 100 + F.col("tile")).alias("key")).agg(F.count("*").alias("num_annotations"))
    return catalogue.pick_tile(c, "key", 67).select("key", *[v.alias(n) for v, n in zip(catalogue.centre_crop(F.lit(1024), F.lit(824), 512), "xywh", strict=True)])


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':5'), c_custkey LIMIT 20")
def seeded_sample(spark, d):
    return catalogue.sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 20, 5)


@query("SELECT c_custkey, nth FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS nth, count(*) OVER () AS n FROM customer) WHERE nth <= 25 OR nth > n - 25")
def head_and_tail(spark, d):
    return catalogue.head_and_tail(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "nth")


@query(f"WITH {SLIDES}, s AS (SELECT slide, full_width * mpp_x AS w, full_height * mpp_y AS h FROM slides WHERE mpp_x > 0 AND mpp_y > 0) SELECT slide, 'Width' AS dimension, round(w, 6) AS value FROM s UNION ALL SELECT slide, 'Height', round(h, 6) FROM s")
def slide_dimensions(spark, d):
    sizes = catalogue.physical_sizes(_slides(spark, d).withColumnsRenamed({"full_width": "width", "full_height": "height"}))
    return catalogue.dimensions(sizes).withColumns(_r6("value"))


@query(f"""WITH {OBJECTS}, {SLIDES}, j AS (SELECT o_orderkey, (w + h) * 250 AS d_nm, (w * 500 / 1000::DOUBLE / mpp_x + h * 500 / 1000::DOUBLE / mpp_y) / 2 AS px FROM objects o JOIN slides s ON s.slide = o.slide % 25 WHERE mpp_x > 0 AND mpp_y > 0)
SELECT o_orderkey, round(px, 6) AS diameter FROM j WHERE px BETWEEN 60 AND 120""")
def diameters(spark, d):
    o = views.objects(spark, d).withColumn("key", F.col("slide") % 25).join(_slides(spark, d).withColumnRenamed("slide", "key"), "key")
    px = G.diameter_px(F.col("w") * 500, F.col("h") * 500, "mpp_x", "mpp_y")
    return o.select("o_orderkey", px.alias("diameter")).where("diameter is not null").where(G.in_range("diameter", 60, 120)).withColumns(_r6("diameter"))


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN ' Stained ' WHEN 1 THEN 'no stained' WHEN 2 THEN 'not stained' WHEN 3 THEN 'stained' END"


@query("SELECT o_orderstatus, count(*) FILTER (o_orderkey % 5 IN (0, 3)) AS stained, count(*) FILTER (o_orderkey % 5 IN (1, 2)) AS not_stained FROM orders GROUP BY o_orderstatus")
def stain_counts(spark, d):
    o = table(spark, d, "orders").withColumn("status", catalogue.stain_group(F.expr(_STATUS)))
    return stats.folded_counts(o, "o_orderstatus", F.col("status"), {"stained": ["stained"], "not_stained": ["not stained"]})


@query("""WITH c AS (SELECT o_orderpriority AS class, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT class, round(coalesce(f * 100.0 / nullif(f + o + p, 0), 0), 6) AS f, round(coalesce(o * 100.0 / nullif(f + o + p, 0), 0), 6) AS o, round(coalesce(p * 100.0 / nullif(f + o + p, 0), 0), 6) AS p FROM c""")
def class_proportions(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("class")).agg(*[F.count_if(F.col("o_orderstatus") == k).alias(k.lower()) for k in "FOP"])
    return stats.proportions(c, "class", ["f", "o", "p"]).withColumns(_r6("f", "o", "p"))


@query("SELECT event_type, CASE WHEN sum(count(*)) OVER () > 0 THEN printf('%d (%.1f%%)', count(*), count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()) ELSE printf('%d', count(*)) END AS text FROM events GROUP BY event_type")
def percent_labels(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("whole"))
    return counted.crossJoin(F.broadcast(whole)).select("event_type", stats.percent_labels("n", F.col("whole")).alias("text"))  # one row


@query(f"WITH {OBJECTS} SELECT slide, count(*) AS n_before, count(*) FILTER (w > 40) AS n_after, count(*) FILTER (w <= 40) AS n_removed FROM objects GROUP BY slide")
def before_and_after(spark, d):
    o = views.objects(spark, d)
    return stats.before_and_after(o, o.where("w > 40"), ["slide"])


@query("SELECT p_partkey, 'b' || p_size AS a, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'base' END AS c FROM part")
def overlaid_settings(spark, d):
    base = F.create_map(F.lit("a"), F.concat(F.lit("b"), "p_size"), F.lit("c"), F.lit("base"))
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("c"), "p_brand")).otherwise(F.create_map().cast("map<string,string>"))
    merged = catalogue.overlay(base, over)
    return table(spark, d, "part").select("p_partkey", merged["a"].alias("a"), merged["c"].alias("c"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) OR NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier))")
def unused_candidates(spark, d):
    return catalogue.unused(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


GRID = "grid AS (SELECT n_nationkey AS slide, x.i AS ix, y.i AS iy, x.i * (300 + n_nationkey * 10) AS x, y.i * (310 + n_nationkey * 10) AS y, 400 AS w, 400 AS h FROM nation, range(5) x(i), range(4) y(i))"
ORDERED = f"{GRID}, placed AS (SELECT *, x AS x1, y AS y1, x + w AS x2, y + h AS y2, row_number() OVER (PARTITION BY slide ORDER BY iy, ix) - 1 AS nth FROM grid)"


def _grid(spark, d) -> DataFrame:
    g = table(spark, d, "nation").selectExpr("n_nationkey as slide", "explode(sequence(0L, 4L)) as ix").selectExpr("*", "explode(sequence(0L, 3L)) as iy")
    g = g.selectExpr("slide", "ix", "iy", "ix * (300 + slide * 10) as x", "iy * (310 + slide * 10) as y", "400L as w", "400L as h")
    return g.selectExpr("*", "x as x1", "y as y1", "x + w as x2", "y + h as y2")


@query(f"WITH {ORDERED} SELECT slide, ix, iy, nth FROM placed")
def reading_order(spark, d):
    return scan_order.reading_order(_grid(spark, d)).select("slide", "ix", "iy", "nth")


@query(f"WITH {ORDERED} SELECT a.slide, a.nth AS a, b.nth AS b FROM placed a JOIN placed b ON a.slide = b.slide AND a.nth < b.nth AND {MEET}")
def overlapping_tiles(spark, d):
    return scan_order.overlapping_tiles(scan_order.reading_order(_grid(spark, d)), 512.0)


@query(f"""WITH {ORDERED.replace("x.i * (300 + n_nationkey * 10) AS x, y.i * (310 + n_nationkey * 10) AS y", "x.i * 300 AS x, CASE WHEN x.i = 2 THEN 5000 ELSE 0 END + y.i * (310 + n_nationkey * 10) AS y")}
SELECT a.slide, a.nth AS a, b.nth AS b FROM placed a JOIN placed b ON a.slide = b.slide AND a.nth < b.nth AND {MEET}
WHERE b.nth < coalesce((SELECT min(c.nth) FROM placed c WHERE c.slide = a.slide AND c.nth > a.nth AND c.y >= a.y2), 1000000)""")
def overlapping_tiles_strict(spark, d):
    g = _grid(spark, d).withColumns({"x": F.expr("ix * 300"), "y": F.expr("CASE WHEN ix = 2 THEN 5000 ELSE 0 END + iy * (310 + slide * 10)")})
    return scan_order.overlapping_tiles(scan_order.reading_order(g.selectExpr("slide", "ix", "iy", "w", "h", "x", "y", "x as x1", "y as y1", "x + w as x2", "y + h as y2")), 512.0, strict_scan=True)


#: Every fourth tile lies left of the one before it, so a row's x rise and fall.
SHUFFLED = f"{ORDERED}, shuffled AS (SELECT * REPLACE (CASE WHEN ix = 3 THEN x - 700 - slide ELSE x END AS x) FROM placed)"


@query(f"""WITH RECURSIVE {SHUFFLED}, walk AS (SELECT slide, nth, x, y, h, x AS bx, x + w AS bx2, nth AS first FROM shuffled WHERE nth = 0
UNION ALL SELECT slide, nth, x, y, h, CASE WHEN same THEN bx ELSE x END, CASE WHEN same THEN greatest(bx2, x + w) ELSE x + w END, CASE WHEN same THEN first ELSE nth END
FROM (SELECT p.*, k.bx, k.bx2, k.first, k.y = p.y AND k.h = p.h AND p.x + p.w - k.bx <= 1100 AS same FROM walk k JOIN shuffled p ON p.slide = k.slide AND p.nth = k.nth + 1) p)
SELECT slide, row_number() OVER (PARTITION BY slide ORDER BY first) - 1 AS band, min(bx) AS x, max(y) AS y, max(bx2) - min(bx) AS w, max(h) AS h, count(*) AS n FROM walk GROUP BY slide, first""")
def bands(spark, d):
    ordered = scan_order.reading_order(_grid(spark, d)).withColumn("x", F.expr("CASE WHEN ix = 3 THEN x - 700 - slide ELSE x END"))
    return scan_order.bands(ordered, 1100).select("slide", "band", "x", "y", "w", "h", F.size("tiles").cast("long").alias("n"))


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
TURNS = f"""n AS (SELECT p_partkey AS o, p_name || ' ' || p_type || ' ' || p_partkey % 40 AS name FROM part), c AS (SELECT DISTINCT p_name || '-' || p_partkey % 40 AS cand FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT name, cand, a, b, string_split(a, '_') AS ta, string_split(b, '_') AS tb FROM (SELECT DISTINCT name, {_NORM.format("name")} AS a FROM n), (SELECT cand, {_NORM.format("cand")} AS b FROM c)),
t AS (SELECT *, CASE WHEN a = b THEN 4 WHEN starts_with(a, b) OR starts_with(b, a) THEN 3 WHEN contains(a, b) OR contains(b, a) THEN 2 ELSE 1 END AS tier FROM s),
u AS (SELECT *, CASE tier WHEN 4 THEN 9999 WHEN 1 THEN len(list_intersect(list_distinct(ta), list_distinct(tb))) ELSE least(length(a), length(b)) END AS overlap,
  CASE tier WHEN 4 THEN 0 WHEN 1 THEN -abs(len(list_distinct(ta)) - len(list_distinct(tb))) ELSE -abs(length(a) - length(b)) END AS less FROM t),
good AS (SELECT name, list(cand ORDER BY tier DESC, overlap DESC, less DESC, cand) AS options FROM u WHERE tier >= 2 OR overlap >= 2 GROUP BY name),
asked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o) AS k, o, name, coalesce(options, []) AS options FROM n LEFT JOIN good USING (name)),
fold AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS pick UNION ALL
  SELECT k, CASE WHEN pick IS NULL OR list_contains(used, pick) THEN used ELSE list_append(used, pick) END, pick FROM (SELECT a.k, f.used, CASE WHEN len(f.used) = (SELECT count(*) FROM c) THEN a.options[1] ELSE list_filter(a.options, lambda x: NOT list_contains(f.used, x))[1] END AS pick FROM fold f JOIN asked a ON a.k = f.k + 1))"""


def _turns(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    names = p.selectExpr("p_partkey as o", "concat(p_name, ' ', p_type, ' ', p_partkey % 40) as name")
    return names, p.where("p_partkey % 3 = 0").selectExpr("concat(p_name, '-', p_partkey % 40) as cand", "p_partkey", "p_brand")


@query(f"WITH RECURSIVE {TURNS} SELECT o, name, pick AS match FROM fold JOIN asked USING (k)")
def match_in_order(spark, d):
    names, rows = _turns(spark, d)
    return labels.match_in_order(names, rows, "name", "cand", "o")


@query(f"""WITH RECURSIVE {TURNS}, rows AS (SELECT p_name || '-' || p_partkey % 40 AS cand, p_partkey, p_brand, row_number() OVER (PARTITION BY p_name || '-' || p_partkey % 40 ORDER BY p_partkey) AS t, count(*) OVER (PARTITION BY p_name || '-' || p_partkey % 40) AS many FROM part WHERE p_partkey % 3 = 0),
best AS (SELECT o, options[1] AS cand, row_number() OVER (PARTITION BY options[1] ORDER BY o) AS t FROM asked)
SELECT asked.o, once.p_partkey AS once_key, turn.p_partkey AS turn_key FROM fold JOIN asked USING (k) LEFT JOIN rows once ON once.cand = pick AND once.t = 1 JOIN best ON best.o = asked.o LEFT JOIN rows turn ON turn.cand = best.cand AND turn.t = CASE WHEN best.t > turn.many THEN 1 ELSE best.t END""")
def sample_metadata(spark, d):
    """One source whose keys are taken once, and one whose rows are taken in turn."""
    names, rows = _turns(spark, d)
    found = labels.attach_metadata(names, "name", {"one": (rows, "cand"), "turn": (rows, "cand")}, order="o", once=("one",))
    return found.select("o", F.col("one.p_partkey").alias("once_key"), F.col("turn.p_partkey").alias("turn_key"))


@query(f"WITH {OBJECTS} SELECT o_orderkey, x + w AS x2, y + h AS y2, w AS bw, round((x + w / 2) / 2100, 6) AS cx, round(h / 2100, 6) AS ch, x - w AS circle_x, w * 2 AS circle_w, x <= 0 OR y <= 0 OR x + w >= 1990 OR y + h >= 1990 AS edge, w - 40 <= 0 OR h <= 0 AS empty, least(greatest(x - 900, 0), 255)::INT AS byte FROM objects")
def box_forms(spark, d):
    o = views.objects(spark, d).drop("x1", "y1", "x2", "y2")
    c = G.corners("x", "y", "w", "h")
    n, r = G.to_normalised("x", "y", "w", "h", F.lit(2100), F.lit(2100)), G.circle_to_box("x", "y", "w")
    return o.select(
        "o_orderkey", c[2].alias("x2"), c[3].alias("y2"), G.sides(*c)[2].alias("bw"), F.round(n[0], 6).alias("cx"), F.round(n[3], 6).alias("ch"), r[0].alias("circle_x"), r[2].alias("circle_w"),
        G.touches_edge("x", "y", "w", "h", F.lit(1990), F.lit(1990)).alias("edge"), G.is_empty_crop(F.col("w") - 40, "h").alias("empty"), G.to_uint8(F.col("x") - 900).alias("byte"),
    )


_INTER = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"


@query(f"WITH {OBJECTS}, p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, {_INTER} AS i, (a.w * a.h + b.w * b.h)::DOUBLE AS s FROM objects a JOIN objects b ON a.slide = b.slide AND a.o_orderkey <> b.o_orderkey) SELECT a, b, round(i / (s - i), 6) AS plain, round(i / (s - i + 1e-7::DOUBLE), 6) AS eps FROM p WHERE i > 0")
def iou_matrix(spark, d):
    """All boxes of a slide against all; pairs that are not there are apart."""
    o = views.objects(spark, d).select("slide", "o_orderkey", "x1", "y1", "x2", "y2")
    m = spatial.iou_matrix(o, o, ["slide"], "o_orderkey").where("a <> b")
    return m.select("a", "b", F.round("plain", 6).alias("plain"), F.round("eps", 6).alias("eps"))


@query(f"""WITH {STORE} SELECT tile, z, printf('%s_%s_z%02d.png', stem, "group", z::INT) AS name, CASE lower(stem) WHEN 's0' THEN 4 WHEN 's1' THEN 7 ELSE -1 END AS label FROM store""")
def image_names(spark, d):
    return _store(spark, d).select("tile", "z", writers.image_name("stem", "group", "z", "png").alias("name"), labels.map_label(F.upper("stem"), {"s0": 4, "s1": 7}).alias("label"))


def _aperture_sql() -> str:
    grad = lambda k: " + ".join(f"({_sql_taps(g, 'px')}) * ({_sql_taps(g, 'px')})" for g in focus.sobel(k))
    parts = ", ".join(f"round(list_sum([{grad(k)} FOR i IN range(64)]) / 64.0::DOUBLE, 6) AS t{k}" for k in (1, 5, 7))
    whole = {k: sum(focus.GAUSS[k]) ** 2 for k in (3, 7)}
    blurred = ", ".join(f"[({_sql_taps(focus.blur(k), 'px')} + {whole[k] // 2}) // {whole[k]} FOR i IN range(64)] AS b{k}" for k in (3, 7))
    logs = ", ".join(f"round(list_sum([abs({_sql_taps(focus.laplace(k), f'b{k}')}) FOR i IN range(64)]) / 64.0::DOUBLE, 6) AS l{k}" for k in (3, 7))
    return f"WITH {PLANES}, b AS (SELECT *, {blurred} FROM planes) SELECT tile, z, {parts}, {logs} FROM b"


@query(_aperture_sql())
def kernel_apertures(spark, d):
    return focus.aperture_scores(views.planes(spark, d), 8, 8, (1, 5, 7), (3, 7)).withColumns(_r6("t1", "t5", "t7", "l3", "l7"))


@query(f"WITH {SCORES}, b AS (SELECT tile, z FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY log DESC, z DESC) AS n FROM scores) WHERE n = 1) SELECT b.tile, unnest(range(64))::INT AS i, unnest(px) AS v FROM b JOIN planes p ON p.tile = b.tile AND p.z = b.z")
def compress_best_plane(spark, d):
    return products.compression("best_plane")(views.planes(spark, d), 8, 8, ["tile"]).select("tile", F.posexplode("px").alias("i", "v"))


_RANKED = ", ".join(f"string_agg(z::VARCHAR, ',' ORDER BY {m} DESC, z DESC) AS rank_{m}" for m in ("log", "vol", "tenengrad"))


@query(f"""WITH {SCORES}, r AS (SELECT tile, {_RANKED} FROM scores GROUP BY tile), l AS (SELECT tile, z, unnest(px) AS v, unnest(lg) AS r, unnest(range(64)) AS i FROM energy),
m AS (SELECT tile, i, max(v) AS v, arg_max(v, (abs(r), -z)) AS s FROM l GROUP BY tile, i), t AS (SELECT tile, sum(v * (i + 1))::BIGINT AS mip, sum(s * (i + 1))::BIGINT AS stacked FROM m GROUP BY tile)
SELECT tile, rank_log, rank_vol, rank_tenengrad, mip, stacked FROM r JOIN t USING (tile)""")
def tile_product_set(spark, d):
    made = products.make_products(views.planes(spark, d), 8, 8, ["tile"])
    weigh = lambda c: F.aggregate(F.zip_with(c, F.sequence(F.lit(1), F.lit(64)), lambda v, i: v * i), F.lit(0).cast("long"), lambda a, v: a + v)
    ranks = [F.array_join(F.transform(k, lambda z: z.cast("string")), ",").alias(k) for k in products.RANKINGS]
    return made.select("tile", *ranks, weigh("mip").alias("mip"), weigh("stacked").alias("stacked"))


@query(f"WITH {SCORES} SELECT tile, z, row_number() OVER (PARTITION BY tile ORDER BY vol DESC, z DESC) AS rank FROM scores")
def plane_ranking_vol(spark, d):
    return focus.rank_planes(_scores(spark, d), "vol", ["tile"]).select("tile", "z", "rank")


def _named_scores(spark, d) -> DataFrame:
    return _scores(spark, d).selectExpr("concat('s', tile div 20) as stem", "tile", "z", *METRICS)


_CHOICES = {"planes": export.PlaneChoice.parse("planes", "1, 3,9"), "best": export.PlaneChoice("best_plane", metric="vol"), "top": export.PlaneChoice("top_k_planes", top_k=2, metric="tenengrad"), "all": export.PlaneChoice("all_planes")}
_PICK = "SELECT '{n}' AS choice, tile, z FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY {m} DESC, z DESC) AS n FROM scores) WHERE {w}"


@query(f"WITH {SCORES} " + " UNION ALL ".join(_PICK.format(n=n, m=m, w=w) for n, m, w in (("planes", "log", "z IN (1, 3, 9)"), ("best", "vol", "n = 1"), ("top", "tenengrad", "n <= 2"), ("all", "log", "true"))))
def plane_choices(spark, d):
    parts = [export.choose_planes(_named_scores(spark, d), c, ["stem", "tile"]).select(F.lit(n).alias("choice"), "tile", "z") for n, c in _CHOICES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_SPLIT = "CASE tile // 20 % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'train' END"
EXPORT = f"""{SCORES}, b AS (SELECT tile, z FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY log DESC, z DESC) AS n FROM scores) WHERE n = 1),
images AS (SELECT {_SPLIT} AS split, 's' || (tile // 20) AS stem, tile, z, printf('s%d_tile_%d_z%02d.jpg', tile // 20, tile, z::INT) AS file_name FROM b WHERE tile // 20 % 4 < 3)"""


def _export(spark, d):
    scores = _named_scores(spark, d)
    splits = scores.select("stem", (F.expr("tile div 20") % 4).alias("k")).distinct().where("k < 3").select("stem", F.expr("CASE k WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END").alias("split"))
    boxes = views.objects(spark, d).selectExpr("concat('s', (o_orderkey % 500) div 20) as stem", "o_orderkey % 500 as tile", "o_orderkey as ann_idx", "cast(o_orderkey % 4 as int) as label", "x", "y", "w - 26 as w", "h - 24 as h", "w as full_w", "h as full_h")
    return scores, splits, boxes


@query(f"WITH {EXPORT} SELECT split, stem, tile, z, file_name FROM images")
def export_images(spark, d):
    scores, splits, boxes = _export(spark, d)
    return export.dataset_records(scores, boxes, splits, export.PlaneChoice("best_plane"))[0]


@query(f"""WITH {OBJECTS}, {EXPORT} SELECT file_name, o_orderkey AS ann_idx, o_orderkey % 4 - 1 AS category_id, x, y, w - 26 AS w, h - 24 AS h FROM objects o JOIN images i ON i.tile = o_orderkey % 500
WHERE (w - 26) * (h - 24) >= 16 AND ((w - 26) * (h - 24))::DOUBLE / (w * h) > 0.25""")
def export_boxes(spark, d):
    scores, splits, boxes = _export(spark, d)
    return export.dataset_records(scores, boxes, splits, export.PlaneChoice("best_plane"))[1]


@query(f"""WITH {PLANES}, t AS (SELECT DISTINCT tile FROM planes UNION SELECT 100000), s AS (SELECT tile, max((z = 3)::INT) AS found FROM planes WHERE tile % 9 <> 0 AND NOT (tile % 9 = 1 AND z = 3) GROUP BY tile)
SELECT 's' || (t.tile // 20) AS stem, t.tile, CASE WHEN t.tile // 20 % 4 = 3 OR t.tile = 100000 THEN 'no split' WHEN found IS NULL THEN 'no planes' ELSE 'no such plane' END AS skip_reason FROM t LEFT JOIN s USING (tile) WHERE t.tile // 20 % 4 = 3 OR t.tile = 100000 OR coalesce(found, 0) = 0""")
def skipped_tiles(spark, d):
    scores, splits, _ = _export(spark, d)
    tiles = scores.select("stem", "tile").distinct().unionByName(spark.sql("SELECT 's5000' AS stem, 100000L AS tile"))
    return export.skipped_tiles(tiles, scores.where("tile % 9 <> 0 and not (tile % 9 = 1 and z = 3)"), splits, export.PlaneChoice("plane", (3,)))


@query(f"WITH {OBJECTS} SELECT 's' || s.slide AS file_name, coalesce(string_agg(o_orderkey || ':' || (x + w), ' ' ORDER BY o_orderkey), '') AS boxes FROM (SELECT DISTINCT slide FROM objects UNION SELECT -1) s LEFT JOIN objects o ON o.slide = s.slide GROUP BY s.slide")
def ground_truth(spark, d):
    o = views.objects(spark, d)
    images = o.select(F.col("slide").alias("id")).distinct().unionByName(spark.sql("SELECT -1L AS id")).withColumn("file_name", F.concat(F.lit("s"), "id"))
    annotations = o.select(F.col("o_orderkey").alias("id"), F.col("slide").alias("image_id"), F.array("x", "y", "w", "h").alias("bbox"), F.col("o_orderkey").alias("category_id"))
    boxes = readers.coco_ground_truth(images, annotations)
    return boxes.select("file_name", F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", b["cls"].cast("string"), b["x2"].cast("string"))), " ").alias("boxes"))


@query("SELECT o_orderkey AS trial, o_totalprice::DOUBLE AS score FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def best_trial(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("double")).alias("score"), F.create_map(F.lit("p"), "o_orderstatus").alias("params"))
    return readers.best_trial(t).select("trial", "score")


@query("SELECT o_orderkey::INT AS epoch, (o_custkey % 50)::DOUBLE AS ap FROM orders ORDER BY o_custkey % 50 DESC, o_orderkey LIMIT 1")
def best_epoch(spark, d):
    return readers.best_epoch(table(spark, d, "orders").selectExpr("cast(o_orderkey as int) as epoch", "cast(o_custkey % 50 as double) as ap"), "ap")


@query("""WITH c AS (SELECT DISTINCT p_type AS name FROM part), n AS (SELECT list(name ORDER BY name) AS names, count(*) AS k FROM c)
SELECT unnest(range(4))::INT AS nth, unnest(['path: /data', 'train: images/train', 'nc: ' || k, 'names: [' || array_to_string([chr(39) || x || chr(39) FOR x IN names], ', ') || ']']) AS value FROM n""")
def dataset_lines(spark, d):
    c = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct().withColumn("id", F.col("name"))
    return documents.dataset_lines(c, "/data", {"train": "images/train"})
