"""Predictions against ground truth: two matchers, curves, average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.functions.geometry import iou_eps, iou_plain
from tilewright.operators.ordered import numbered, running_sums
from tilewright.operators.spatial import BOX, CELL, spatial_join
from tilewright.operators.turns import settle
from tilewright.plans.storage import materialize


def candidates(pred: DataFrame, gt: DataFrame, by: list[str], iou, cell: float = CELL) -> DataFrame:
    """``by``, pred_id, gt_id and iou of all overlapping pairs."""
    pairs = spatial_join(pred.select(*by, "pred_id", *BOX), gt.select(*by, "gt_id", *BOX), by, cell)
    value = iou([F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX])
    return pairs.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.pred_id").alias("pred_id"), F.col("b.gt_id").alias("gt_id"), value.alias("iou"))


def best_of_match(pred: DataFrame, gt: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Two passes: each prediction takes its best box above the threshold, then each box its best prediction. Who loses
    a box gets no other. Ties go to the larger id."""
    pairs = candidates(pred, gt, by, iou_eps).where(F.col("iou") > threshold)
    first = Wd.partitionBy(*by, "pred_id").orderBy(F.desc("iou"), F.desc("gt_id"))
    second = Wd.partitionBy(*by, "gt_id").orderBy(F.desc("iou"), F.desc("pred_id"))
    pairs = pairs.withColumn("n", F.row_number().over(first)).where("n = 1")
    return pairs.withColumn("n", F.row_number().over(second)).where("n = 1").drop("n")


def false_positives(pred: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    return pred.join(matches, [*by, "pred_id"], "left_anti")


def false_negatives(gt: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    return gt.join(matches, [*by, "gt_id"], "left_anti")


def greedy_match(pred: DataFrame, gt: DataFrame, threshold: float, slide: str = "slide") -> DataFrame:
    """Every prediction with ``rank`` and ``gt_id`` (null: none): by falling score each takes the box of highest overlap
    that is still free, at the threshold or above; ties go to the smaller gt_id."""
    ranked = numbered(pred, [slide], [F.desc("score"), F.col("pred_id")], "rank", first=1)
    got = greedy_matches(ranked, gt, [threshold], slide)
    return ranked.join(got.select(slide, "pred_id", "gt_id"), [slide, "pred_id"], "left")


def greedy_matches(ranked: DataFrame, gt: DataFrame, thresholds: list[float], slide: str = "slide") -> DataFrame:
    """``slide``, threshold, pred_id and gt_id of the matches at each threshold, from predictions with ranks.

    Predictions choose boxes in turn (``turns.settle``), at all thresholds at once."""
    near = candidates(ranked, gt, [slide], iou_plain).where((F.col("iou") >= min(thresholds)) & (F.col("iou") > 0))
    near = near.join(ranked.select(slide, "pred_id", "rank"), [slide, "pred_id"])
    each = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("iou"))
    options = near.withColumn("threshold", F.explode(each)).select(slide, "threshold", "pred_id", "rank", "gt_id", "iou")
    return settle(options, [slide, "threshold"], "pred_id", "rank", "gt_id", [F.desc("iou"), F.col("gt_id")]).drop("rank")


def curve(matched: DataFrame, gt: DataFrame, slide: str = "slide") -> DataFrame:
    """Running tp, fp, precision and recall by rank."""
    totals = gt.groupBy(slide).agg(F.count("*").alias("n_gt"))
    hit = F.col("gt_id").isNotNull().cast("int")
    out = running_sums(matched.join(totals, slide).withColumn("hit", hit), [slide], [F.col("rank")], {"tp": F.col("hit")})
    return out.withColumns({"fp": F.col("rank") - F.col("tp"), "precision": F.col("tp") / F.col("rank"), "recall": F.col("tp") / F.col("n_gt")})


def summary(matched: DataFrame, gt: DataFrame, slide: str = "slide") -> DataFrame:
    """tp, fp, fn, ap (right rectangles), precision, recall and f1 for each slide that has ground truth.

    Slides without predictions have ap 0; ratios with an empty denominator are 0."""
    totals = gt.groupBy(slide).agg(F.count("*").alias("n_gt"))
    points = curve(matched, gt, slide)
    agg = points.groupBy(slide).agg(F.sum("hit").alias("tp"), F.count("*").alias("n_pred"), F.sum(F.col("hit") * F.col("precision")).alias("area"))
    out = totals.join(agg, slide, "left").na.fill(0, ["tp", "n_pred", "area"])
    p, r, f1 = ratios("tp", "n_pred", "n_gt")
    area = F.coalesce(F.try_divide(F.col("area"), F.col("n_gt")), F.lit(0.0))
    return out.select(slide, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), area.alias("ap"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def ratios(tp: str, n_pred: str, n_gt: str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counts; 0 where a denominator is."""
    ratio = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    p, r = ratio(F.col(tp), F.col(n_pred)), ratio(F.col(tp), F.col(n_gt))
    return p, r, ratio(2 * p * r, p + r)


def max_f1(points: DataFrame, slide: str = "slide") -> DataFrame:
    """The operating point of highest F1, the first on ties."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    best = points.withColumn("f1", f1).groupBy(slide).agg(F.max_by(F.struct("f1", "precision", "recall", "score", "rank"), F.struct("f1", -F.col("rank"))).alias("m"))
    return best.select(slide, "m.*")


def ap_101(points: DataFrame, slide: str = "slide") -> DataFrame:
    """Mean over the recalls 0, 0.01, ..., 1 of the highest precision at that recall or beyond (0 if none is).

    A point counts by how many of the recalls it reaches, so at most 102 numbers of each slide are looked at in order."""
    near = F.floor(F.col("recall") * 100).cast("int")
    last = F.when((near + 1) / F.lit(100.0) <= F.col("recall"), near + 1).when(near / F.lit(100.0) <= F.col("recall"), near).otherwise(near - 1)  # the product may be rounded past a recall
    reached = F.least(F.greatest(last, F.lit(-1)), F.lit(100)) + 1
    best = points.withColumn("reached", reached).groupBy(slide, "reached").agg(F.max("precision").alias("precision"))
    beyond = Wd.partitionBy(slide).orderBy(F.desc("reached")).rowsBetween(Wd.unboundedPreceding, Wd.currentRow)
    before = F.coalesce(F.lag("reached").over(Wd.partitionBy(slide).orderBy("reached")), F.lit(0))
    steps = best.select(slide, F.max("precision").over(beyond).alias("envelope"), (F.col("reached") - before).alias("count"))
    return steps.groupBy(slide).agg((F.sum(F.col("envelope") * F.col("count")) / 101).alias("ap"))


#: The overlap thresholds and detections by image of the usual dataset benchmark.
COCO_THRESHOLDS, MAX_DETS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10)), 100


def coco_ap(pred: DataFrame, gt: DataFrame, image: str = "slide", thresholds: tuple[float, ...] = COCO_THRESHOLDS, max_dets: int = MAX_DETS) -> DataFrame:
    """threshold and ap (101 points) over all images together, and a row with threshold null for their mean.

    Of each image the ``max_dets`` predictions of highest score take part; they are matched within their image, then
    ranked over all images by score, image and id. Candidates and clusters are found once, for the least threshold."""
    ranked = numbered(pred, [image], [F.desc("score"), F.col("pred_id")], "rank", first=1).where(F.col("rank") <= max_dets)
    ranked = materialize(ranked)
    got = greedy_matches(ranked, gt, list(thresholds), image)
    total = gt.agg(F.count("*").alias("n_gt"))  # one row
    every = ranked.select(image, "pred_id", "score").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    marked = every.join(got, [image, "pred_id", "threshold"], "left").withColumn("hit", F.col("gt_id").isNotNull().cast("int"))
    order = [F.desc("score"), F.col(image), F.col("pred_id")]
    points = running_sums(marked, ["threshold"], order, {"tp": F.col("hit"), "at": F.lit(1)}).crossJoin(F.broadcast(total))
    points = points.withColumns({"precision": F.col("tp") / F.col("at"), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("n_gt")), F.lit(0.0))})
    each = ap_101(points, "threshold")
    return each.unionByName(each.agg(F.avg("ap").alias("ap")).select(F.lit(None).cast("double").alias("threshold"), "ap"))
