"""Small documents beside a dataset: metadata, splits, class names, settings of trainers, results of trials.

A document is one value that a person or a trainer reads, so it is made from a table with one row for each of a few
names and written as one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.readers import coco_lines


def _one(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").text(path)


def metadata_document(labels: DataFrame, settings: dict[str, object], path: str) -> None:
    """``label_map`` (category to its number) from (category, label), beside the settings."""
    pairs = labels.select("category", "label").distinct().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "label")))).alias("label_map"))
    _one(pairs.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in settings.items()], "label_map")).alias("value")), path)


def label_map(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """id and name of the categories of a metadata document, by id; numbers count from ``base`` in datasets."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.label_map"), "map<string,int>").alias("m"))
    return text.select(F.explode("m").alias("name", "label")).select((F.col("label") + base).alias("id"), "name").orderBy("id")


def split_document(splits: DataFrame, path: str) -> None:
    """{split: [stem, ...]} with sorted stems."""
    lists = splits.groupBy("split").agg(F.sort_array(F.collect_list("stem")).alias("stems"))
    _one(lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "stems"))))).alias("value")), path)


def dataset_lines(categories: DataFrame, root: str, splits: dict[str, str]) -> DataFrame:
    """The lines of a trainer's dataset file in order: path, a line for each split, nc and names by id."""
    names = categories.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda c: c["name"]).alias("names"))
    listed = F.concat(F.lit("names: ["), F.array_join(F.transform("names", lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))
    head = [F.lit(f"path: {root}"), *[F.lit(f"{k}: {v}") for k, v in splits.items()]]
    return names.select(F.array(*head, F.format_string("nc: %d", F.size("names")), listed).alias("lines")).select(F.posexplode("lines").alias("nth", "value"))


def dataset_file(categories: DataFrame, root: str, splits: dict[str, str], path: str) -> None:
    lines = dataset_lines(categories, root, splits)
    _one(lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), "\n").alias("value")), path)


def _in_lines(jvm, files, path) -> bool:
    """Whether a file starts with the first line of documents that have an element in each line."""
    if not files.getFileStatus(path).isFile():
        return False
    start = files.open(path)
    try:
        return all(start.read() == c for c in b'{"images":[\n')
    finally:
        start.close()


def class_names(spark: SparkSession, paths: list[str]) -> list[str]:
    """Names of the categories, by id, in the first of the dataset documents that is there.

    One with an element in each line, as ``writers.coco_document`` writes it, is read in splits, any other one whole."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            if _in_lines(jvm, target.getFileSystem(conf), target):
                found = coco_lines(spark, path)[2]
            else:
                found = spark.read.schema("categories array<struct<id: bigint, name: string>>").json(path, multiLine=True).select(F.inline("categories"))
            return [r.name for r in found.select("id", "name").orderBy("id").collect()]
    raise FileNotFoundError(f"none of {', '.join(paths)} is there")


def metrics_document(metrics: DataFrame, path: str) -> None:
    """The one row of ``metrics`` as a JSON object."""
    _one(metrics.limit(1).select(F.to_json(F.struct(*metrics.columns)).alias("value")), path)


def trial_documents(trials: DataFrame, folder: str) -> None:
    """A line of JSON for each trial under ``trials``, and the best trial's parameters under ``best``."""
    from tilewright.sources.readers import best_trial

    trials.select(F.to_json(F.struct("trial", "score", "params")).alias("value")).write.mode("append").text(f"{folder}/trials")
    _one(best_trial(trials).select(F.to_json("params").alias("value")), f"{folder}/best")
