"""Loss accounting: counters, summaries and conversion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.schemas import LOSS_CLASSES
from parchment.store import growing


def loss_by_class(events: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, a count for each of the five classes, total and status; with docs also for documents without events."""
    counted = events.groupBy("doc_id").agg(*[F.count_if(F.col("loss_class") == c).alias(c) for c in LOSS_CLASSES])
    if docs is not None:
        counted = docs.select("doc_id").join(growing(counted), "doc_id", "left").na.fill(0, list(LOSS_CLASSES))
    lost = sum((F.col(c) for c in LOSS_CLASSES[2:]), F.col(LOSS_CLASSES[1]))
    return counted.withColumn("total", lost + F.col("none")).withColumn("status", F.when(lost > 0, "partial").otherwise("complete"))


def by_feature(events: DataFrame, samples: int = 3) -> DataFrame:
    """doc_id, feature, n and the first distinct details: partial and final aggregation, in feature order."""
    details = F.array_sort(F.collect_list(F.when(F.col("detail") != "", F.struct("seq", "detail"))))
    first = F.slice(F.array_distinct(F.transform(details, lambda x: x["detail"])), 1, samples)
    return events.groupBy("doc_id", "feature").agg(F.count("*").alias("n"), first.alias("samples"))


def reports(events: DataFrame, source: str, target: str, engine: str = "parchment", docs: DataFrame | None = None) -> DataFrame:
    """doc_id and report: a JSON conversion report, one issue for each event that is not none; an unknown location is left out.

    With docs also for documents without events.
    """
    counts = loss_by_class(events, docs)
    issue = F.struct(F.format_string("iss_%04d", F.col("seq")).alias("id"), "feature", "loss_class", "action", "location", "detail")
    issues = events.where("loss_class <> 'none'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", issue.alias("issue")))).alias("_issues"))
    joined = counts.join(growing(issues), "doc_id", "left")
    body = F.struct(
        F.lit("1.0").alias("report_version"), F.lit("import").alias("direction"), F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(engine).alias("engine"), "status",
        F.struct(F.struct(*LOSS_CLASSES).alias("loss")).alias("summary"), F.coalesce(F.transform("_issues", lambda x: x["issue"]), F.array()).alias("issues"),
    )
    return joined.select("doc_id", F.to_json(body).alias("report"))


def summed(reports_: DataFrame) -> DataFrame:
    """doc_id, loss_class and n over all reports of a document."""
    loss = F.from_json(F.get_json_object("report", "$.summary.loss"), "map<string,long>")
    return reports_.select("doc_id", F.explode(loss).alias("loss_class", "n")).groupBy("doc_id", "loss_class").agg(F.sum("n").alias("n"))


def consistent(reports_: DataFrame) -> DataFrame:
    """doc_id and consistent: whether the issues of a report add up to its summary."""
    one = F.from_json("report", "struct<summary:struct<loss:map<string,long>>,issues:array<struct<loss_class:string>>>")
    lossy = F.array(*[F.lit(c) for c in LOSS_CLASSES[1:]])
    same = F.forall(lossy, lambda c: F.coalesce(one["summary"]["loss"][c], F.lit(0)) == F.size(F.filter(one["issues"], lambda i: i["loss_class"] == c)))
    return reports_.select("doc_id", same.alias("consistent"))
