"""Voting and scores of predictions (cloud_id, epoch, point_id, prob or logits ARRAY<DOUBLE>, label).

Sums over points are taken with partial aggregation by class, so the scores shuffle only (cloud, class) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.keys import key_to_xyz, normalized, vector_sum, zeros


def exp_sum(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))


def softmax(logits: Column) -> Column:
    total, top = exp_sum(logits), F.array_max(logits)
    return F.transform(logits, lambda v: F.exp(v - top) / total)


def argmax(prob: Column) -> Column:
    """Index of the largest value, the first on ties."""
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """logsumexp - logit[label] of a row."""
    return F.log(exp_sum(logits)) + F.array_max(logits) - F.get(logits, label)


def mean_cross_entropy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg(cross_entropy(F.col("logits"), F.col("label"))).alias("loss"))


def accuracy(pred: DataFrame) -> DataFrame:
    """Share of rows whose ``pred`` equals ``label``."""
    return pred.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def class_counts(pred: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """For each group and class: intersection, union and label counts (rows by cell first, then by class)."""
    cells = pred.groupBy(*by, "pred", "label").agg(F.count("*").alias("n"))
    ends = F.array_distinct(F.array("pred", "label"))
    sides = cells.select(*by, "pred", "label", "n", F.explode(ends).alias("class")).where((F.col("class") >= 0) & (F.col("class") < classes))
    both = (F.col("pred") == F.col("class")) & (F.col("label") == F.col("class"))
    return sides.groupBy(*by, "class").agg(F.sum(F.when(both, F.col("n")).otherwise(0)).alias("intersection"), F.sum("n").alias("union"), F.sum(F.when(F.col("label") == F.col("class"), F.col("n")).otherwise(0)).alias("labels"))


def iou_per_shape(pred: DataFrame, classes: int) -> DataFrame:
    """Mean over the classes present in a cloud's labels of I / (U + 1e-10)."""
    present = class_counts(pred, classes, ["cloud_id"]).where("labels > 0")
    return present.groupBy("cloud_id").agg(F.avg(F.col("intersection") / (F.col("union") + 1e-10)).alias("iou"), F.count("*").alias("n_classes"))


def restore_clipped(points: DataFrame, pred: DataFrame, channels: int) -> DataFrame:
    """All points with their probabilities, zeros for those that were clipped away."""
    return points.select("cloud_id", "point_id").join(pred, ["cloud_id", "point_id"], "left").withColumn("prob", F.coalesce("prob", zeros(channels)))


def vote(pred: DataFrame, channels: int) -> DataFrame:
    """Probability vectors added over epochs."""
    return pred.groupBy("cloud_id", "point_id").agg(vector_sum("prob", channels).alias("prob"))


def merge_chunks(pred: DataFrame, chunks: DataFrame, channels: int) -> DataFrame:
    """Predictions of chunks (chunk_id, row_in_chunk) added up at the scene points that ``chunks`` maps them to."""
    return pred.join(chunks, ["cloud_id", "chunk_id", "row_in_chunk"]).groupBy("cloud_id", "point_id").agg(vector_sum("prob", channels).alias("prob"))


def decode_labels(pred: DataFrame, classes: DataFrame) -> DataFrame:
    """The original label id of the most probable class; ``classes`` (index, class_id) is a class list."""
    return pred.withColumn("index", argmax(F.col("prob"))).join(classes, "index", "left")


def part_miou(pred: DataFrame, mask: int, classes: int) -> DataFrame:
    """Mean over the classes above ``mask`` of sum I / (sum U + 1e-10) of the whole set; absent classes count zero."""
    spine = pred.sparkSession.range(mask + 1, classes).withColumnRenamed("id", "class")
    counts = class_counts(pred, classes, [])
    both = spine.join(counts, "class", "left")
    return both.agg(F.avg(F.coalesce("intersection", F.lit(0)) / (F.coalesce("union", F.lit(0)) + 1e-10)).alias("miou"))


def scene_iou(pred: DataFrame, class_ids: DataFrame) -> DataFrame:
    """Scene and class scores of points whose label is in the class list: (scene, class, score).

    A scene's score is its accuracy, a class's its IoU (zero if absent); then the unweighted means
    (both null: accuracy as ``mean_accuracy``, IoU as ``mean_iou``).
    """
    valid = pred.join(class_ids.withColumnRenamed("class_id", "label"), "label", "left_semi")
    cells = valid.groupBy("cloud_id", "pred", "label").agg(F.count("*").alias("n"))
    scenes = cells.groupBy("cloud_id").agg((F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    sides = cells.select("pred", "label", "n", F.explode(F.array_distinct(F.array("pred", "label"))).alias("class_id"))
    sums = sides.groupBy("class_id").agg((F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    classes = class_ids.join(sums, "class_id", "left").select("class_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    null = F.lit(None).cast("long")
    out = scenes.select(F.lit("scene").alias("kind"), F.col("cloud_id").cast("long").alias("id"), "score")
    out = out.unionByName(classes.select(F.lit("class").alias("kind"), F.col("class_id").cast("long").alias("id"), "score"))
    out = out.unionByName(scenes.agg(F.avg("score").alias("score")).select(F.lit("mean_accuracy").alias("kind"), null.alias("id"), "score"))
    return out.unionByName(classes.agg(F.avg("score").alias("score")).select(F.lit("mean_iou").alias("kind"), null.alias("id"), "score"))


def category_summary(scores: DataFrame) -> DataFrame:
    """Over categories (iou, n): the plain mean and the mean weighted by n."""
    return scores.agg(F.avg("iou").alias("category_mean"), (F.sum(F.col("iou") * F.col("n")) / F.sum("n")).alias("instance_mean"))


def parse_metric_log(lines: DataFrame, name: str) -> DataFrame:
    """The number after ``name:`` in the last line of each log (log, line_no, line) that has it."""
    number = F.regexp_extract("line", name.replace("/", "\\/") + r":\s*([-+0-9.eE]+)", 1)
    found = lines.withColumn("value", number).where("value <> ''")
    return found.groupBy("log").agg(F.max_by(F.col("value").cast("double"), "line_no").alias("value"))


def split_metrics(logits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cross entropy and accuracy of predicted occupancy (two logits a node) by depth."""
    both = logits.join(nodes.select("cloud_id", "depth", "key", F.col("nempty").cast("int").alias("label")), ["cloud_id", "depth", "key"])
    loss, hit = cross_entropy(F.col("logits"), F.col("label")), (argmax(F.col("logits")) == F.col("label")).cast("double")
    return both.groupBy("depth").agg(F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy"))


def signal_mse(pred: DataFrame, signal: DataFrame, channels: int) -> DataFrame:
    """Mean over leaves of the summed squared error."""
    both = pred.join(signal.select("cloud_id", "key", F.col("data").alias("truth")), ["cloud_id", "key"])
    error = sum(((F.col("data")[k] - F.col("truth")[k]) * (F.col("data")[k] - F.col("truth")[k]) for k in range(channels)), F.lit(0.0))
    return both.agg(F.avg(error).alias("mse"))


def total_loss(metrics: DataFrame) -> DataFrame:
    """Sum of the values (name, value) whose name contains ``loss``."""
    return metrics.where(F.col("name").contains("loss")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def decode_points(signal: DataFrame, depth: int) -> DataFrame:
    """Points from predicted normals and displacements (data: nx, ny, nz, d), in [-1, 1]."""
    normal = normalized(*[F.col("data")[k] for k in range(3)])
    at = key_to_xyz(F.col("key"), depth)
    moved = [(c + 0.5 + F.col("data")[3] * n) / 2.0 ** (depth - 1) - 1.0 for c, n in zip(at, normal)]
    return signal.select("cloud_id", "key", *[m.alias(c) for m, c in zip(moved, "xyz")], *[n.alias(f"n{c}") for n, c in zip(normal, "xyz")])


