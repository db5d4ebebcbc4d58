"""Queries of voting and scores (E), on class logits taken from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.jobs.octree_jobs import INPUT
from voxmill.jobs.registry import query, r, rounded
from voxmill.jobs.tables import CLOUD_L, DEPTH, INSIDE, cloud_l, leaf, leaf_sql, nodes, nodes_sql, table, xyz_sql
from voxmill.operators import metrics as M
from voxmill.operators import octree as O
from voxmill.operators import points as P

CLASSES, EPOCHS = 10, 6


def pred(spark, d) -> DataFrame:
    """cloud_id, epoch, point_id, logits, label: six epochs of ten logits each."""
    t = table(spark, d, "embeddings")
    epochs = F.array(*[F.struct(F.lit(e).alias("epoch"), F.array(*[F.col("embedding")[10 * e + k].cast("double") * 4 for k in range(CLASSES)]).alias("logits")) for e in range(EPOCHS)])
    return t.select((F.col("vec_id") % 20).alias("cloud_id"), F.col("vec_id").alias("point_id"), "label", F.explode(epochs).alias("x")).select("cloud_id", "point_id", "label", "x.*")


PRED = f"(SELECT vec_id % 20 AS cloud_id, vec_id AS point_id, label, e::INT AS epoch, list_transform(embedding[10 * e + 1 : 10 * e + 10], lambda v: v::DOUBLE * 4) AS logits FROM embeddings, range({EPOCHS}) AS t(e))"
TOTAL = "list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))"
PROB = f"(SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits)) / {TOTAL}) AS prob FROM {PRED})"
LONG = [f"prob[{k + 1}] AS p{k}" for k in range(CLASSES)]


def probs(spark, d) -> DataFrame:
    return pred(spark, d).withColumn("prob", M.softmax(F.col("logits")))


def long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[rounded(F.col("prob")[k], f"p{k}") for k in range(CLASSES)])


@query("e1_softmax", f"SELECT cloud_id, epoch, point_id, {r(*LONG)} FROM {PROB}")
def e1(spark, d):
    return long(probs(spark, d), "cloud_id", "epoch", "point_id")


BEST = f"(SELECT *, list_position(logits, list_max(logits))::INT - 1 AS pred FROM {PRED})"


def best(spark, d) -> DataFrame:
    return pred(spark, d).withColumn("pred", M.argmax(F.col("logits")))


@query("e2_argmax_label", f"SELECT cloud_id, epoch, point_id, pred FROM {BEST}")
def e2(spark, d):
    return best(spark, d).select("cloud_id", "epoch", "point_id", "pred")


@query("e3_accuracy", f"SELECT {r('avg((pred = label)::INT) AS accuracy')} FROM {BEST}")
def e3(spark, d):
    return M.accuracy(best(spark, d)).select(rounded("accuracy"))


# labels are drawn near the predictions so that scores are not all chance
NEAR = f"(SELECT cloud_id, point_id, epoch, pred, CASE WHEN (point_id * 7 + epoch) % 3 = 0 THEN label ELSE pred END AS label FROM {BEST})"


def near(spark, d) -> DataFrame:
    hit = (F.col("point_id") * 7 + F.col("epoch")) % 3 == 0
    return best(spark, d).select("cloud_id", "point_id", "epoch", "pred", F.when(hit, F.col("label")).otherwise(F.col("pred")).alias("label"))


def counts_sql(by: str, classes: int = CLASSES, source: str = NEAR) -> str:
    keys = f"{by}, " if by else ""
    return f"(SELECT {keys}c AS class, count(*) FILTER (WHERE pred = c AND label = c) AS i, count(*) FILTER (WHERE pred = c OR label = c) AS u, count(*) FILTER (WHERE label = c) AS n FROM {source}, range({classes}) AS t(c) GROUP BY {keys}c)"


@query("e4_iou_per_shape", f"SELECT cloud_id, {r('avg(i / (u + 1e-10)) AS iou')}, count(*) AS n_classes FROM {counts_sql('cloud_id')} WHERE n > 0 GROUP BY cloud_id")
def e4(spark, d):
    return M.iou_per_shape(near(spark, d), CLASSES).select("cloud_id", rounded("iou"), "n_classes")


@query("e4_class_counts", f"SELECT cloud_id, class, i AS intersection, u AS \"union\", n AS labels FROM {counts_sql('cloud_id')} WHERE u > 0")
def e4b(spark, d):
    return M.class_counts(near(spark, d), CLASSES, ["cloud_id"]).select("cloud_id", F.col("class").cast("long").alias("class"), "intersection", "union", "labels")


@query("e5_restore_clipped", f"SELECT cloud_id, point_id, {r(f'CASE WHEN {INSIDE} THEN x ELSE 0 END AS p0', f'CASE WHEN {INSIDE} THEN y ELSE 0 END AS p1')} FROM {CLOUD_L}")
def e5(spark, d):
    points = cloud_l(spark, d)
    inside = P.clip(points).select("cloud_id", "point_id", F.array("x", "y").alias("prob"))
    return M.restore_clipped(points, inside, 2).select("cloud_id", "point_id", *[rounded(F.col("prob")[k], f"p{k}") for k in (0, 1)])


VOTED = f"(SELECT cloud_id, point_id, {', '.join(f'sum(prob[{k + 1}]) AS p{k}' for k in range(CLASSES))} FROM {PROB} GROUP BY cloud_id, point_id)"


@query("e6_vote", f"SELECT cloud_id, point_id, {r(*[f'p{k}' for k in range(CLASSES)])} FROM {VOTED}")
def e6(spark, d):
    return long(M.vote(probs(spark, d), CLASSES), "cloud_id", "point_id")


# chunk e % 2 of a scene holds the points of epoch e; rows in a chunk are numbered by point and epoch
CHUNKED = f"(SELECT *, epoch % 2 AS chunk_id, point_id * 10 + epoch AS row_in_chunk FROM {PROB} WHERE (point_id + epoch) % 4 <> 0)"


@query("e7_merge_chunks", f"SELECT cloud_id, point_id, {r(*[f'sum(prob[{k + 1}]) AS p{k}' for k in range(CLASSES)])} FROM {CHUNKED} GROUP BY cloud_id, point_id")
def e7(spark, d):
    rows = probs(spark, d).withColumns({"chunk_id": F.col("epoch") % 2, "row_in_chunk": F.col("point_id") * 10 + F.col("epoch")})
    chunks = rows.where((F.col("point_id") + F.col("epoch")) % 4 != 0).select("cloud_id", "chunk_id", "row_in_chunk", "point_id")
    return long(M.merge_chunks(rows.select("cloud_id", "chunk_id", "row_in_chunk", "prob"), chunks, CLASSES), "cloud_id", "point_id")


def class_list(spark) -> DataFrame:
    return spark.range(CLASSES).select(F.col("id").cast("int").alias("index"), (F.col("id") * 3 + 1).cast("int").alias("class_id"))


@query("e8_decode_labels", f"SELECT cloud_id, epoch, point_id, pred * 3 + 1 AS class_id FROM {BEST}")
def e8(spark, d):
    return M.decode_labels(probs(spark, d), class_list(spark)).select("cloud_id", "epoch", "point_id", "class_id")


@query("e9_part_miou", f"SELECT {r('avg(i / (u + 1e-10)) AS miou')} FROM {counts_sql('', 12)} WHERE class >= 2")
def e9(spark, d):
    return M.part_miou(near(spark, d), 1, 12).select(rounded("miou"))


_ids = "(SELECT * FROM (VALUES (1), (2), (3), (5), (8), (77)) AS t(class_id))"
_valid = f"(SELECT * FROM {NEAR} WHERE label IN (SELECT class_id FROM {_ids}))"
_scenes = f"(SELECT cloud_id, avg((pred = label)::INT) AS score FROM {_valid} GROUP BY cloud_id)"
_classes = f"(SELECT class_id, coalesce(count(*) FILTER (WHERE pred = class_id AND label = class_id) / nullif(count(*) FILTER (WHERE pred = class_id OR label = class_id), 0), 0) AS score FROM {_ids} LEFT JOIN {_valid} ON true GROUP BY class_id)"


@query("e10_scene_iou", f"""SELECT 'scene' AS kind, cloud_id::BIGINT AS id, {r('score')} FROM {_scenes} UNION ALL SELECT 'class', class_id, {r('score')} FROM {_classes}
 UNION ALL SELECT 'mean_accuracy', NULL, {r('avg(score) AS score')} FROM {_scenes} UNION ALL SELECT 'mean_iou', NULL, {r('avg(score) AS score')} FROM {_classes}""")
def e10(spark, d):
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8, 77)], "class_id int")
    return M.scene_iou(near(spark, d), ids).select("kind", "id", rounded("score"))


@query("e11_category_summary", f"SELECT {r('avg(iou) AS category_mean', 'sum(iou * n) / sum(n) AS instance_mean')} FROM (SELECT label, avg((pred = label)::INT) AS iou, count(*) AS n FROM {NEAR} GROUP BY label)")
def e11(spark, d):
    scores = near(spark, d).groupBy("label").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("iou"), F.count("*").alias("n"))
    return M.category_summary(scores).select(rounded("category_mean"), rounded("instance_mean"))


@query("e12_parse_metric_log", f"SELECT user_id AS log, {r('arg_max(value, event_id) AS value')} FROM events WHERE event_type <> 'error' GROUP BY user_id")
def e12(spark, d):
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("train/loss: "), F.col("value").cast("string"))).otherwise(F.concat(F.lit("epoch 7, test/mIoU: "), F.col("value").cast("string"), F.lit(" test/accu: 0.5")))
    lines = table(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))
    return M.parse_metric_log(lines, "test/mIoU").select("log", rounded("value"))


NODES = nodes_sql()
_l0, _l1 = "((key * 13 + cloud_id) % 17)::DOUBLE / 8", "((key * 5 + depth) % 11)::DOUBLE / 6"


@query("e13_split_metrics", f"SELECT depth, {r(f'avg(ln(exp(a) + exp(b)) - CASE WHEN nempty THEN b ELSE a END) AS loss', 'avg(((b > a) = nempty)::INT) AS accuracy')} FROM (SELECT depth, nempty, {_l0} AS a, {_l1} AS b FROM {NODES}) GROUP BY depth")
def e13(spark, d):
    n = nodes(spark, d)
    logits = n.select("cloud_id", "depth", "key", F.array(((F.col("key") * 13 + F.col("cloud_id")) % 17).cast("double") / 8, ((F.col("key") * 5 + F.col("depth")) % 11).cast("double") / 6).alias("logits"))
    return M.split_metrics(logits, n).select("depth", rounded("loss"), rounded("accuracy"))


SIGNAL = f"(SELECT cloud_id, key, {', '.join(INPUT[:4])} FROM {leaf_sql()})"
_error = " + ".join(f"(d{k} * 0.5::DOUBLE - 0.1::DOUBLE - d{k}) * (d{k} * 0.5::DOUBLE - 0.1::DOUBLE - d{k})" for k in range(4))


def signal(spark, d) -> DataFrame:
    return O.input_feature(leaf(spark, d), DEPTH, "ND")


@query("e14_signal_mse", f"SELECT {r(f'avg({_error}) AS mse')} FROM {SIGNAL}")
def e14(spark, d):
    s = signal(spark, d)
    return M.signal_mse(s.withColumn("data", F.transform("data", lambda v: v * 0.5 - 0.1)), s, 4).select(rounded("mse"))


@query("e15_total_loss", f"SELECT {r('sum(v) AS total')} FROM (SELECT event_type, avg(value) AS v FROM events WHERE event_type NOT IN ('click') GROUP BY event_type)")
def e15(spark, d):
    means = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"))
    name = F.when(F.col("event_type") == "click", F.lit("accu_click")).otherwise(F.concat(F.lit("loss_"), F.col("event_type")))
    return M.total_loss(means.select(name.alias("name"), "value")).select(rounded("total"))


_length = "greatest(sqrt(d0 * d0 + d1 * d1 + d2 * d2), 1e-12)"


@query("e16_decode_points", f"SELECT cloud_id, key, {r(*[f'({e} + 0.5::DOUBLE + d3 * (d{k} / {_length})) / 8.0::DOUBLE - 1 AS {c}' for k, (e, c) in enumerate(zip(xyz_sql('key', DEPTH), 'xyz'))], *[f'd{k} / {_length} AS n{c}' for k, c in enumerate('xyz')])} FROM {SIGNAL}")
def e16(spark, d):
    return M.decode_points(signal(spark, d), DEPTH).select("cloud_id", "key", *[rounded(c) for c in ("x", "y", "z", "nx", "ny", "nz")])


@query("e17_cross_entropy", f"SELECT {r(f'avg(ln({TOTAL}) + list_max(logits) - logits[label + 1]) AS loss')} FROM {PRED}")
def e17(spark, d):
    return M.mean_cross_entropy(pred(spark, d)).select(rounded("loss"))
