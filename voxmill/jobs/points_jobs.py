"""Queries of point operators (P, A, K, W)."""

from __future__ import annotations

from math import cos, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions import keys as K
from voxmill.functions.ranks import running_sum
from voxmill.jobs.registry import query, r, rounded
from voxmill.jobs.tables import CLIPPED, CLOUD_E, CLOUD_L, cloud_e, cloud_l, clipped, key_sql, table, xyz_sql
from voxmill.operators import octree as O
from voxmill.operators import points as P
from voxmill.schema import check_finite, validate_points

ALL = ("x", "y", "z", "nx", "ny", "nz")


def shown(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select("cloud_id", "point_id", *[rounded(c, digits=digits) for c in cols or ALL])


def sql(cols: str, source: str) -> str:
    return f"SELECT cloud_id, point_id, {cols} FROM {source}"


@query("p1_validate_points", f"""SELECT sum(n)::BIGINT AS n_points, count(DISTINCT cloud_id) AS n_clouds, sum(nx0)::BIGINT AS no_xyz, sum(hn)::BIGINT AS half_normal, sum(n - 1)::BIGINT AS repeated_ids FROM
 (SELECT cloud_id, point_id, count(*) AS n, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR z IS NULL) AS nx0,
 count(*) FILTER (WHERE (nx IS NULL)::INT + (ny IS NULL)::INT + (nz IS NULL)::INT IN (1, 2)) AS hn FROM {CLOUD_L} GROUP BY ALL)""")
def p1(spark, d):
    return validate_points(cloud_l(spark, d))


for axis in ("x", "z"):
    sign = f"CASE WHEN n{axis} > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    query(f"p2_orient_normal_{axis}", sql(r(*ALL[:3], *[f"{c} * ({sign}) AS {c}" for c in ALL[3:]]), CLOUD_L))(lambda spark, d, axis=axis: shown(P.orient_normal(cloud_l(spark, d), axis)))
query("p2_orient_normal_xyz", sql(r(*ALL[:3], *[f"abs({c}) AS {c}" for c in ALL[3:]]), CLOUD_L))(lambda spark, d: shown(P.orient_normal(cloud_l(spark, d), "xyz")))

F3 = (1.5, 2.0, 0.5)
_len = "greatest(sqrt(" + " + ".join(f"({c} / {f}::DOUBLE) * ({c} / {f}::DOUBLE)" for c, f in zip(ALL[3:], F3)) + "), 1e-12)"


@query("p3_scale", sql(r(*[f"{c} * {f}::DOUBLE AS {c}" for c, f in zip(ALL[:3], F3)], *[f"{c} / {f}::DOUBLE / {_len} AS {c}" for c, f in zip(ALL[3:], F3)]), CLOUD_L))
def p3(spark, d):
    return shown(P.scale(cloud_l(spark, d), F3))


ANGLE = (0.3, -0.7, 1.1)


def matrix(a):
    """The same rotation in closed form."""
    (sx, sy, sz), (cx, cy, cz) = [[f(v) for v in a] for f in (sin, cos)]
    return [[cy * cz, cy * sz, -sy], [sx * sy * cz - cx * sz, sx * sy * sz + cx * cz, sx * cy], [cx * sy * cz + sx * sz, cx * sy * sz - sx * cz, cx * cy]]


def turned(names, m=None):
    m = m or matrix(ANGLE)
    return [" + ".join(f"{n} * ({m[i][j]!r})::DOUBLE" for i, n in enumerate(names)) + f" AS {names[j]}" for j in range(3)]


@query("p4_rotate", sql(r(*turned(ALL[:3]), *turned(ALL[3:])), CLOUD_L))
def p4(spark, d):
    return shown(P.rotate(cloud_l(spark, d), ANGLE))


@query("p5_translate", sql(r("x + 0.25::DOUBLE AS x", "y - 0.5::DOUBLE AS y", "z + 1.0::DOUBLE AS z", *ALL[3:]), CLOUD_L))
def p5(spark, d):
    return shown(P.translate(cloud_l(spark, d), (0.25, -0.5, 1.0)))


@query("p6_flip", sql(r("-x AS x", "y", "-z AS z", "-nx AS nx", "ny", "-nz AS nz"), CLOUD_L))
def p6(spark, d):
    return shown(P.flip(cloud_l(spark, d), "xz"))


@query("p7_inbox_mask", f"SELECT cloud_id, point_id, (x > -0.5 AND x < 0.5 AND y > -0.6 AND y < 0.7 AND z > -0.9 AND z < 0.2) AS inside FROM {CLOUD_L}")
def p7(spark, d):
    return P.inbox_mask(cloud_l(spark, d), (-0.5, -0.6, -0.9), (0.5, 0.7, 0.2)).select("cloud_id", "point_id", "inside")


@query("p8_clip", sql(r(*ALL), CLIPPED))
def p8(spark, d):
    return shown(clipped(spark, d))


@query("p9_select_points", sql(r(*ALL), f"{CLOUD_L} WHERE label = 1 AND nz > 0"))
def p9(spark, d):
    return shown(P.select_points(cloud_l(spark, d), (F.col("label") == 1) & (F.col("nz") > 0)))


BOX = "(SELECT cloud_id, " + ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz") + " FROM {0} GROUP BY cloud_id)"
MID = {c: f"(min_{c} + max_{c}) * 0.5::DOUBLE" for c in "xyz"}
EXT = "greatest(max_x - min_x, max_y - min_y, max_z - min_z)"


def boxed(cols: list[str], cloud: str, digits: int = 6) -> str:
    return f"SELECT cloud_id, point_id, {r(*cols, digits=digits)} FROM {cloud} JOIN {BOX.format(cloud)} USING (cloud_id)"


@query("p10_bbox", f"SELECT cloud_id, {r(*[f'{f}_{c}' for f in ('min', 'max') for c in 'xyz'])} FROM {BOX.format(CLOUD_L)}")
def p10(spark, d):
    return P.bbox(cloud_l(spark, d)).select("cloud_id", *[rounded(f"{f}_{c}") for f in ("min", "max") for c in "xyz"])


@query("p11_centralize_scale", boxed([f"({c} - {MID[c]}) * (1.8::DOUBLE / ({EXT} + 1e-6)) AS {c}" for c in "xyz"], CLOUD_E))
def p11(spark, d):
    return shown(P.centralize_scale(cloud_e(spark, d), 0.9), *"xyz")


@query("p12_normalize_box", sql(r(*[f"({c} + 1) * (32 / 2.0::DOUBLE) AS {c}" for c in "xyz"]), CLOUD_L))
def p12(spark, d):
    return shown(P.normalize_box(cloud_l(spark, d), -1.0, 1.0, 32.0), *"xyz")


@query("p13_preprocess_scene", f"SELECT cloud_id, point_id, {r(*[f'({c} - {MID[c]}) / 10.24::DOUBLE AS {c}' for c in 'xy'], '(z - 0.5::DOUBLE) / 10.24::DOUBLE AS z', 'f0 / 255.0::DOUBLE AS f0')} FROM {CLOUD_L} JOIN {BOX.format(CLOUD_L)} USING (cloud_id)")
def p13(spark, d):
    return shown(P.preprocess_scene(cloud_l(spark, d)).withColumn("f0", F.col("features")[0]), *"xyz", "f0")


@query("p14_preprocess_lidar", boxed([f"({c} - {MID[c]}) / 100.0::DOUBLE AS {c}" for c in "xyz"], CLOUD_L, 9))
def p14(spark, d):
    return shown(P.preprocess_lidar(cloud_l(spark, d)), *"xyz", digits=9)


@query("p15_preprocess_mesh_samples", boxed([f"({c} - {MID[c]}) / ({EXT} / 2 + 1e-6) AS {c}" for c in "xyz"], CLOUD_E))
def p15(spark, d):
    return shown(P.preprocess_mesh_samples(cloud_e(spark, d)), *"xyz")


@query("p15_preprocess_completion", boxed([f"({c} - {MID[c]}) * (2.0::DOUBLE / ({EXT} + 1e-6) * 0.95::DOUBLE) AS {c}" for c in "xyz"], CLOUD_E))
def p15b(spark, d):
    return shown(P.preprocess_completion(cloud_e(spark, d)), *"xyz")


@query("p16_preprocess_fixed_scale", sql(r(*[f"{c} / 0.6::DOUBLE AS {c}" for c in "xyz"]), CLOUD_E))
def p16(spark, d):
    return shown(P.preprocess_fixed_scale(cloud_e(spark, d), 0.6), *"xyz")


def alignments(spark, d):
    """A matrix line for each even cloud of cloud L, made from the cloud's number."""
    c = F.col("cloud_id")
    line = F.concat(F.lit("axisAlignment = 1 0 0 "), c.cast("string"), F.lit(" 0 0 -1 0.5 0 1 0 -0.25 0 0 0 1"))
    return cloud_l(spark, d).select("cloud_id").distinct().where(c % 2 == 0).select("cloud_id", line.alias("line"))


@query("p17_align_axes", sql(r("CASE WHEN cloud_id % 2 = 0 THEN x + cloud_id ELSE x END AS x", "CASE WHEN cloud_id % 2 = 0 THEN -z + 0.5::DOUBLE ELSE y END AS y", "CASE WHEN cloud_id % 2 = 0 THEN y - 0.25::DOUBLE ELSE z END AS z"), CLOUD_L))
def p17(spark, d):
    return shown(P.align_axes(cloud_l(spark, d), P.parse_alignment(alignments(spark, d))), *"xyz")


@query("p18_label_filter", f"SELECT cloud_id, point_id, label FROM {CLOUD_L} WHERE label > 0")
def p18(spark, d):
    return P.label_filter(cloud_l(spark, d), 0).select("cloud_id", "point_id", "label")


MERGED = f"""(SELECT *, dense_rank() OVER (ORDER BY part, cloud_id)::BIGINT - 1 AS batch_id, count(*) OVER (PARTITION BY part, cloud_id) AS n_points FROM
 (SELECT 0 AS part, cloud_id, point_id, x FROM {CLOUD_E} UNION ALL SELECT 1 AS part, cloud_id, point_id, x FROM {CLOUD_L}))"""


def merged(spark, d):
    return P.merge_points([cloud_e(spark, d), cloud_l(spark, d)])


@query("a10_merge_points", f"SELECT cloud_id, point_id, batch_id, n_points, {r('x')} FROM {MERGED}")
def a10(spark, d):
    return merged(spark, d).select("cloud_id", "point_id", F.col("batch_id").cast("long").alias("batch_id"), "n_points", rounded("x"))


@query("a11_split_points", f"SELECT b AS batch_id, count(m.batch_id) AS n_points FROM (SELECT unnest(range((SELECT max(batch_id) + 3 FROM {MERGED}))) AS b) LEFT JOIN {MERGED} m ON m.batch_id = b GROUP BY b")
def a11(spark, d):
    points = merged(spark, d)
    return P.split_counts(points, points.agg(F.max("batch_id")).first()[0] + 3)


CELL = ("floor(l_quantity * 7)", "floor(l_extendedprice / 10)", "l_partkey")


def cells(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_linenumber").cast("long").alias("b"), *[e.alias(n) for e, n in zip((F.floor(F.col("l_quantity") * 7), F.floor(F.col("l_extendedprice") / 10), F.col("l_partkey")), "xyz")])


CELLS = f"(SELECT l_linenumber::BIGINT AS b, {', '.join(f'{e}::BIGINT AS {n}' for e, n in zip(CELL, 'xyz'))} FROM lineitem)"


@query("k1_xyz_to_key", f"SELECT x, y, z, {key_sql('x', 'y', 'z', 16)} AS key FROM {CELLS}")
def k1(spark, d):
    return cells(spark, d).select(*"xyz", K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), 16).alias("key"))


_back = xyz_sql("key", 16)


@query("k2_key_to_xyz", f"SELECT key, {', '.join(f'{e} AS {n}' for e, n in zip(_back, 'xyz'))} FROM (SELECT x * 1000003 + y * 4099 + z AS key FROM {CELLS})")
def k2(spark, d):
    key = cells(spark, d).select((F.col("x") * 1000003 + F.col("y") * 4099 + F.col("z")).alias("key"))
    x, y, z = K.key_to_xyz(F.col("key"))
    return key.select("key", x.alias("x"), y.alias("y"), z.alias("z"))


@query("k3_pack_key", f"SELECT b AS cloud_id, key, (b << 48) | key AS packed FROM (SELECT b, {key_sql('x', 'y', 'z', 16)} AS key FROM {CELLS})")
def k3(spark, d):
    packed = cells(spark, d).select(K.pack_key(F.col("b"), K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), 16)).alias("packed"))
    cloud, key = K.unpack_key(F.col("packed"))
    return packed.select(cloud.alias("cloud_id"), key.alias("key"), "packed")


_daily = "(SELECT l_linenumber AS cloud_id, l_shipdate::DATE AS day, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def daily(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("cloud_id"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("v"))


@query("w1_cumsum", f"SELECT cloud_id, day, {r('sum(v) OVER w AS inclusive')} FROM {_daily} WINDOW w AS (PARTITION BY cloud_id ORDER BY day)")
def w1(spark, d):
    return running_sum(daily(spark, d), "v", F.year("day"), [F.col("day")], ["cloud_id"], name="inclusive").select("cloud_id", "day", rounded("inclusive"))


@query("w1_cumsum_exclusive", f"SELECT cloud_id, day::VARCHAR AS day, {r('sum(v) OVER w - v AS exclusive')} FROM {_daily} WINDOW w AS (PARTITION BY cloud_id ORDER BY day) UNION ALL SELECT cloud_id, 'end', {r('sum(v) AS exclusive')} FROM {_daily} GROUP BY cloud_id")
def w1b(spark, d):
    return running_sum(daily(spark, d), "v", F.year("day"), [F.col("day")], ["cloud_id"], exclusive=True, name="exclusive").select("cloud_id", F.coalesce(F.col("day").cast("string"), F.lit("end")).alias("day"), rounded("exclusive"))


@query("w3_range_grid", "SELECT p_partkey AS row_id, x, y, z FROM part, range(-1, 2) a(x), range(-1, 2) b(y), range(-1, 2) c(z)")
def w3(spark, d):
    return O.range_grid(table(spark, d, "part").select(F.col("p_partkey").alias("row_id")), -1, 1)


@query("w5_check_finite", f"SELECT {', '.join(f'count(*) FILTER (WHERE isnan({c}) OR isinf({c})) AS {c}_bad, {r(f'max(abs({c})) AS {c}_max')}' for c in 'xyz')} FROM (SELECT CASE WHEN point_id % 7 = 0 THEN 'inf'::DOUBLE ELSE x END AS x0, CASE WHEN point_id % 7 = 0 THEN NULL ELSE x END AS x, y, z FROM {CLOUD_L})".replace("count(*) FILTER (WHERE isnan(x) OR isinf(x))", "count(*) FILTER (WHERE isnan(x0) OR isinf(x0))"))
def w5(spark, d):
    some = cloud_l(spark, d).withColumn("x", F.when(F.col("point_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("x")))
    return check_finite(some, list("xyz")).select(*[c for n in "xyz" for c in (F.col(f"{n}_bad"), rounded(f"{n}_max"))])


@query("w7_integer_division", f"SELECT x, x // 7 AS quotient, x % 7 AS remainder, x >> 3 AS parent FROM {CELLS}")
def w7(spark, d):
    return cells(spark, d).selectExpr("x", "x div 7 as quotient", "x % 7 as remainder", "shiftright(x, 3) as parent")
