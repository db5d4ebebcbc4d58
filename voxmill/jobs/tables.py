"""Point clouds, predictions, meshes and listings derived from the driver's tables.

Every frame has a twin in SQL (upper case), so that queries and oracles start alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators import octree
from voxmill.operators import points as P
from voxmill.staging import folder, kept  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order keys that make up seven clouds: more orders give more clouds, not fuller ones.
ORDERS = 50_000
#: Largest order and part, as one number, whose point id is still a long.
FITS = 230_584_300_000


def order_part() -> Column:
    """Order key and part key as one number; where a point id made of it would not be a long, the order key counts from its cloud's first."""
    whole = F.col("l_orderkey") * 200000 + F.col("l_partkey")
    return F.when(F.abs(whole) <= FITS, whole).otherwise(F.col("l_orderkey") % ORDERS * 200000 + F.col("l_partkey"))


def cloud_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds from ``lineitem``, seven for every ORDERS order keys, one for each line number; point ids are unique within a cloud."""
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") + 7 * F.expr(f"l_orderkey div {ORDERS}")).cast("long").alias("cloud_id"),
        ((order_part() * 10000 + F.col("l_suppkey")) * 4000 + day).alias("point_id"),
        (F.col("l_quantity") / 25.5 - 1).alias("x"),
        (F.col("l_extendedprice") / 52500.0 - 1).alias("y"),
        (day / 1260.0 - 1).alias("z"),
        (F.col("l_discount") - 0.05).alias("nx"),
        (F.col("l_tax") - 0.04).alias("ny"),
        ((F.col("l_quantity") - 25.5) / 25.0).alias("nz"),
        F.array("l_quantity", "l_discount").alias("features"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
    )


DAY = "date_diff('day', DATE '1995-01-01', l_shipdate::DATE)"
CLOUD_L = f"""(SELECT (l_linenumber + 7 * (l_orderkey // {ORDERS}))::BIGINT AS cloud_id, ((l_orderkey * 200000 + l_partkey) * 10000 + l_suppkey) * 4000 + {DAY} AS point_id,
 l_quantity / 25.5 - 1 AS x, l_extendedprice / 52500.0::DOUBLE - 1 AS y, {DAY} / 1260.0::DOUBLE - 1 AS z,
 l_discount - 0.05::DOUBLE AS nx, l_tax - 0.04::DOUBLE AS ny, (l_quantity - 25.5::DOUBLE) / 25.0::DOUBLE AS nz, l_quantity AS f0, l_discount AS f1,
 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)"""


def cloud_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clouds from ``embeddings``, one for each label."""
    v = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), *[(v(k) * 2).alias(c) for k, c in enumerate("xyz")],
        *[v(k + 3).alias(c) for k, c in enumerate(("nx", "ny", "nz"))], F.array(*[v(k) for k in range(6, 10)]).alias("features"), "label",
    )


CLOUD_E = """(SELECT label::BIGINT AS cloud_id, vec_id AS point_id, embedding[1]::DOUBLE * 2 AS x, embedding[2]::DOUBLE * 2 AS y, embedding[3]::DOUBLE * 2 AS z,
 embedding[4]::DOUBLE AS nx, embedding[5]::DOUBLE AS ny, embedding[6]::DOUBLE AS nz,
 embedding[7]::DOUBLE AS f0, embedding[8]::DOUBLE AS f1, embedding[9]::DOUBLE AS f2, embedding[10]::DOUBLE AS f3, label FROM embeddings)"""

INSIDE = "x > -0.99 AND x < 0.99 AND y > -0.99 AND y < 0.99 AND z > -0.99 AND z < 0.99"
#: Cloud L inside the unit cube, as octrees are built from it.
CLIPPED = f"(SELECT * FROM {CLOUD_L} WHERE {INSIDE})"

DEPTH, FULL = 4, 2


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clip(cloud_l(spark, sf_dir))


def leaf(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """The averaged leaves of cloud L: cloud_id, key, npt, px..pz, nx..nz, features."""
    return octree.average_signal(octree.voxelize(clipped(spark, sf_dir), depth), channels=2)


def tree(spark: SparkSession, sf_dir: str, depth: int = DEPTH, full: int = FULL) -> tuple[DataFrame, DataFrame]:
    """Features and nodes of one level, from leaves that are built once."""
    leaves = kept(leaf(spark, sf_dir, depth))
    return leaf_features(leaves, depth), octree.build_nodes(leaves, depth, full, False)


def nodes(spark: SparkSession, sf_dir: str, depth: int = DEPTH, full: int = FULL, index: bool = False) -> DataFrame:
    return octree.build_nodes(octree.voxelize(clipped(spark, sf_dir), depth), depth, full, index)


def feat(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """Features of the non-empty leaves: cloud_id, depth, key, data (average features, then the normal's x)."""
    return leaf_features(leaf(spark, sf_dir, depth), depth)


def leaf_features(leaves: DataFrame, depth: int) -> DataFrame:
    return leaves.select("cloud_id", F.lit(depth).alias("depth"), "key", F.array(F.col("features")[0] / 50.0, F.col("features")[1], F.col("nx"), F.col("px") / 16.0).alias("data"))


def key_sql(x: str, y: str, z: str, depth: int) -> str:
    """A Morton key of scaled coordinates, bit by bit."""
    return " + ".join(f"((((trunc({c}))::BIGINT >> {i}) & 1) << {3 * i + s})" for c, s in ((x, 2), (y, 1), (z, 0)) for i in range(depth))


def xyz_sql(key: str, depth: int) -> list[str]:
    return [" + ".join(f"((({key} >> {3 * i + s}) & 1) << {i})" for i in range(depth)) for s in (2, 1, 0)]


def keyed_sql(depth: int = DEPTH, cloud: str = CLIPPED) -> str:
    s = float(1 << depth) / 2
    inner = f"(SELECT *, (x + 1) * {s}::DOUBLE AS px, (y + 1) * {s}::DOUBLE AS py, (z + 1) * {s}::DOUBLE AS pz FROM {cloud})"
    return f"(SELECT *, {key_sql('px', 'py', 'pz', depth)} AS key FROM {inner})"


def leaf_sql(depth: int = DEPTH) -> str:
    length = "greatest(sqrt(sx * sx + sy * sy + sz * sz), 1e-12)"
    return f"""(SELECT cloud_id, key, npt, px, py, pz, sx / {length} AS nx, sy / {length} AS ny, sz / {length} AS nz, f0, f1 FROM
 (SELECT cloud_id, key, count(*) AS npt, avg(px) AS px, avg(py) AS py, avg(pz) AS pz, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, avg(f0) AS f0, avg(f1) AS f1
 FROM {keyed_sql(depth)} GROUP BY cloud_id, key))"""


def nodes_sql(depth: int = DEPTH, full: int = FULL) -> str:
    """cloud_id, depth, key, nempty, child."""
    occ = f"(SELECT DISTINCT cloud_id, key FROM {keyed_sql(depth)})"
    level = lambda d: f"(SELECT DISTINCT cloud_id, key >> {3 * (depth - d)} AS key FROM occ0)"
    clouds = "(SELECT DISTINCT cloud_id FROM occ0)"
    parts = [f"SELECT cloud_id, {d} AS depth, k AS key, true AS nempty FROM {clouds}, range({8**d}) AS t(k)" for d in range(full)]
    parts.append(f"SELECT c.cloud_id, {full} AS depth, k AS key, o.key IS NOT NULL AS nempty FROM {clouds} c CROSS JOIN range({8**full}) AS t(k) LEFT JOIN {level(full)} o ON o.cloud_id = c.cloud_id AND o.key = k")
    for d in range(full + 1, depth + 1):
        parts.append(f"SELECT p.cloud_id, {d} AS depth, p.key * 8 + k AS key, o.key IS NOT NULL AS nempty FROM {level(d - 1)} p CROSS JOIN range(8) AS t(k) LEFT JOIN {level(d)} o ON o.cloud_id = p.cloud_id AND o.key = p.key * 8 + k")
    return f"""(WITH occ0 AS MATERIALIZED {occ}, n0 AS ({" UNION ALL ".join(parts)})
 SELECT *, CASE WHEN nempty THEN (sum(CASE WHEN nempty THEN 1 ELSE 0 END) OVER (PARTITION BY cloud_id, depth ORDER BY key) - 1)::BIGINT ELSE -1 END AS child FROM n0)"""


def feat_sql(depth: int = DEPTH) -> str:
    return f"(SELECT cloud_id, {depth} AS depth, key, f0 / 50.0::DOUBLE AS d0, f1 AS d1, nx AS d2, px / 16.0::DOUBLE AS d3 FROM {leaf_sql(depth)})"
