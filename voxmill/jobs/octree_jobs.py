"""Queries of octree construction, look-ups, features and stencils (O, J, G, C, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions import keys as K
from voxmill.jobs.registry import query, r, rounded
from voxmill.jobs.tables import CLIPPED, CLOUD_L, DEPTH, FULL, clipped, cloud_l, feat, feat_sql, keyed_sql, key_sql, leaf, leaf_sql, nodes, nodes_sql, tree, xyz_sql
from voxmill.operators import blocks as B
from voxmill.operators import features as G
from voxmill.operators import lookup as J
from voxmill.operators import octree as O
from voxmill.operators import stencil as C
from voxmill.operators import stored as T

CH = 4
DATA = [f"d{k}" for k in range(CH)]


def values(df: DataFrame, *keys: str, channels: int = CH) -> DataFrame:
    """The keys and the channels of ``data`` as rounded columns d0, d1, ..."""
    return df.select(*keys, *[rounded(F.col("data")[k], f"d{k}") for k in range(channels)])


def flat(feat_rows: DataFrame) -> DataFrame:
    return values(feat_rows, "cloud_id", "depth", "key")


def voxels(spark, d, depth=DEPTH):
    return O.voxelize(clipped(spark, d), depth)


@query("o1_voxelize", f"SELECT cloud_id, key, count(*) AS npt FROM {keyed_sql(5)} GROUP BY ALL")
def o1(spark, d):
    return O.voxel_counts(voxels(spark, d, 5))


@query("o1_point_to_node", f"SELECT cloud_id, point_id, key FROM {keyed_sql(5)}")
def o1b(spark, d):
    return voxels(spark, d, 5).select("cloud_id", "point_id", "key")


SIGNAL = ("px", "py", "pz", "nx", "ny", "nz")


@query("o2_average_signal", f"SELECT cloud_id, key, npt, {r(*SIGNAL, 'f0', 'f1')} FROM {leaf_sql()}")
def o2(spark, d):
    return leaf(spark, d).select("cloud_id", "key", "npt", *[rounded(c) for c in SIGNAL], *[rounded(F.col("features")[k], f"f{k}") for k in (0, 1)])


def levels(spark, d) -> DataFrame:
    parts = [v.withColumn("depth", F.lit(k)) for k, v in O.level_keys(voxels(spark, d), DEPTH).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("o3_level_keys", f"SELECT DISTINCT cloud_id, key >> (3 * ({DEPTH} - d)) AS key, d::INT AS depth FROM {keyed_sql()}, range({DEPTH + 1}) AS t(d)")
def o3(spark, d):
    return levels(spark, d)


CLOUDS = f"(SELECT DISTINCT cloud_id FROM {CLIPPED})"


def clouds(spark, d):
    return clipped(spark, d).select("cloud_id").distinct()


@query("o4_full_levels", f"SELECT cloud_id, k AS key FROM {CLOUDS}, range(512) AS t(k)")
def o4(spark, d):
    return O.full_level(clouds(spark, d), 3)


NODES = nodes_sql()


@query("o5_build_nodes", f"SELECT cloud_id, depth, key, nempty FROM {NODES}")
def o5(spark, d):
    return nodes(spark, d).select("cloud_id", "depth", "key", "nempty")


@query("o6_child_index", f"SELECT cloud_id, depth, key, child FROM {NODES}")
def o6(spark, d):
    return nodes(spark, d, index=True).select("cloud_id", "depth", "key", "child")


INDEXED = f"(SELECT *, row_number() OVER (PARTITION BY cloud_id, depth ORDER BY key) - 1 AS idx FROM {NODES})"


@query("o7_nempty_index", f"SELECT cloud_id, depth, key, idx FROM {INDEXED} WHERE nempty")
def o7(spark, d):
    return O.nempty_index(nodes(spark, d))


@query("o8_node_counts", f"SELECT depth, cloud_id, count(*) AS nnum, count(*) FILTER (WHERE nempty) AS nnum_nempty FROM {NODES} GROUP BY ROLLUP (depth, cloud_id)")
def o8(spark, d):
    return O.node_counts(nodes(spark, d))


@query("o9_merge_octrees", f"""SELECT dense_rank() OVER (ORDER BY cloud_id)::INT - 1 AS batch_id, depth, key, nempty,
 CASE WHEN nempty THEN (sum(nempty::INT) OVER (PARTITION BY depth ORDER BY cloud_id, key))::BIGINT - 1 ELSE -1 END AS child FROM {NODES}""")
def o9(spark, d):
    return O.merge_octrees(nodes(spark, d, index=True))


@query("o10_init_octree", f"SELECT cloud_id, d::INT AS depth, k AS key, true AS nempty, k AS child FROM {CLOUDS}, range(4) AS t(d), range(512) AS u(k) WHERE k < 1 << (3 * d)")
def o10(spark, d):
    return O.init_octree(clouds(spark, d), 3)


SPLIT = f"(SELECT cloud_id, depth, key, (key * 7 + cloud_id) % 3 = 0 AS nempty FROM {NODES} WHERE depth = 3)"
SPLIT_CHILD = f"(SELECT *, CASE WHEN nempty THEN (sum(nempty::INT) OVER (PARTITION BY cloud_id ORDER BY key))::BIGINT - 1 ELSE -1 END AS child FROM {SPLIT})"


def split(spark, d):
    n = nodes(spark, d)
    flags = n.where("depth = 3").select("cloud_id", "key", ((F.col("key") * 7 + F.col("cloud_id")) % 3 == 0).cast("int").alias("split"))
    return O.split(n, flags, 3)


@query("o11_split", f"SELECT cloud_id, depth, key, nempty, child FROM {SPLIT_CHILD}")
def o11(spark, d):
    return split(spark, d)


@query("o11_split_nothing", f"SELECT cloud_id, depth, key, row_number() OVER (ORDER BY cloud_id, key) = 1 AS nempty, CASE WHEN row_number() OVER (ORDER BY cloud_id, key) = 1 THEN 0 ELSE -1 END AS child FROM {NODES} WHERE depth = 3")
def o11b(spark, d):
    n = nodes(spark, d)
    return O.split(n, n.where("depth = 3").select("cloud_id", "key", F.lit(0).alias("split")), 3)


@query("o12_grow", f"SELECT cloud_id, 4 AS depth, key * 8 + k AS key, true AS nempty, child * 8 + k AS child FROM {SPLIT_CHILD}, range(8) AS t(k) WHERE nempty")
def o12(spark, d):
    return O.grow(split(spark, d))


_x, _y, _z = xyz_sql("key", DEPTH)


@query("o13_xyzb", f"SELECT cloud_id, depth, key, {_x} AS x, {_y} AS y, {_z} AS z FROM {NODES}")
def o13(spark, d):
    return O.node_xyz(nodes(spark, d)).select("cloud_id", "depth", "key", *"xyz")


@query("o14_to_points", f"SELECT cloud_id, key, {r(*[f'p{c} * 0.125::DOUBLE - 1 AS {c}' for c in 'xyz'])} FROM {leaf_sql()}")
def o14(spark, d):
    return O.to_points(leaf(spark, d), DEPTH).select("cloud_id", "key", *[rounded(c) for c in "xyz"])


LOCAL = [f"(p{c} - floor(p{c}) - 0.5::DOUBLE)" for c in "xyz"]
_disp = " + ".join(f"{v} * n{c}" for v, c in zip(LOCAL, "xyz"))
INPUT = ["nx AS d0", "ny AS d1", "nz AS d2", f"{_disp} AS d3", *[f"{v} AS d{k + 4}" for k, v in enumerate(LOCAL)], *[f"p{c} * 0.125::DOUBLE - 1 AS d{k + 7}" for k, c in enumerate("xyz")], "f0 AS d10", "f1 AS d11"]


@query("o15_input_feature", f"SELECT cloud_id, {DEPTH} AS depth, key, {r(*INPUT)} FROM {leaf_sql()}")
def o15(spark, d):
    return values(O.input_feature(leaf(spark, d), DEPTH, "NDLPF"), "cloud_id", "depth", "key", channels=12)


@query("w2_sorted_keys", f"SELECT cloud_id, key, row_number() OVER (PARTITION BY cloud_id ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT cloud_id, key FROM {keyed_sql(5)})")
def w2(spark, d):
    level = voxels(spark, d, 5).select("cloud_id", "key").distinct()
    return O.positions(level.withColumn("depth", F.lit(5)).withColumn("nempty", F.lit(True))).select("cloud_id", "key", "idx")


@query("g15_distinct_keys", f"SELECT npt, count(*) AS n_keys FROM (SELECT cloud_id, key, count(*) AS npt FROM {keyed_sql()} GROUP BY ALL) GROUP BY npt")
def g15(spark, d):
    return O.voxel_counts(voxels(spark, d)).groupBy("npt").agg(F.count("*").alias("n_keys"))


# ---------------------------------------------------------------- look-ups

SHIFT = (0.03, -0.05, 0.02)
SIZE = 1 << DEPTH


def queries(spark, d):
    """Cloud L moved a little, scaled to [0, 16)."""
    s = cloud_l(spark, d)
    return s.select("cloud_id", "point_id", *[((F.col(c) + v + 1) * (SIZE / 2)).alias(c) for c, v in zip("xyz", SHIFT)])


Q = f"(SELECT cloud_id, point_id, {', '.join(f'({c} + {v}::DOUBLE + 1) * {SIZE / 2}::DOUBLE AS {c}' for c, v in zip('xyz', SHIFT))} FROM {CLOUD_L})"
QK = f"(SELECT *, {key_sql('x', 'y', 'z', DEPTH)} AS key FROM {Q})"
LEVEL = f"(SELECT cloud_id, key, nempty, child, idx FROM {INDEXED} WHERE depth = {DEPTH})"


@query("j1_search_key", f"SELECT q.cloud_id, q.point_id, q.key, coalesce(n.child, -1) AS idx FROM {QK} q LEFT JOIN (SELECT * FROM {LEVEL} WHERE nempty) n USING (cloud_id, key)")
def j1(spark, d):
    asked = queries(spark, d).withColumn("key", K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), DEPTH)).select("cloud_id", "point_id", "key")
    return J.search_key(asked, nodes(spark, d, index=True), DEPTH, nempty=True)


@query("j2_search_xyzb", f"SELECT q.cloud_id, q.point_id, coalesce(n.idx, -1) AS idx FROM {QK} q LEFT JOIN {LEVEL} n USING (cloud_id, key)")
def j2(spark, d):
    return J.search_xyz(queries(spark, d), nodes(spark, d), DEPTH).select("cloud_id", "point_id", "idx")


FEAT = feat_sql()
OTHER = f"(SELECT DISTINCT cloud_id, key FROM {QK} WHERE x >= 0 AND x < 16 AND y >= 0 AND y < 16 AND z >= 0 AND z < 16)"
ZERO = [f"coalesce({c}, 0) AS {c}" for c in DATA]


@query("j3_align", f"SELECT cloud_id, key, {r(*ZERO)} FROM {OTHER} LEFT JOIN {FEAT} USING (cloud_id, key)")
def j3(spark, d):
    q = queries(spark, d).where(J.in_bounds(DEPTH, F.col("x"), F.col("y"), F.col("z")))
    other = q.select("cloud_id", K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), DEPTH).alias("key")).distinct()
    return values(J.align(feat(spark, d), other, CH), "cloud_id", "key")


def neigh_sql(kernel: str = "333", stride: int = 1, nempty: bool = False, depth: int = DEPTH) -> str:
    """cloud_id, key, k, nkey."""
    offsets = ", ".join(f"({k}, {o // 9 - 1}, {o // 3 % 3 - 1}, {o % 3 - 1})" for k, o in enumerate(O.kernel_offsets(kernel)))
    x, y, z = xyz_sql("key", depth)
    level = f"(SELECT * FROM {NODES} WHERE depth = {depth})"
    rows = f"{level} WHERE key % 8 = 0" if stride == 2 else f"{level} WHERE nempty" if nempty else level
    ends = f"(SELECT cloud_id, key AS nkey FROM {level}{' WHERE nempty' if nempty else ''})"
    at = f"(SELECT cloud_id, key, k, {x} + dx AS nx, {y} + dy AS ny, {z} + dz AS nz FROM (SELECT * FROM {rows}), (VALUES {offsets}) AS o(k, dx, dy, dz))"
    inside = f"nx >= 0 AND ny >= 0 AND nz >= 0 AND nx < {1 << depth} AND ny < {1 << depth} AND nz < {1 << depth}"
    key = "key >> 3 AS key" if stride == 2 else "key"
    return f"(SELECT cloud_id, {key}, k, nkey FROM (SELECT cloud_id, key, k, {key_sql('nx', 'ny', 'nz', depth)} AS nkey FROM {at} WHERE {inside}) JOIN {ends} USING (cloud_id, nkey))"


@query("j4_neighbors", f"SELECT cloud_id, k, count(*) AS n, sum(key)::BIGINT AS keys, sum(nkey * (key + 1))::DOUBLE AS mixed FROM {neigh_sql()} GROUP BY cloud_id, k")
def j4(spark, d):
    found = O.neighbors(nodes(spark, d), DEPTH)
    return found.groupBy("cloud_id", "k").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum(F.col("nkey") * (F.col("key") + 1)).cast("double").alias("mixed"))


for _kernel, _stride, _nempty in (("222", 2, True), ("311", 1, True), ("133", 1, False), ("333", 2, False)):
    query(f"j5_get_neigh_{_kernel}_{_stride}{'_nempty' if _nempty else ''}", f"SELECT cloud_id, key, k, nkey FROM {neigh_sql(_kernel, _stride, _nempty)}")(
        lambda spark, d, a=(_kernel, _stride, _nempty): O.neighbors(nodes(spark, d), DEPTH, *a).select("cloud_id", "key", "k", "nkey")
    )

BOUNDS = " AND ".join(f"{c} >= 0 AND {c} < 16" for c in "xyz")


@query("j6_nearest", f"SELECT q.cloud_id, point_id, {r(*ZERO)} FROM (SELECT *, CASE WHEN {BOUNDS} THEN key END AS k FROM {QK}) q LEFT JOIN {FEAT} f ON f.cloud_id = q.cloud_id AND f.key = q.k")
def j6(spark, d):
    return values(J.nearest(feat(spark, d), queries(spark, d), DEPTH, CH), "cloud_id", "point_id")


def linear_sql(source: str, bound: bool = True) -> str:
    """cloud_id, point_id, d0 ... of trilinear look-ups in the features."""
    corner = f"(SELECT cloud_id, point_id, {', '.join(f'(floor({c} - 0.5::DOUBLE) + o{c})::BIGINT AS i{c}' for c in 'xyz')}, {' * '.join(f'abs(1 - o{c} - ({c} - 0.5::DOUBLE - floor({c} - 0.5::DOUBLE)))' for c in 'xyz')} AS w FROM {source}, range(2) a(ox), range(2) b(oy), range(2) c(oz))"
    test = " AND ".join(f"i{c} >= 0 AND i{c} < 16" for c in "xyz") if bound else "true"
    met = f"(SELECT c.cloud_id, point_id, w, d0, d1, d2, d3 FROM (SELECT *, {key_sql('ix', 'iy', 'iz', DEPTH)} AS key FROM {corner} WHERE {test}) c JOIN {FEAT} USING (cloud_id, key))"
    sums = f"(SELECT cloud_id, point_id, {', '.join(f'sum(w * {c}) / (sum(w) + 1e-12) AS {c}' for c in DATA)} FROM {met} GROUP BY cloud_id, point_id)"
    return f"(SELECT cloud_id, point_id, {', '.join(ZERO)} FROM {source} LEFT JOIN {sums} USING (cloud_id, point_id))"


@query("j7_linear", f"SELECT cloud_id, point_id, {r(*DATA)} FROM {linear_sql(Q)}")
def j7(spark, d):
    return values(J.linear(feat(spark, d), queries(spark, d), DEPTH, CH), "cloud_id", "point_id")


@query("j7_linear_wrapping", f"SELECT cloud_id, point_id, {r(*DATA)} FROM {linear_sql(Q, False)}")
def j7b(spark, d):
    return values(J.linear(feat(spark, d), queries(spark, d), DEPTH, CH, bound_check=False), "cloud_id", "point_id")


RAW = f"(SELECT cloud_id, point_id, (x + 1) * 8.0::DOUBLE AS x, (y + 1) * 8.0::DOUBLE AS y, (z + 1) * 8.0::DOUBLE AS z FROM {CLIPPED})"


@query("j8_interp", f"SELECT cloud_id, point_id, {r(*DATA)} FROM {linear_sql(RAW)}")
def j8(spark, d):
    return values(J.interpolate(feat(spark, d), clipped(spark, d), DEPTH, CH), "cloud_id", "point_id")


def shifted(spark, d):
    """Features of cloud L's leaves found by the queries: another table of the same level."""
    return feat(spark, d).where(F.col("key") % 5 != 0).withColumn("data", F.transform("data", lambda v: v * 2.0 + 1.0))


SHIFTED = f"(SELECT cloud_id, depth, key, {', '.join(f'{c} * 2 + 1 AS e{k}' for k, c in enumerate(DATA))} FROM {FEAT} WHERE key % 5 <> 0)"


@query("j13_combine_concat", f"SELECT cloud_id, depth, key, {r(*DATA, *[f'e{k} AS d{k + 4}' for k in range(4)])} FROM {FEAT} JOIN {SHIFTED} USING (cloud_id, depth, key)")
def j13(spark, d):
    return values(J.combine(feat(spark, d), shifted(spark, d)), "cloud_id", "depth", "key", channels=8)


@query("j13_combine_add", f"SELECT cloud_id, depth, key, {r(*[f'd{k} + e{k} AS d{k}' for k in range(4)])} FROM {FEAT} JOIN {SHIFTED} USING (cloud_id, depth, key)")
def j13b(spark, d):
    return flat(J.combine(feat(spark, d), shifted(spark, d), "add"))


# ---------------------------------------------------------------- features

PADDED = f"(SELECT n.cloud_id, n.depth, n.key, nempty, {', '.join(f'coalesce({c}, 0) AS {c}' for c in DATA)} FROM {NODES} n LEFT JOIN {FEAT} USING (cloud_id, depth, key) WHERE n.depth = {DEPTH})"


def padded(spark, d):
    return G.pad(feat(spark, d), nodes(spark, d), DEPTH, CH)


@query("g1_pad", f"SELECT cloud_id, depth, key, {r(*DATA)} FROM {PADDED}")
def g1(spark, d):
    return flat(padded(spark, d))


@query("g2_depad", f"SELECT cloud_id, depth, key, {r(*DATA)} FROM {PADDED} WHERE nempty")
def g2(spark, d):
    return flat(G.depad(padded(spark, d), nodes(spark, d)))


# rounded first, so that ties are ties in either engine
POOLED = f"(SELECT cloud_id, key >> 3 AS key, {', '.join(f'max({c}) AS {c}, arg_max((key % 8)::INT, struct_pack(v := {c}, s := -(key % 8))) AS i{k}' for k, c in enumerate(DATA))} FROM (SELECT cloud_id, key, {r(*DATA)} FROM {FEAT}) GROUP BY cloud_id, key >> 3)"


def even(spark, d) -> DataFrame:
    return feat(spark, d).withColumn("data", F.transform("data", lambda v: F.round(v, 6) + F.lit(0.0)))


IDX = [f"i{k}" for k in range(CH)]


@query("g3_max_pool", f"SELECT cloud_id, 3 AS depth, key, {r(*DATA)}, {', '.join(IDX)} FROM {POOLED}")
def g3(spark, d):
    out = G.max_pool(even(spark, d), DEPTH, CH)
    return out.select("cloud_id", "depth", "key", *[rounded(F.col("data")[k], f"d{k}") for k in range(CH)], *[F.col("idx")[k].alias(f"i{k}") for k in range(CH)])


@query("g3_max_pool_padded", f"SELECT n.cloud_id, n.depth, n.key, {r(*ZERO)} FROM (SELECT * FROM {NODES} WHERE depth = 3) n LEFT JOIN (SELECT cloud_id, key >> 3 AS key, {', '.join(f'max({c}) AS {c}' for c in DATA)} FROM {PADDED} GROUP BY cloud_id, key >> 3) p USING (cloud_id, key)")
def g3b(spark, d):
    return flat(G.max_pool(padded(spark, d), DEPTH, CH, nodes(spark, d)))


@query("g4_max_unpool", f"SELECT p.cloud_id, 4 AS depth, p.key * 8 + s AS key, {r(*[f'CASE WHEN i{k} = s THEN d{k} ELSE 0 END AS d{k}' for k in range(CH)])} FROM {POOLED} p CROSS JOIN range(8) AS t(s) JOIN (SELECT cloud_id, key AS nk FROM {NODES} WHERE depth = 4 AND nempty) n ON n.cloud_id = p.cloud_id AND n.nk = p.key * 8 + s")
def g4(spark, d):
    return flat(G.max_unpool(G.max_pool(even(spark, d), DEPTH, CH), 3, CH, nodes(spark, d)))


for _kernel, _stride, _nempty in (("222", 2, True), ("333", 1, True), ("333", 2, True)):
    query(f"g5_avg_pool_{_kernel}_{_stride}", f"SELECT cloud_id, {DEPTH - (_stride == 2)} AS depth, key, {r(*[f'sum({c}) / (count(*) + 1e-8) AS {c}' for c in DATA])} FROM (SELECT n.cloud_id, n.key, {', '.join(DATA)} FROM {neigh_sql(_kernel, _stride, _nempty)} n JOIN {FEAT} f ON f.cloud_id = n.cloud_id AND f.key = n.nkey) GROUP BY cloud_id, key")(
        lambda spark, d, a=(_kernel, _stride, _nempty): flat(G.avg_pool(*tree(spark, d), DEPTH, CH, *a))
    )


@query("g6_global_pool", f"SELECT c AS cloud_id, {r(*[f'coalesce(avg({x}), 0) AS {x}' for x in DATA])} FROM (SELECT cloud_id AS c FROM {CLOUDS} UNION ALL SELECT 0) LEFT JOIN {FEAT} f ON f.cloud_id = c GROUP BY c")
def g6(spark, d):
    return values(G.global_pool(feat(spark, d), clouds(spark, d).union(spark.range(1)), CH), "cloud_id")


GAMMA, BETA = [1.0, 0.5, 2.0, -1.0], [0.0, 0.1, -0.2, 0.3]


@query("g7_batch_norm", f"SELECT cloud_id, depth, key, {r(*[f'({c} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER () + 1e-5) * {g}::DOUBLE + {b}::DOUBLE AS {c}' for c, g, b in zip(DATA, GAMMA, BETA)])} FROM {FEAT}")
def g7(spark, d):
    return flat(G.batch_norm(feat(spark, d), CH, GAMMA, BETA))


def norm_sql(size: int) -> str:
    groups = [DATA[k : k + size] for k in range(0, CH, size)]
    n = f"(count(*) OVER w * {size} + 1e-5)"
    means = ", ".join(f"sum({' + '.join(g)}) OVER w / {n} AS m{k}" for k, g in enumerate(groups))
    centred = f"(SELECT cloud_id, depth, key, {', '.join(f'{c} - m{k // size} AS {c}' for k, c in enumerate(DATA))} FROM (SELECT *, {means} FROM {FEAT} WINDOW w AS (PARTITION BY cloud_id)))"
    scales = ", ".join(f"1 / sqrt(sum({' + '.join(f'{c} * {c}' for c in g)}) OVER w / {n} + 1e-5) AS r{k}" for k, g in enumerate(groups))
    return f"SELECT cloud_id, depth, key, {r(*[f'{c} * r{k // size} * {GAMMA[k]}::DOUBLE + {BETA[k]}::DOUBLE AS {c}' for k, c in enumerate(DATA)])} FROM (SELECT *, {scales} FROM {centred} WINDOW w AS (PARTITION BY cloud_id))"


@query("g8_group_norm", norm_sql(2))
def g8(spark, d):
    return flat(G.group_norm(feat(spark, d), CH, 2, GAMMA, BETA, least=2))


@query("g9_instance_norm", norm_sql(1))
def g9(spark, d):
    return flat(G.instance_norm(feat(spark, d), CH, GAMMA, BETA))


def uniform_sql(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


for _per, _parts in (("cloud", ["cloud_id"]), ("row", ["cloud_id", "key"])):
    query(f"g10_drop_path_{_per}", f"SELECT cloud_id, depth, key, {r(*[f'{c} * CASE WHEN {uniform_sql(5, *_parts)} < 0.7 THEN 1 / 0.7::DOUBLE ELSE 0 END AS {c}' for c in DATA])} FROM {FEAT}")(
        lambda spark, d, per=_per: flat(G.drop_path(feat(spark, d), 0.3, 5, per))
    )

COARSE = feat_sql(3)


@query("g11_nearest_upsample", f"SELECT cloud_id, depth, key, {r(*DATA)} FROM (SELECT cloud_id, key AS pk, {', '.join(DATA)} FROM {COARSE}) JOIN (SELECT cloud_id AS c, depth, key FROM {NODES} WHERE depth = 4 AND nempty) ON c = cloud_id AND key >> 3 = pk")
def g11(spark, d):
    return flat(G.nearest_upsample(feat(spark, d, 3), 3, nodes(spark, d)))


_centres = f"(SELECT cloud_id, key AS point_id, {', '.join(f'({e} + 0.5::DOUBLE) * 0.5::DOUBLE AS {c}' for e, c in zip(xyz_sql('key', DEPTH), 'xyz'))} FROM {NODES} WHERE depth = 4 AND nempty)"


@query("g12_upsample_linear", f"SELECT cloud_id, 4 AS depth, point_id AS key, {r(*DATA)} FROM {linear_sql(_centres).replace(FEAT, COARSE).replace('< 16', '< 8')}")
def g12(spark, d):
    return flat(G.upsample(feat(spark, d, 3), nodes(spark, d), 3, 4, CH))


@query("g13_to_voxels", f"SELECT s.cloud_id, {', '.join(f'{e} AS {c}' for e, c in zip(xyz_sql('s.key', DEPTH), 'xyz'))}, {r(*ZERO)} FROM (SELECT cloud_id, k AS key FROM {CLOUDS}, range({8**DEPTH}) AS t(k)) s LEFT JOIN {FEAT} USING (cloud_id, key)")
def g13(spark, d):
    return values(G.to_voxels(feat(spark, d), clouds(spark, d), DEPTH, CH), "cloud_id", *"xyz")


@query("g14_scatter_add", f"SELECT i AS index, {r(*[f'coalesce(sum({c}), 0) AS {c}' for c in DATA])} FROM range(600) AS t(i) LEFT JOIN (SELECT key % 577 AS j, * FROM {FEAT}) ON i = j GROUP BY i")
def g14(spark, d):
    return values(G.scatter_add(feat(spark, d).withColumn("index", F.col("key") % 577), 600, CH), "index")


# ---------------------------------------------------------------- stencils

def met_sql(kernel: str, stride: int, nempty: bool = True, depth: int = DEPTH, source: str = FEAT) -> str:
    return f"(SELECT n.cloud_id, n.key, k, {', '.join(DATA)} FROM {neigh_sql(kernel, stride, nempty, depth)} n JOIN {source} f ON f.cloud_id = n.cloud_id AND f.key = n.nkey)"


@query("c1_octree2col", f"SELECT cloud_id, key, k, {r(*DATA)} FROM {met_sql('222', 1)}")
def c1(spark, d):
    return values(C.columns(*tree(spark, d), DEPTH, "222", 1), "cloud_id", "key", "k")


@query("c2_col2octree", f"SELECT cloud_id, 4 AS depth, nkey AS key, {r(*[f'sum({c}) AS {c}' for c in DATA])} FROM {neigh_sql('222', 1, True)} JOIN {met_sql('222', 1)} USING (cloud_id, key, k) GROUP BY cloud_id, nkey")
def c2(spark, d):
    f, n = tree(spark, d)
    return flat(C.scatter_columns(C.columns(f, n, DEPTH, "222", 1), n, DEPTH, CH, "222", 1))


def weights_sql(w) -> str:
    return "(VALUES " + ", ".join(f"({k}, " + ", ".join(f"{v!r}::DOUBLE" for v in m.ravel().tolist()) + ")" for k, m in enumerate(w)) + f") AS w(k, {', '.join(f'w{i}' for i in range(w[0].size))})"


def conv_sql(kernel: str, stride: int, w, bias=None) -> str:
    """cloud_id, key, d0 ... of the non-empty convolution."""
    cout = w.shape[2]
    sums = ", ".join("sum(" + " + ".join(f"d{i} * w{i * cout + o}" for i in range(w.shape[1])) + f") + {float(bias[o]) if bias else 0.0}::DOUBLE AS d{o}" for o in range(cout))
    return f"(SELECT cloud_id, key, {sums} FROM {met_sql(kernel, stride)} JOIN {weights_sql(w)} USING (k) GROUP BY cloud_id, key)"


W3, BIAS = C.example_weights(27, CH, 3), [0.1, -0.2, 0.3]
D3 = DATA[:3]


@query("c3_conv", f"SELECT cloud_id, 4 AS depth, key, {r(*D3)} FROM {conv_sql('333', 1, W3, BIAS)}")
def c3(spark, d):
    return values(C.conv(*tree(spark, d), DEPTH, W3, BIAS), "cloud_id", "depth", "key", channels=3)


@query("c3_conv_stride2", f"SELECT cloud_id, 3 AS depth, key, {r(*D3)} FROM {conv_sql('222', 2, C.example_weights(8, CH, 3), BIAS)}")
def c3b(spark, d):
    return values(C.conv(*tree(spark, d), DEPTH, C.example_weights(8, CH, 3), BIAS, "222", 2), "cloud_id", "depth", "key", channels=3)


@query("c3_conv_blocks", f"SELECT cloud_id, 4 AS depth, key, {r(*D3)} FROM {conv_sql('333', 1, W3)}")
def c3c(spark, d):
    return values(B.conv_blocks(feat(spark, d), DEPTH, W3), "cloud_id", "depth", "key", channels=3)


_WD = C.example_weights(27, 3, CH)


def deconv_sql(kernel: str, stride: int, w, depth: int, source: str) -> str:
    cin, cout = w.shape[2], w.shape[1]
    sums = ", ".join("sum(" + " + ".join(f"d{i} * w{o * cin + i}" for i in range(cin)) + f") AS d{o}" for o in range(cout))
    met = f"(SELECT n.cloud_id, n.nkey AS key, k, {', '.join(DATA)} FROM {neigh_sql(kernel, stride, True, depth)} n JOIN {source} f ON f.cloud_id = n.cloud_id AND f.key = n.key)"
    return f"SELECT cloud_id, {depth} AS depth, key, {r(*[f'd{o}' for o in range(cout)])} FROM (SELECT cloud_id, key, {sums} FROM {met} JOIN {weights_sql(w)} USING (k) GROUP BY cloud_id, key)"


@query("c4_deconv", deconv_sql("333", 1, _WD, DEPTH, FEAT))
def c4(spark, d):
    return values(C.deconv(*tree(spark, d), DEPTH, _WD), "cloud_id", "depth", "key", channels=3)


@query("c4_deconv_stride2", deconv_sql("222", 2, C.example_weights(8, 3, CH), DEPTH, COARSE))
def c4b(spark, d):
    return values(C.deconv(feat(spark, d, 3), nodes(spark, d), 3, C.example_weights(8, 3, CH), "222", 2), "cloud_id", "depth", "key", channels=3)


_WC = C.example_weights(27, CH)


@query("c5_depthwise_conv", f"SELECT cloud_id, 4 AS depth, key, {r(*DATA)} FROM (SELECT cloud_id, key, {', '.join(f'sum({c} * w{k}) AS {c}' for k, c in enumerate(DATA))} FROM {met_sql('333', 1)} JOIN {weights_sql(_WC)} USING (k) GROUP BY cloud_id, key)")
def c5(spark, d):
    return flat(C.depthwise_conv(*tree(spark, d), DEPTH, _WC))


_WG = [C.example_weights(27, 2, 2), C.example_weights(27, 2, 2) * 2]


@query("c6_group_conv", f"SELECT cloud_id, 4 AS depth, key, {r(*DATA)} FROM (SELECT cloud_id, key, {', '.join(f'sum(d{2 * (o // 2)} * w{o % 2} + d{2 * (o // 2) + 1} * w{2 + o % 2}) * {1 + o // 2} AS d{o}' for o in range(4))} FROM {met_sql('333', 1)} JOIN {weights_sql(_WG[0])} USING (k) GROUP BY cloud_id, key)")
def c6(spark, d):
    return flat(C.group_conv(*tree(spark, d), DEPTH, _WG))


_WL = C.example_weights(CH, 3)


@query("c7_linear", f"SELECT cloud_id, depth, key, {r(*[' + '.join(f'd{i} * {_WL[i, o].item()!r}::DOUBLE' for i in range(CH)) + f' + {BIAS[o]}::DOUBLE AS d{o}' for o in range(3)])} FROM {FEAT}")
def c7(spark, d):
    return values(C.linear(feat(spark, d), _WL, BIAS), "cloud_id", "depth", "key", channels=3)


# ---------------------------------------------------------------- stencils by blocks

@query("c3_conv_blocks_stride2", f"SELECT cloud_id, 3 AS depth, key, {r(*D3)} FROM {conv_sql('333', 2, W3, BIAS)}")
def c3d(spark, d):
    f, n = tree(spark, d)
    return values(B.conv_blocks(f, DEPTH, W3, nodes=n, bias=BIAS, stride=2, height=2), "cloud_id", "depth", "key", channels=3)


_zeros = [f"coalesce(d{o}, 0) + {BIAS[o]}::DOUBLE AS d{o}" for o in range(3)]


@query("c3_conv_blocks_all_nodes", f"SELECT cloud_id, 4 AS depth, key, {r(*_zeros)} FROM (SELECT cloud_id, key FROM {NODES} WHERE depth = 4) n LEFT JOIN (SELECT cloud_id, key, {', '.join('sum(' + ' + '.join(f'd{i} * w{i * 3 + o}' for i in range(CH)) + f') AS d{o}' for o in range(3))} FROM {met_sql('333', 1, False)} JOIN {weights_sql(W3)} USING (k) GROUP BY cloud_id, key) USING (cloud_id, key)")
def c3e(spark, d):
    f, n = tree(spark, d)
    return values(B.conv_blocks(f, DEPTH, W3, nodes=n, bias=BIAS, nempty=False), "cloud_id", "depth", "key", channels=3)


#: A level so deep that nearly every point has a node of its own, and most blocks one row or only rim.
DEEP = 9
_deep = feat_sql(DEEP)
_spots = f"(SELECT *, {', '.join(f'{e} AS {c}' for e, c in zip(xyz_sql('key', DEEP), 'xyz'))} FROM {_deep})"
_around = ", ".join(f"({k}, {o // 9 - 1}, {o // 3 % 3 - 1}, {o % 3 - 1})" for k, o in enumerate(O.kernel_offsets("333")))
_deep_met = f"(SELECT a.cloud_id, a.key, a.k, b.d0, b.d1, b.d2, b.d3 FROM (SELECT cloud_id, key, k, x + dx AS x, y + dy AS y, z + dz AS z FROM {_spots}, (VALUES {_around}) AS o(k, dx, dy, dz)) a JOIN {_spots} b ON b.cloud_id = a.cloud_id AND b.x = a.x AND b.y = a.y AND b.z = a.z)"


@query("c3_conv_blocks_deep", f"SELECT cloud_id, {DEEP} AS depth, key, {r(*['sum(' + ' + '.join(f'd{i} * w{i * 3 + o}' for i in range(CH)) + f') AS d{o}' for o in range(3)])} FROM {_deep_met} JOIN {weights_sql(W3)} USING (k) GROUP BY cloud_id, key")
def c3f(spark, d):
    return values(B.conv_blocks(feat(spark, d, DEEP), DEEP, W3), "cloud_id", "depth", "key", channels=3)


@query("c4_deconv_blocks", deconv_sql("333", 1, _WD, DEPTH, FEAT))
def c4c(spark, d):
    f, n = tree(spark, d)
    return values(B.deconv_blocks(f, n, DEPTH, _WD, height=2), "cloud_id", "depth", "key", channels=3)


@query("c4_deconv_blocks_stride2", deconv_sql("333", 2, _WD, DEPTH, COARSE))
def c4d(spark, d):
    return values(B.deconv_blocks(feat(spark, d, 3), nodes(spark, d), 3, _WD, stride=2), "cloud_id", "depth", "key", channels=3)


@query("c5_depthwise_blocks", f"SELECT cloud_id, 4 AS depth, key, {r(*DATA)} FROM (SELECT cloud_id, key, {', '.join(f'sum({c} * w{k}) AS {c}' for k, c in enumerate(DATA))} FROM {met_sql('333', 1)} JOIN {weights_sql(_WC)} USING (k) GROUP BY cloud_id, key)")
def c5b(spark, d):
    f, n = tree(spark, d)
    return flat(B.depthwise_blocks(f, n, DEPTH, _WC))


@query("c6_group_blocks", f"SELECT cloud_id, 4 AS depth, key, {r(*DATA)} FROM (SELECT cloud_id, key, {', '.join(f'sum(d{2 * (o // 2)} * w{o % 2} + d{2 * (o // 2) + 1} * w{2 + o % 2}) * {1 + o // 2} AS d{o}' for o in range(4))} FROM {met_sql('333', 1)} JOIN {weights_sql(_WG[0])} USING (k) GROUP BY cloud_id, key)")
def c6b(spark, d):
    f, n = tree(spark, d)
    return flat(B.group_blocks(f, n, DEPTH, _WG))


# ---------------------------------------------------------------- stored trees

def stored(spark, d, *depths: int, cells: tuple[int, ...] = ()) -> T.StoredTree:
    """Levels of cloud L in buckets of (cloud, ancestor at depth 2)."""
    return T.store_tree(nodes(spark, d, index=True), {k: feat(spark, d, k) for k in depths}, CH, prefix=2, buckets=16, cells=cells)


@query("j1_stored_search_key", f"SELECT q.cloud_id, q.point_id, q.key, coalesce(n.child, -1) AS idx FROM {QK} q LEFT JOIN (SELECT * FROM {LEVEL} WHERE nempty) n USING (cloud_id, key)")
def j1s(spark, d):
    asked = queries(spark, d).withColumn("key", K.xyz_to_key(F.col("x"), F.col("y"), F.col("z"), DEPTH)).select("cloud_id", "point_id", "key")
    return T.search_key(stored(spark, d, DEPTH), asked, DEPTH)


@query("j4_stored_neighbors", f"SELECT cloud_id, k, count(*) AS n, sum(key)::BIGINT AS keys, sum(nkey * (key + 1))::DOUBLE AS mixed FROM {neigh_sql()} GROUP BY cloud_id, k")
def j4s(spark, d):
    found = T.neighbors(stored(spark, d, DEPTH), DEPTH)
    return found.groupBy("cloud_id", "k").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum(F.col("nkey") * (F.col("key") + 1)).cast("double").alias("mixed"))


@query("j6_stored_nearest", f"SELECT q.cloud_id, point_id, {r(*ZERO)} FROM (SELECT *, CASE WHEN {BOUNDS} THEN key END AS k FROM {QK}) q LEFT JOIN {FEAT} f ON f.cloud_id = q.cloud_id AND f.key = q.k")
def j6s(spark, d):
    return values(T.nearest(stored(spark, d, DEPTH), queries(spark, d), DEPTH), "cloud_id", "point_id")


@query("j7_stored_linear", f"SELECT cloud_id, point_id, {r(*DATA)} FROM {linear_sql(Q)}")
def j7s(spark, d):
    return values(T.linear(stored(spark, d, DEPTH, cells=(DEPTH,)), queries(spark, d), DEPTH), "cloud_id", "point_id")


@query("g3_stored_max_pool", f"SELECT cloud_id, 3 AS depth, key >> 3 AS key, {r(*[f'max({c}) AS {c}' for c in DATA])} FROM {FEAT} GROUP BY cloud_id, key >> 3")
def g3s(spark, d):
    return flat(T.max_pool(stored(spark, d, DEPTH), DEPTH))


_pairs = ", ".join(f"max_by({{'v': {c}, 's': key % 8}}, {{'v': {c}, 'o': -(key % 8)}}) AS m{k}" for k, c in enumerate(DATA))


@query("g4_stored_max_unpool", f"SELECT cloud_id, 4 AS depth, key, {r(*[f'CASE WHEN m{k}.s = key % 8 THEN m{k}.v ELSE 0 END AS d{k}' for k in range(CH)])} FROM (SELECT cloud_id, key >> 3 AS up, {_pairs} FROM {FEAT} GROUP BY cloud_id, key >> 3) JOIN (SELECT cloud_id, key, key >> 3 AS up FROM {FEAT}) USING (cloud_id, up)")
def g4s(spark, d):
    return flat(T.max_unpool(stored(spark, d, DEPTH), DEPTH))


@query("g5_stored_avg_pool", f"SELECT cloud_id, 3 AS depth, key >> 3 AS key, {r(*[f'sum({c}) / (count(*) + 1e-8) AS {c}' for c in DATA])} FROM {FEAT} GROUP BY cloud_id, key >> 3")
def g5s(spark, d):
    return flat(T.avg_pool(stored(spark, d, DEPTH), DEPTH))


@query("g11_stored_upsample", f"SELECT cloud_id, depth, key, {r(*DATA)} FROM (SELECT cloud_id, key AS pk, {', '.join(DATA)} FROM {COARSE}) JOIN (SELECT cloud_id AS c, depth, key FROM {NODES} WHERE depth = 4 AND nempty) ON c = cloud_id AND key >> 3 = pk")
def g11s(spark, d):
    return flat(T.nearest_upsample(stored(spark, d, DEPTH, DEPTH - 1), DEPTH - 1))
