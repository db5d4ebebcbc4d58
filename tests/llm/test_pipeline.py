"""The stages one after another, with nulls, clashing columns and empty tables; the queries with SQL against it."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxmill.llm import queries

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose, junk, copies, a leak, secrets, null ids and texts, ids beyond 2 ** 53 and columns the operators use."""
    rng = random.Random(3)
    prose = lambda: " ".join(f"good{int(rng.random() ** 2 * 400)}" for _ in range(80))
    item = " ".join(f"item{k}" for k in range(40))
    big = 2**60
    rows = [(big + k, prose(), "en", f"src{k % 5}", 0) for k in range(400)]
    rows += [(big + k, " ".join(f"j{rng.randrange(40)}%%%" for _ in range(80)), "en", "src1", 0) for k in range(400, 500)]
    rows += [(big + 1000 + k, rows[k][1], "en", "src2", 0) for k in range(20)]
    rows += [(big + 1100 + k, rows[k][1] + " good1", "en", "src2", 0) for k in range(20, 40)]
    rows += [(big + 2000 + k, f"{prose()} {item} {prose()}", "en", "src3", 0) for k in range(5)]
    rows += [(big + 3000 + k, f"{prose()} password=hunter2secret {prose()}", "en", "src3", 0) for k in range(5)]
    rows += [(None, prose(), None, None, None), (None, None, None, None, None), (big + 4000, None, "en", "src1", 0), (big + 4001, "", "en", "src1", 0)]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "key", "ratio", "__row", "draw", "n", "part", "take_tokens", "domain"):
        docs = docs.withColumn(name, F.lit(3))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(big + k, int(k < 400), 0) for k in range(0, 500, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def stages(spark, path):
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, path)
        made.write.parquet(f"{path}/made{k}")
        docs = spark.read.parquet(f"{path}/made{k}")
        out.append(docs)
    return out


def test_stages(spark, folder):
    path, rows = folder
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    big = 2**60
    good, apart, clean, masked, mixed = stages(spark, path)
    columns = spark.read.parquet(f"{path}/documents.parquet").columns
    assert all(x.columns == columns for x in (good, apart, clean, masked))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not ids(good) & {big + k for k in range(400, 500)} and {big + k for k in range(400)} <= ids(good)
    assert {big + k for k in range(400)} <= ids(apart) and not ids(apart) & {big + 1000 + k for k in range(200)}
    assert apart.where("doc_id is null").count() == good.where("doc_id is null").count()
    assert ids(apart) - ids(clean) == {big + 2000 + k for k in range(5)} & ids(apart)
    after = {r.doc_id: r.text for r in masked.collect() if r.doc_id is not None}
    assert ids(masked) == ids(clean) and all((t == text[k]) == ("hunter2" not in (text[k] or "")) and "hunter2" not in (t or "") for k, t in after.items())
    tokens = sum(len((r.text or "").split()) for r in masked.collect())
    taken = mixed.agg(F.sum("take_tokens")).first()[0]
    assert int(tokens * 0.6) - 50 <= taken <= int(tokens * 0.6)
    assert corpus_pipeline.run(spark, path).count() == mixed.count()


def test_empty(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (df[cols].sort_values(cols).reset_index(drop=True).astype(str) for df in (got, want))
    assert got.equals(want)
