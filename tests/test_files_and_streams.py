import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import ivf, knn, spec
from ridgeline.plans import catalog
from ridgeline.sources import store, vecs
from ridgeline.streaming import ingest


def write_raw(path, rows, fmt):
    with open(path, "wb") as f:
        for r in rows:
            f.write(struct.pack("<i", len(r)) + struct.pack(f"<{len(r)}{fmt}", *r))


def test_vector_files(spark, tmp_path):
    rows = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    for kind, fmt in (("fvecs", "f"), ("ivecs", "i"), ("bvecs", "B")):
        path = tmp_path / f"x.{kind}"
        write_raw(path, rows, fmt)
        got = sorted((r.id, [float(v) for v in r.vec]) for r in vecs.read_vecs(spark, f"file://{path}").collect())
        assert got == [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    with open(tmp_path / "x.fbin", "wb") as f:
        f.write(struct.pack("<ii", 3, 3) + np.array(rows, "<f4").tobytes())
    got = sorted((r.id, list(r.vec)) for r in vecs.read_fbin(spark, f"file://{tmp_path}/x.fbin").collect())
    assert got == [(i, [float(v) for v in r]) for i, r in enumerate(rows)]


def test_vector_files_round_trip(spark, tmp_path):
    df = vecs.synthetic(spark, 40, 6)
    vecs.write_vecs(df, f"file://{tmp_path}/out")
    back = vecs.read_vecs_folder(spark, f"file://{tmp_path}/out")
    a = {r.id: list(r.vec) for r in df.collect()}
    assert {r.id: list(r.vec) for r in back.collect()} == a


def test_index_folder_round_trip(spark, tmp_path):
    df = vecs.synthetic(spark, 120, 8)
    q = df.filter("id < 4").select(F.col("id").alias("qid"), "vec")
    for text in ("Flat", "IVF4,SQ8", "PCA4,Flat", "OPQ2_4,IVF4,PQ2x4", "HNSW8,SQ8", "IVF4,FlatDedup", "IVF4,ITQ4,SH3c", "IVF4,PQ2+2"):
        index = spec.build(text, df, niter=2).add(df)
        path = f"file://{tmp_path}/{text.replace(',', '_')}"
        store.save(index, path)
        a, b = (sorted(map(tuple, i.search(q, 3, nprobe=4).select("qid", "rank", "id").collect())) for i in (index, store.load(spark, path)))
        assert a == b
        assert b"pickle" not in store.index_to_bytes(index)
        c = store.index_from_bytes(spark, store.index_to_bytes(index)).search(q, 3, nprobe=4).select("qid", "rank", "id")
        assert sorted(map(tuple, c.collect())) == a
    tables = store.from_bytes(spark, store.to_bytes({"rows": df}))
    assert tables["rows"].count() == 120
    parts = []
    trained = spec.build("IVF4,Flat", df, niter=2)
    for i in range(2):
        parts.append(f"file://{tmp_path}/part{i}")
        store.save(trained.add(df.filter(F.col("id") % 2 == i)), parts[-1])
    merged = store.merge_on_disk(spark, trained, parts, f"file://{tmp_path}/merged")
    assert merged.rows.count() == 120


def test_streams(spark, tmp_path):
    df = vecs.synthetic(spark, 60, 4).withColumn("at", F.timestamp_seconds(F.col("id") * 10))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    c = ivf.train(df.select("id", "vec"), 4, niter=2)
    ingest.ingest(stream, c, f"{tmp_path}/lists", f"{tmp_path}/ck1").awaitTermination(120)
    rows = ingest.postings(spark, f"{tmp_path}/lists")
    assert rows.count() == 60
    found = []
    asked = stream.select(F.col("id").alias("qid"), "vec")
    ingest.query_stream(asked, rows.select("id", "list_no", "vec"), c, 1, 4, lambda r, n: found.extend(r.collect()), f"{tmp_path}/ck2").awaitTermination(120)
    assert {(r.qid, r.id) for r in found} == {(i, i) for i in range(60)}
    counts = ingest.windowed_counts(stream, c, "at", "5 minutes", "1 minute")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck3").start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 60
    assert ingest.expire(df, "at", df.agg(F.max("at")).first()[0], "100 SECONDS").count() == 10
    assert knn.knn(asked_batch(df), df.select("id", "vec"), 1).count() == 60


def asked_batch(df):
    return df.select(F.col("id").alias("qid"), "vec")


@pytest.mark.parametrize("name", ["stream_ingest", "stream_queries", "stream_window_counts"])
def test_stream_queries_of_a_table_in_a_folder(spark, data, tmp_path, name):
    """A table may be a folder of files, and its labels need not count from 0."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("label", (F.col("label") * 3 + 5).cast("int"))
    rows.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())
