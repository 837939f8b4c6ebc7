import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brightwell import catalog
from brightwell.functions import text as T
from brightwell.operators import nearest


def brute(ids, vectors, k=5):
    """All pairs, by Spark's own order."""
    out = {}
    for i, a in zip(ids, vectors):
        near = []
        for j, b in zip(ids, vectors):
            if j != i:
                near.append((j, sum((x * y for x, y in zip(a, b)), 0.0)))
        out.setdefault(i, []).extend(near)
    return out


def test_all_that_counts_is_among_the_candidates(monkeypatch):
    rng = np.random.default_rng(5)
    few = (rng.integers(-2, 3, (12, 4)) * 0.0005).astype(np.float32)  # equal vectors, equal scores, scores at half a millionth
    for vectors in (rng.normal(size=(80, 4)).astype(np.float32), few[rng.integers(0, 12, 80)], np.zeros((80, 4), np.float32), few[rng.integers(0, 12, 80)] * np.float32(1e6)):
        ids = np.concatenate([rng.permutation(70), np.arange(10)])  # ten ids come twice
        for cells in (100, 1 << 21):
            monkeypatch.setattr(nearest, "CELLS", cells)
            row, both = np.arange(160) < 80, pa.array([*vectors.tolist(), *vectors.tolist()], pa.list_(pa.float32()))
            got = {}
            for x, y, z in nearest.tile(row, np.concatenate([ids, ids]), both, 5, 6):
                for i, j, s in zip(x.tolist(), y.tolist(), z.tolist()):
                    got.setdefault(i, []).append((j, s))
            up = lambda s: round(s + 1e-13, 6)
            rank = lambda near: sorted(((-up(s), j) for j, s in near))[:5]
            for i, near in brute(ids.tolist(), vectors.astype(float).tolist()).items():
                assert rank(got[i]) == rank(near)


def test_tiles_give_the_result_of_the_join(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 8], int(i % 3)) for i in range(300)]
    rows += [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [1.0], 1), (903, [2.0], 7), (904, None, 7), (905, [1.0, 2.0], 7), (906, [], 8), (None, [1.0], 8), (907, [1.0], None)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    b = e.select("label", F.col("vec_id").alias("near_id"), F.col("embedding").alias("other"))
    want = e.join(b, "label").filter("vec_id <> near_id").select("vec_id", "near_id", F.round(T.dot(F.col("embedding"), F.col("other")), 6).alias("score"))
    from pyspark.sql import Window as W

    want = want.withColumn("place", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "near_id"))).filter("place <= 5")
    got = catalog.seed_topk_vectors(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema


def test_pairs_are_no_rows(spark, tmp_path):
    """1,500 copies of one vector are 2.2 million pairs; before, each was a row of a join."""
    spark.range(1500).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5).cast("float")] * 8).alias("embedding"), F.lit(1).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert nearest.candidates(e, 5, 6).count() <= 5 * 1500
    got = catalog.seed_topk_vectors(spark, str(tmp_path)).groupBy("vec_id").agg(F.collect_set("near_id").alias("n")).filter("vec_id in (0, 3, 700)").collect()
    assert {r.vec_id: sorted(r.n) for r in got} == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 700: [0, 1, 2, 3, 4]}
