from pyspark.sql import functions as F

from brightwell import catalog
from brightwell.functions import text as T


def test_copies_are_counted_not_expanded(spark, tmp_path):
    names = ["old ring", "old ring", "old ring", "ring old", "copper", "the copper", "film", "film", "of", "ab cd"]
    rows = [(i * 5, f"Brand#{i % 2}", n) for i, n in enumerate(names * 3)] + [(0, "Brand#0", "old ring"), (5, "Brand#1", "copper")]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    p = spark.createDataFrame([(k, b, "Dr. " + n) for k, b, n in rows], "p_partkey bigint, p_brand string, n string").select("p_partkey", "p_brand", T.alias(F.col("n")).alias("k"))
    a, b = p.alias("a"), p.alias("b")
    want = a.join(b, F.expr("a.p_brand = b.p_brand and a.p_partkey < b.p_partkey")).filter(T.alias_same(F.col("a.k"), F.col("b.k"))).groupBy("a.p_brand").count().collect()
    got = catalog.alias_match_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and got.schema["pairs"].dataType.typeName() == "long"
    many = [(i * 5, "Brand#1", "old ring") for i in range(200_000)]
    spark.createDataFrame(many, "p_partkey bigint, p_brand string, p_name string").write.parquet(str(tmp_path / "more" / "part.parquet"))
    assert catalog.alias_match_pairs(spark, str(tmp_path / "more")).first().pairs == 200_000 * 199_999 // 2
