"""Near duplicates at other similarities than op8's."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm import near_dup


@pytest.mark.parametrize("least", [50, 70, 80, 85, 95])
def test_bands_follow_from_the_similarity(least):
    at = near_dup.level(least)
    assert at.bands * at.band_rows == near_dup.REGISTERS and (1 - (least / 100) ** at.band_rows) ** at.bands < 1e-6
    assert at.few_equal < near_dup.REGISTERS * at.least_estimate < near_dup.REGISTERS * least / 100


def test_stage_links_from_080(spark):
    r, rows = random.Random(4), []
    for k in range(20):
        base = [f"w{r.randrange(9000)}" for _ in range(150)]
        near = [f"x{k}" if i in (30, 70, 110) else w for i, w in enumerate(base)]  # 131 of 161 shingles: 0.814
        far = [f"y{k}" if i in (20, 50, 80, 120) else w for i, w in enumerate(base)]  # 126 of 166: 0.759; and farther from near
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"] for x in corpus_pipeline.remove_near_duplicates(spark, d, "").collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}
    assert {x["doc_id"] for x in near_dup.deduplicate(d).collect()} == {i for i, _ in rows}


def test_only_ids_go_to_python_when_copies_are_dropped(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None), (4, "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("span", F.expr("make_interval(0, 1)"))  # a kind that Arrow can't carry
    out = near_dup.without(d, spark.createDataFrame([(2,), (4,), (9,)], "doc_id long"))
    assert out.columns == d.columns
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    left = out.select("doc_id", "text", F.col("span").cast("string")).collect()
    assert sorted(map(str, left)) == sorted(str(Row(doc_id=i, text=t, span="1 months")) for i, t in rows if i not in (2, 4))
