"""F30 F37: a step that costs a row much is in the plan once."""

from pyspark.sql import functions as F

from checks import QUERIES
from strandline.operators import stats as St


def test_excess_het_walks_once_each_way(spark):
    df = spark.range(1).select(St.excess_het(F.col("id"), F.col("id") + 5, F.col("id") + 5).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
    assert round(df.first().v, 6) == 2.838932


def test_windows_read_their_spans_once(spark, sf_dir):
    plan = QUERIES["reference_windows"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "l_suppkey" not in plan  # the reads were planned three times, once for each use of the spans
