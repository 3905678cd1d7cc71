import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.plans.series import with_neighbour


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(min_value=0, max_value=60 * 24 * 5)),
                min_size=1, max_size=60, unique=True))
def test_with_neighbour_equals_lag_and_lead(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(s, t0 + dt.timedelta(minutes=m)) for s, m in rows]
    df = spark.createDataFrame(data, "symbol string, t timestamp_ntz")
    w = Window.partitionBy("symbol").orderBy("t")
    want = df.select("symbol", "t", F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("n"))
    got = with_neighbour(with_neighbour(df, ["symbol"], "t", "p", "prev"), ["symbol"], "t", "n", "next")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.select("symbol", "t", "p", "n").collect()))
