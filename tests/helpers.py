import datetime as dt

from candlewick.schema import BAR_SCHEMA


def bar(t, symbol="AAAUSDT", o=1.0, h=None, lo=None, c=None, v=1.0, q=None, n=1, tb=0.0, tq=0.0, avg="auto"):
    h = o if h is None else h
    lo = o if lo is None else lo
    c = o if c is None else c
    q = v * o if q is None else q
    if avg == "auto":
        avg = q / v if v else None
    if isinstance(t, str):
        t = dt.datetime.fromisoformat(t)
    return (t, symbol, float(o), float(h), float(lo), float(c), float(v), float(q), int(n), float(tb), float(tq), avg)


def bars_df(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)


def series(start, count, step_min=15, symbol="AAAUSDT", price=1.0, **kw):
    t0 = dt.datetime.fromisoformat(start)
    return [bar(t0 + dt.timedelta(minutes=step_min * i), symbol, o=price + i, **kw) for i in range(count)]
