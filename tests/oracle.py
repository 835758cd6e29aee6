"""A query's rows beside its SQL's, in the way that they are compared."""

import datetime
import math
import os

import duckdb
import numpy as np


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted("|".join(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted("|".join(plain(row[i]) for i in order) for row in r.fetchall())
