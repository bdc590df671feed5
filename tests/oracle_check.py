"""Compares Spark results with SQL results: column names, row counts, sorted values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return sorted(tuple(_plain(row[place]) for place in order) for row in rows)


def differences(frame, con, sql):
    """Nothing when equal, else a short description."""
    columns = frame.columns
    mine = _sorted([tuple(row) for row in frame.collect()], columns)
    answer = con.execute(sql)
    names = [column[0] for column in answer.description]
    theirs = _sorted(answer.fetchall(), names)
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} / {len(theirs)} rows; only here {sorted(set(mine) - set(theirs))[:3]}; only there {sorted(set(theirs) - set(mine))[:3]}"
    wrong = [pair for pair in zip(mine, theirs) if pair[0] != pair[1]]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[:3]}"
    return ""
