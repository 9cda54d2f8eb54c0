"""Every query of the library against its SQL."""

import duckdb
import pytest

from dialoom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def shown(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


#: The assist rules are a fold with a memory; tests/test_assist.py holds every rule against what it must give.
FOLDS = {"assisted_lines", "assist_totals"}


def test_every_other_query_has_sql():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == FOLDS


def test_assisted_lines_cover_all_quotations(spark):
    lines = [r.asDict() for r in plans.QUERIES["assisted_lines"](spark, SF).collect()]
    quotes = plans.QUERIES["quoted_cues"](spark, SF).collect()
    assert sorted((r["conv_id"], r["i"]) for r in lines) == sorted((r.conv_id, r.idx * 8 + r.k) for r in quotes)
    totals = {}
    for r in lines:
        n = totals.setdefault(r["conv_id"], [0, 0, 0, 0])
        n[0] += 1
        n[1] += r["disposition"] == "auto_apply"
        n[2] += r["action"] == "reassign_existing"
        n[3] += r["reasons"] == "step_limit_reached"
    assert {r.conv_id: [r.scanned, r.auto_apply, r.reassigned, r.undecided] for r in plans.QUERIES["assist_totals"](spark, SF).collect()} == totals


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = db.execute(f"SELECT * FROM ({plans.ORACLE_SQL[name]})")
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = [tuple(r[at.index(c)] for c in columns) for r in found.fetchall()]
    assert shown(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect())) == shown(want)
