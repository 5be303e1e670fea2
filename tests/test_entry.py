import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return [names[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = catalogue.queries()[name](spark, sf), con.execute(catalogue.oracle_sql()[name])
    assert rows(ours.columns, ours.collect()) == rows([c[0] for c in theirs.description], theirs.fetchall())


@pytest.mark.parametrize("name", ["asof_batch_backward", "asof_batch_forward"])
def test_asof_answers_every_event(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    ours, events = catalogue.queries()[name](spark, "/root/testdata/sf0.001"), con.execute("SELECT count(*) FROM events").fetchone()[0]
    theirs = con.execute(catalogue.oracle_sql()[name])
    found = rows(ours.columns, ours.collect())
    assert len(found[1]) == events
    assert found == rows([c[0] for c in theirs.description], theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
