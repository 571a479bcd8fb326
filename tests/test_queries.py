"""Every query of the comparison engine against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from foliomatch.plans import queries
from foliomatch.plans.queries import ORACLES, QUERIES
from foliomatch.sources import intermediate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


_known = {}


@pytest.fixture(autouse=True)
def pairs_found_once(spark, monkeypatch):
    """The pairs of the tables are the same for all queries over pairs: they are joined once (and held against SQL there)."""
    join = queries._closest
    monkeypatch.setattr(queries, "_closest", lambda docs: _known.setdefault("pairs", None) or _known.update(pairs=intermediate.written(join(docs), "test-pairs")) or _known["pairs"])


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in at) for r in values), key=repr)


def compare(spark, query, sql):
    df = query(spark, SF)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["diff_summary_catalog", "same_summary_catalog"])
def test_stored_words_are_not_broadcast(spark, name, monkeypatch):
    """Files are smaller than their rows: no table of words or of what is found in them may be broadcast for its files' size."""
    monkeypatch.setattr(intermediate, "LARGE_ROWS", 0)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution()
    assert "strategy=merge" in plan.optimizedPlan().toString()
    assert "Broadcast" not in plan.sparkPlan().toString()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
