import os

import pytest

from kinweave.queries import core
from kinweave.sources import io
from tests.conftest import rows
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_agrees_with_sql(spark, name):
    compare(spark, core.QUERIES[name], core.SQL[name])


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["sim_token_ratios", "panel_identifiers", "synth_rows"])
def test_queries_without_sql(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_table_kinds(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    d.write.csv(str(tmp_path / "t.csv"), header=True)
    d.write.json(str(tmp_path / "t.json"))
    d.write.orc(str(tmp_path / "t.orc"))
    d.write.parquet(str(tmp_path / "t.parquet"))
    for kind in ("csv", "json", "orc", "parquet"):
        assert rows(io.read_table(spark, str(tmp_path / f"t.{kind}"), "id long, name string").fillna(""), "id", "name") == [(1, "a"), (2, "")]
    io.write_epochs(spark, [{"f1": 0.5}, {"f1": 0.7}], str(tmp_path / "epochs.csv"))
    assert [(r["epoch"], r["f1"]) for r in spark.read.csv(str(tmp_path / "epochs.csv"), header=True).collect()] == [("1", "0.5"), ("2", "0.7")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["suggest_top1", "suggest_topk", "sim_levenshtein", "sim_jaro_winkler", "pairs_blocked", "pairs_labelled_ids", "sim_within_km"])
def test_pair_queries_agree_with_sql_when_tables_count_as_large(spark, name, monkeypatch):
    from kinweave.operators import pairs

    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(pairs, "PAIRS_A_TASK", 40)
    monkeypatch.setattr(pairs, "MAX_TASKS", 7)
    compare(spark, core.QUERIES[name], core.SQL[name])
    assert "__left_left" in core.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
