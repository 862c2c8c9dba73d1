"""Physical-plan properties that matter at scale, and the SQL oracle gate."""

import duckdb
import pytest

from support import SF001
from plyframe.plans import queries as Q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_not_cut(spark):
    """Every event is a transition: as many counted as there are rows."""
    df = Q.event_transitions(spark, SF001)
    assert df.groupBy().sum("times_played").first()[0] == spark.read.parquet(f"{SF001}/events.parquet").count()


def test_top_k_trims_before_shuffle_without_python(spark):
    plan = _plan(Q.pgn_flagship(spark, SF001))
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_one_bucket_lists_one_directory(spark):
    plan = _plan(Q.bucket_partition_filter(spark, SF001))
    assert "PartitionFilters: [isnotnull(price_bucket" in plan and "price_bucket#" in plan


def test_tokens_of_both_modes_scan_once(spark):
    assert _plan(Q.move_tokens(spark, SF001)).count("FileScan") == 1


def test_scan_prunes_columns(spark):
    plan = _plan(Q.bucket_counts(spark, SF001))
    schema = plan.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert sorted(schema.split(",")) == ["o_orderpriority:string", "o_orderstatus:string", "o_totalprice:double"]


def test_filters_before_replay(spark):
    from plyframe.operators.extract import extract_positions
    from plyframe.operators.qualify import qualify_games
    plan = _plan(extract_positions(qualify_games(Q.pgn_games(spark, SF001))))
    # The header filter (Bullet, terminations, ratings) sits below the Python node.
    assert plan.index("ArrowEvalPython") < plan.index("Contains(")


@pytest.mark.parametrize("name", ["token_delta", "pgn_flagship"])
def test_game_queries_stay_in_the_jvm(spark, name):
    plan = _plan(Q.QUERIES[name](spark, SF001))
    assert "Python" not in plan and "Arrow" not in plan


def test_token_report_reads_once_and_shuffles_sums_alone(spark):
    plan = _plan(Q.token_delta_report(spark, SF001))
    assert plan.count("FileScan") == 1 and plan.count("Exchange SinglePartition") == 1 and "Exchange hash" not in plan


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events", "conversations", "pages", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as entry
    from tools.check_oracle import compare
    df = entry.queries()[name](spark, SF001)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = duck.execute(entry.oracle_sql()[name])
    assert compare(rows, cols, res.fetchall(), [d[0] for d in res.description]) is None


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["context", "rank", "move_san", "plays", "percentage"]
