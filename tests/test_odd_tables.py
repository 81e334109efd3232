"""Queries against their SQL over tables that hold what the given small ones don't."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.llm import topk
from corpusloom.operators import dedup, tables
from tests import compare


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query over events, given as SQL, has the rows of the query's SQL."""

    def check(name, events):
        con = duckdb.connect()
        con.sql(f"copy ({events}) to '{tmp_path}/events.parquet'")
        con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
        want = compare.sql_rows(con, catalog.oracle_sql()[name])
        assert want[1]
        assert compare.spark_rows(catalog.queries()[name](spark, str(tmp_path))) == want

    return check


def test_overlaps_of_events_without_length(agrees):
    """A purchase of value 0 has no length and lies within a view."""
    agrees("j_overlap", """select i as event_id, timestamp '2024-01-01 00:00:00' + to_seconds(i * 30) as ts, i % 3 as user_id,
        case when i % 2 = 0 then 'purchase' when i % 5 = 0 then 'signup' else 'view' end as event_type, case when i % 4 < 2 then 0.0::double else i % 7 end as value from range(200) r(i)""")


#: Events every 0.4 s around midnight: the last half second counts for the next day.
MIDNIGHT = """select i as event_id, timestamp '2024-01-01 23:59:50.05' + to_milliseconds((i * 400)::bigint) as ts, i % 23 as user_id,
    case i % 3 when 0 then 'click' when 1 then 'view' else 'error' end as event_type, (i * 7 % 50)::double as value, '' as props from range(60) r(i)"""


def test_candidates_around_midnight(agrees):
    agrees("dedup_candidates", MIDNIGHT)


def test_fusion_around_midnight(agrees):
    agrees("rrf_fusion", MIDNIGHT)


def test_rollup_with_events_of_no_type(agrees):
    agrees("sketch_rollup", """select i as event_id, timestamp '2024-01-09 12:00:00' + to_minutes((i * 9)::bigint) as ts, i % 40 as user_id,
        case i % 3 when 0 then 'click' when 1 then 'view' end as event_type, (i * 7 % 50)::double as value from range(1800) r(i)""")


def test_case_means_between_two_roundings(agrees):
    """Sums in the order of the events and metrics, rounded in binary; and the events of no user."""
    agrees("eval_case_report", """select i as event_id, timestamp '2024-01-01' as ts, case when i % 401 > 0 then (i * 7919 % 400)::bigint end as user_id, 'view' as event_type, 1.0::double as value from range(26000) r(i)""")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_keep_no_states_for_each_part(spark, small):
    """Before, every part of every flag had three approximate and exact states of its own."""
    df = catalog.queries()["agg_approx_bounds"](spark, small)
    own = [line for line in plan(df).splitlines() if "Aggregate" in line and "l_partkey" in line.split("functions=")[0]]
    assert own and not any("percentile" in line or "approx" in line for line in own)


def test_near_pairs_are_not_sent_to_the_driver(spark):
    """Before, 20 rows of each fingerprint were broadcast."""
    rows = plan(dedup.near_pairs(spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") * 3).alias("fp"))))
    assert "SortMergeJoin" in rows and "Broadcast" not in rows


def test_blocks_of_queries_are_not_sent_to_the_driver(spark):
    """Before, the blocks of queries were broadcast once for each block of candidates."""
    rows = spark.range(400).select(F.col("id").alias("key"), "id", F.array(*[F.sin(F.col("id") * k) * 1000 for k in range(1, 5)]).alias("vec")).withColumn("vec", topk.quantized(F.col("vec"), 1))
    queries = topk._blocked(rows.where("id % 10 = 0"), 2, "qblock").withColumnsRenamed({"ids": "qids", "keys": "qkeys", "mat": "qmat"})
    found = plan(topk._pairs(tables.written(queries, "q"), tables.written(topk._blocked(rows, 7, "block"), "c"), 7))
    assert "SortMergeJoin" in found and "Broadcast" not in found


def test_fingerprints_of_kept_documents_are_made_once(spark, small):
    """Before, the pairs were broadcast as above and the texts hashed four times."""
    assert "EvalPython" not in plan(dedup.kept_documents(dedup.fingerprints(spark.read.parquet(f"{small}/documents.parquet"))))
