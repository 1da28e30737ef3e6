"""Every query against its SQL, and the queries without SQL for their rows."""

import math

import pytest

from wavecrest.operators import windows
from wavecrest.plans.catalog import QUERIES
from wavecrest.plans.oracle import ORACLE_SQL
from wavecrest.sources.views import event_labels

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL and n not in ("svm_report", "mlp_report")])
def test_other_queries_have_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["mutual_information", "mi_graph_features"])
def test_dense_events_fall_into_the_bins_of_sql_on_one_thread(spark, tmp_path, name):
    """Many events of one hour, in files whose order isn't that of their ids: sums that round otherwise would move means that lie on a bin's edge."""
    copies = spark.range(60).selectExpr("id AS copy").crossJoin(spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id < 500"))
    copies = copies.withColumn("event_id", copies.event_id + copies.copy * 1_000_000).drop("copy")
    copies.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = sorted((tuple(plain(r[c]) for c in names) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=str)


def test_an_edge_of_bins_is_decided_by_the_order_of_ids_however_events_lie(spark, tmp_path):
    """SQL on one thread has another row if it reads the three events of an hour in another order, as its threads do at size; the query has that of ``event_id`` for both."""
    events = "SELECT event_id, ts, user_id, event_type, value FROM '/root/testdata/sf0.001/events.parquet' WHERE event_type <> 'click' OR value < 240 AND date_trunc('hour', ts) NOT IN ('2024-01-18 22:00', '2024-01-19 06:00')"
    # of a range from 0 to 249 in 15 bins, the mean 49.8 is the edge of the third
    edge = "VALUES (1001, TIMESTAMP '2024-01-18 22:10', 0, 'click', 249.0), (1002, '2024-01-19 06:10', 0, 'click', 89.83), (1003, '2024-01-19 06:20', 0, 'click', 18.01), (1004, '2024-01-19 06:30', 0, 'click', 41.56)"
    got, want = [], []
    for way, order in (("ids", "event_id"), ("values", "value DESC")):
        (tmp_path / way).mkdir()
        con = duckdb.connect(config={"threads": 1})
        con.execute(f"COPY ({events} UNION ALL {edge} ORDER BY {order}) TO '{tmp_path}/{way}/events.parquet'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{way}/events.parquet'")
        want.append(sorted(con.execute(ORACLE_SQL["mi_graph_features"]).fetchall()))
        got.append(sorted((r.task, list(r.features)) for r in QUERIES["mi_graph_features"](spark, f"{tmp_path}/{way}").collect()))
    assert got[0] == got[1] == want[0] != want[1]


def test_segmentation_is_of_smoothed_labels(spark, sf_dir):
    labels = event_labels(spark, sf_dir)
    smooth = windows.smooth_labels(labels, 2)
    got, want, other = (sorted(map(tuple, df.collect())) for df in (QUERIES["segmentation"](spark, sf_dir), *(windows.segment(x, 1.0, 5.0, (1, 1), 3, 10.0, 0, 2000.0) for x in (smooth, labels))))
    assert got == want != other
