"""Queries that stage a table, on a master that is not local and with a plain shared folder in ``spark.checkpoint.dir``."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.compare import difference

ROWS = {
    "documents": """
        SELECT i AS doc_id, text, ['en', 'de'][1 + i % 2] AS lang, 's' AS source, length(text) AS n_chars
        FROM (SELECT i, repeat('word' || i % 37 || ' of ', 1 + (i % 37)::INT) || 'a' || i % 37 AS text FROM range(80) t(i))""",
    "labels": "SELECT 2 * i AS doc_id, (i % 2)::INT AS quality, (i % 3 = 0)::INT AS toxic FROM range(30) t(i)",
    "embeddings": """
        SELECT i AS vec_id, list_transform(range(64), lambda j: (((i * 31 + j * 17) % 97 - 48) / 64)::FLOAT) AS embedding,
               (i * 7 % 10)::INT AS label
        FROM range(120) t(i)""",
    "conversations": """
        SELECT i // 4 AS conv_id, i % 4 AS turn, ['user', 'assistant'][1 + i % 2] AS role, 'turn ' || i AS text
        FROM range(60) t(i)""",
    "customer": "SELECT i AS c_custkey, 'c' || i AS c_name, 1 AS c_nationkey, i * 10.5::DOUBLE AS c_acctbal, 'm' AS c_mktsegment FROM range(15) t(i)",
    "orders": """
        SELECT i AS o_orderkey, i % 15 AS o_custkey, ['F', 'O'][1 + i % 2] AS o_orderstatus,
               1000 + (i * 37 % 400)::DOUBLE * 1200 AS o_totalprice, TIMESTAMP '1997-01-01' + to_days((i * 3 % 900)::INT) AS o_orderdate,
               ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + i * 7 % 5] AS o_orderpriority
        FROM range(150) t(i)""",
    "lineitem": """
        SELECT i // 4 AS l_orderkey, i * 13 % 40 AS l_partkey, i % 5 AS l_suppkey, (1 + i % 4)::INT AS l_linenumber,
               (1 + i * 11 % 50)::DOUBLE AS l_quantity, 900 + (i * 53 % 997)::DOUBLE AS l_extendedprice,
               (i % 11)::DOUBLE / 100 AS l_discount, (i % 9)::DOUBLE / 100 AS l_tax, ['N', 'A', 'R'][1 + i % 3] AS l_returnflag,
               ['O', 'F'][1 + i % 2] AS l_linestatus, TIMESTAMP '1998-01-01' + to_days((i % 700)::INT) AS l_shipdate
        FROM range(600) t(i)""",
    "part": """
        SELECT i AS p_partkey, 'p' || i AS p_name, 'Brand#' || i % 5 AS p_brand, 't' || i % 3 AS p_type, (1 + i % 50)::INT AS p_size,
               900 + i::DOUBLE AS p_retailprice
        FROM range(40) t(i)""",
    "events": """
        SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 397) AS ts, i % 12 AS user_id,
               ['click', 'view', 'error', 'signup'][1 + i * 5 % 4] AS event_type, (i * 71 % 500)::DOUBLE / 2 AS value, '{"k": 1}' AS props
        FROM range(300) t(i)""",
}

#: By finding; those without SQL return a row per key.
NAMES = [
    "batch_split_sizes",
    "bundled_orders",
    "capped_patience_stops",
    "class_predictions",
    "class_runs_table",
    "collapsed_documents",
    "conversations_split",
    "csv_round_trip",
    "csv_texts",
    "cumulative_positives",
    "document_token_ids",
    "curated_in_batches",
    "curated_prices",
    "dual_scores",
    "fingerprint_predictions",
    "dual_scores_stream",
    "fetched_splits",
    "halving_ledger",
    "matrix_columns",
    "label_balance",
    "labels_with_documents",
    "matrix_round_trip",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, connection = tmp_path_factory.mktemp("tables"), duckdb.connect()
    for name, rows in ROWS.items():
        connection.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet'")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), connection


@pytest.fixture
def cluster(spark, tmp_path, monkeypatch):
    """The session as if its master were a cluster's that names a folder without a scheme."""
    get, folder = type(spark.conf).get, f"{tmp_path}/shared"
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: folder if key == "spark.checkpoint.dir" else get(self, key, *default))
    return spark


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_on_a_cluster_with_a_plain_shared_folder(cluster, tables, tmp_path, name):
    folder, connection = tables
    result = contract.queries()[name](cluster, folder)
    if name in contract.oracle_sql():
        assert difference(result, connection, contract.oracle_sql()[name]) == ""
    else:
        key = result.columns[0]
        assert 0 < result.count() == result.select(key).distinct().count()
    assert any((tmp_path / "shared").iterdir())
