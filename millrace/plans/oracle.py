"""The registered queries as SQL (DuckDB) over the test tables."""

from __future__ import annotations

CHG = """
p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
chg AS (
  SELECT user_id, event_id AS seq, ts, event_type, value, props,
         CASE WHEN event_type = 'error' THEN 'd' WHEN prev IS NULL OR prev = 'error' THEN 'c' ELSE 'u' END AS op,
         event_type = 'view' AND prev IS NOT NULL AND prev <> 'error' AS keep
  FROM p WHERE NOT (event_type = 'error' AND (prev IS NULL OR prev = 'error'))),
cut AS (SELECT (max(event_id) + 1) // 2 AS c FROM events)
"""


def _live(where: str = "true") -> str:
    """The state after the changes of a part of the log."""
    return f"""
SELECT c.user_id, arg_max(event_type, seq) AS event_type, arg_max(value, seq) AS value, arg_max(props, seq) FILTER (NOT keep) AS props, max(ts) AS commit_ts
FROM chg c JOIN (SELECT user_id, max(seq) FILTER (op = 'd') AS del FROM chg WHERE {where} GROUP BY 1) l ON c.user_id = l.user_id
WHERE {where} AND op <> 'd' AND seq > coalesce(del, -1) GROUP BY 1"""


STATE = f"WITH {CHG} SELECT user_id, event_type, value, props FROM ({_live()})"
FIRST, SECOND = "seq < (SELECT c FROM cut)", "seq >= (SELECT c FROM cut)"


def _action(which: str) -> str:
    return f"""WITH {CHG}, t AS ({_live(FIRST)}), b AS (SELECT user_id, arg_max(op, seq) AS op FROM chg WHERE {SECOND} GROUP BY 1)
SELECT b.user_id, CASE WHEN op = 'd' AND t.user_id IS NOT NULL THEN 'delete' WHEN op = 'd' THEN 'nothing' WHEN t.user_id IS NOT NULL THEN 'update' ELSE 'insert' END AS action
FROM b LEFT JOIN t ON b.user_id = t.user_id WHERE action = '{which}'"""


def _text(c: str, double: bool = False) -> str:
    c = f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)" if double else f"CAST({c} AS VARCHAR)"
    return rf"coalesce(replace(replace({c}, '\', '\\'), '|', '\|'), '\N')"


CUSTOMER = [("c_custkey", False), ("c_acctbal", True), ("c_mktsegment", False), ("c_name", False), ("c_nationkey", False)]
ORDERS = [("o_orderkey", False), ("o_custkey", False), ("o_orderdate", False), ("o_orderpriority", False), ("o_orderstatus", False), ("o_totalprice", True)]
NATION = [("n_nationkey", False), ("n_name", False), ("n_regionkey", False)]


def _row(cols: list[tuple[str, bool]]) -> str:
    return f"concat_ws('|', {', '.join(_text(c, d) for c, d in cols)})"


def _checksum(table: str, cols: list[tuple[str, bool]]) -> str:
    key = _text(cols[0][0])
    return f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS count, coalesce(md5(string_agg(d, '' ORDER BY chunk)), '') AS digest FROM (
SELECT substr(md5({key}), 1, 2) AS chunk, count(*) AS n, md5(string_agg(md5({_row(cols)}), '' ORDER BY {key})) AS d FROM {table} GROUP BY 1)"""


DEST = """dest AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 101 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 97 <> 0
UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 211 = 0)"""


def _compare(copy: str) -> str:
    return f"""WITH {DEST}, cmp AS (
SELECT 'public.customer' AS "table", a.count AS source_count, b.count AS copy_count, a.digest AS source_digest, b.digest AS copy_digest FROM ({_checksum("customer", CUSTOMER)}) a, ({_checksum(copy, CUSTOMER)}) b
UNION ALL SELECT 'public.nation', a.count, b.count, a.digest, b.digest FROM ({_checksum("nation", NATION)}) a, ({_checksum("nation", NATION)}) b)
"""


ROWS = 'SELECT "table", source_count, copy_count, source_digest, copy_digest, source_count = copy_count AND source_digest = copy_digest AS match FROM cmp'

WAL = """
x AS (SELECT *, event_id // 5 AS txn FROM events),
half AS (SELECT (max(txn) + 1) // 2 AS h FROM x),
done AS (SELECT x.*, txn * 10 + 1 + event_id % 5 AS pos, max(ts) OVER (PARTITION BY txn) AS cts, txn >= (SELECT h FROM half) AS late FROM x),
ok AS (SELECT * FROM done WHERE txn % 13 <> 0)
"""

LATENCY = """
e AS (SELECT ts + to_microseconds(CAST(round(value * 1000) * 1000 AS BIGINT)) AS applied, ts AS committed FROM events WHERE event_id % 50 <> 0),
s AS (SELECT CAST(date_trunc('minute', applied) AS TIMESTAMP) AS minute, applied, (epoch_us(applied) - epoch_us(committed)) / 1e6 AS s FROM e)
"""
MINUTES = "SELECT minute, count(*) AS row_count, avg(s) AS avg_latency_s, quantile_cont(s, 0.95) AS p95_latency_s, max(s) AS max_latency_s FROM s"
ROUNDED = "SELECT minute, row_count, round(avg_latency_s, 4) AS avg_latency_s, round(p95_latency_s, 4) AS p95_latency_s, round(max_latency_s, 4) AS max_latency_s FROM"

OIDS = """(VALUES (16,'boolean'),(20,'bigint'),(21,'smallint'),(23,'integer'),(25,'text'),(700,'real'),(701,'double precision'),(1042,'text'),(1043,'text'),(1082,'date'),
(1114,'timestamp'),(1184,'timestamptz'),(1700,'numeric'),(2950,'uuid'),(3802,'jsonb'),(24754,'text'),(17,'text')) v(oid, name)"""

LIVE_ORDERS = """
WITH k AS (SELECT *, o_orderkey % 7 = 0 AND o_orderkey % 21 <> 0 AS gone, o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 AS moved FROM orders)
SELECT CASE WHEN moved THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 21 <> 0 AND NOT moved THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
FROM k WHERE NOT gone"""

SQL = {
    "fold_last": f"WITH {CHG} SELECT user_id, seq, op, CASE WHEN op = 'd' THEN NULL ELSE event_type END AS event_type FROM chg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1",
    "fold_toast": STATE,
    "fold_delete": f"WITH {CHG} SELECT user_id, seq FROM (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1) WHERE op = 'd'",
    "fold_composite_pk": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1",
    "batch_by_table": """SELECT 'public.events' AS "table", count(*) AS n FROM events UNION ALL SELECT 'public.orders', count(*) FROM orders""",
    "batch_stats": f"WITH {CHG} SELECT seq // 500 AS batch, count(*) AS n_events, count(DISTINCT user_id) AS n_keys FROM chg GROUP BY 1",
    "batch_schema": """SELECT 'public.documents' AS "table", 'doc_id,lang,n_chars,source,text' AS columns, CAST(5 AS BIGINT) AS n_columns""",
    "partition_high_water": "SELECT user_id % 4 AS part, event_id, event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) = 1",
    "merge_insert": _action("insert"),
    "merge_upsert": _action("update"),
    "merge_delete": _action("delete"),
    "merge_upsert_toast": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE source END AS source, md5(text) AS text_md5 FROM documents WHERE doc_id % 5 <> 0",
    "merge_full": STATE,
    "merge_small_batch": STATE,
    "merge_metadata": f"""WITH {CHG}, b AS (SELECT DISTINCT user_id FROM chg WHERE {SECOND})
SELECT l.user_id, commit_ts, CASE WHEN b.user_id IS NULL THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '2030-01-02' END AS applied_at FROM ({_live()}) l LEFT JOIN b ON l.user_id = b.user_id""",
    "replay_idempotent": STATE,
    "split_equivalence": STATE,
    "backfill_orders": """SELECT 'r' AS op, 'public.orders' AS "table", CAST(0 AS BIGINT) AS lsn, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_orderdate AS VARCHAR) AS o_orderdate, 'bigint' AS custkey_type, 'timestamp' AS orderdate_type FROM orders""",
    "backfill_then_stream": LIVE_ORDERS,
    "wal_decode": f"""WITH {WAL} SELECT 'c' AS op, 'public.events' AS "table", event_id, event_type, CASE WHEN late THEN props END AS props, CASE WHEN late THEN 5 ELSE 4 END AS n_after, 'bigint' AS key_type FROM ok""",
    "wal_split": f"""WITH {WAL} SELECT 'c' AS op, 'public.events' AS "table", event_id, event_type, CASE WHEN late THEN props END AS props, CASE WHEN late THEN 5 ELSE 4 END AS n_after, 'bigint' AS key_type FROM ok""",
    "key_chain": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 20000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus || '/3' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders""",
    "index_keys": """SELECT * FROM (VALUES ('public.t','id',CAST(1 AS BIGINT)),('public.u','b',1),('public.u','a',2)) v("table", "column", place)""",
    "table_shapes": """SELECT * FROM (VALUES ('public.t','id','alpha,mid,zeta'),('public.u','b,a','')) v("table", pk, columns)""",
    "published_tables": """SELECT 'public.' || lower(n_name) AS "table" FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey = 1""",
    "txn_assemble": f"WITH {WAL} SELECT txn * 10 AS txn, pos, event_id FROM ok",
    "txn_stats": f"WITH {WAL} SELECT txn * 10 AS txn, count(*) AS n FROM ok GROUP BY 1",
    "txn_stamp": f"WITH {WAL} SELECT pos, txn * 100 + 99 AS lsn, cts AS commit_ts FROM ok",
    "asof_schema": f"WITH {WAL} SELECT pos, CASE WHEN late THEN 2 ELSE 1 END AS version, CASE WHEN late THEN 5 ELSE 4 END AS n_columns FROM done",
    "pk_change_split": """WITH k AS (SELECT *, o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 AS moved FROM orders)
SELECT CASE WHEN moved THEN 'c' ELSE 'u' END AS op, CASE WHEN moved THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_orderstatus, CAST(1 AS BIGINT) AS sub FROM k
UNION ALL SELECT 'd', o_orderkey, NULL, 0 FROM k WHERE moved""",
    "toast_marker": "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'text' ELSE '' END AS unchanged, CASE WHEN n_chars > 2000 THEN 1 ELSE 2 END AS n_after FROM documents",
    "event_key": """SELECT 'public.customer:{"c_custkey":"' || c_custkey || '"}' AS key FROM customer
UNION ALL SELECT DISTINCT 'public.lineitem:{"l_linenumber":"' || l_linenumber || '","l_orderkey":"' || l_orderkey || '"}' FROM lineitem""",
    "envelope_roundtrip": """SELECT 'r' AS op, 'public.customer' AS "table", c_custkey + 9007199254740993 AS c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment, CAST(3 AS BIGINT) AS n_after FROM customer""",
    "envelope_reject": "SELECT CASE event_id % 10 WHEN 0 THEN 'no op' WHEN 1 THEN 'no op' WHEN 2 THEN 'no table' WHEN 3 THEN 'unknown op' ELSE 'good' END AS verdict, count(*) AS n FROM events GROUP BY 1",
    "type_map": f"SELECT oid, name, name AS dest FROM {OIDS}",
    "pg_cast": "SELECT * FROM (VALUES (1, 9007199254740993, true, '2024-02-29', '1.5', 7), (2, -1, false, '1999-12-31', 'NaN', -32768)) v(id, i8, b, d, f8, i2)",
    "staging_rows": "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN 'd' ELSE 'u' END AS op, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'o_custkey' END AS unchanged FROM orders",
    "catalog_columns": """SELECT * FROM (VALUES ('public.t','id','bigint',true,1),('public.t','alpha','text',false,2),('public.t','mid','text',false,3),('public.t','zeta','text',false,4),('public.u','a','int',true,1),('public.u','b','int',true,2)) v("table", "column", type, is_key, place)""",
    "checksum_customer": _checksum("customer", CUSTOMER),
    "checksum_orders": _checksum("orders", ORDERS),
    "checksum_nation": _checksum("nation", NATION),
    "checksum_empty": "SELECT CAST(0 AS BIGINT) AS count, '' AS digest",
    "verify_match": _compare("customer") + ROWS,
    "verify_mismatch": _compare("dest") + ROWS,
    "verify_report": _compare("dest") + f"""SELECT "table", CASE WHEN match THEN 'MATCH ' ELSE 'MISMATCH ' END || "table" || ': ' || source_count || ' ' || substr(source_digest, 1, 8) || ' / ' || copy_count || ' ' || substr(copy_digest, 1, 8) AS line FROM ({ROWS})""",
    "verify_row_diff": f"""WITH {DEST} SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'missing' WHEN a.c_custkey IS NULL THEN 'extra' ELSE 'changed' END AS diff
FROM customer a FULL OUTER JOIN dest b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR (a.c_name, a.c_nationkey, a.c_acctbal, a.c_mktsegment) IS DISTINCT FROM (b.c_name, b.c_nationkey, b.c_acctbal, b.c_mktsegment)""",
    "replica_counts": f"WITH {DEST} SELECT 'source' AS side, count(*) AS n FROM customer UNION ALL SELECT 'copy', count(*) FROM dest",
    "latency_by_minute": f"WITH {LATENCY} {ROUNDED} ({MINUTES} GROUP BY 1)",
    "latency_since": f"WITH {LATENCY}, newest AS (SELECT max(ts + to_microseconds(CAST(round(value * 1000) * 1000 AS BIGINT))) AS m FROM events) {ROUNDED} ({MINUTES} WHERE applied >= (SELECT m FROM newest) - INTERVAL 1 DAY GROUP BY 1)",
    "latency_overall": f"WITH {LATENCY}, m AS ({MINUTES} GROUP BY 1) SELECT CAST(sum(row_count) AS BIGINT) AS row_count, round(sum(avg_latency_s * row_count) / sum(row_count), 4) AS avg_latency_s, round(max(p95_latency_s), 4) AS p95_max_bucket_s, round(max(max_latency_s), 4) AS max_latency_s, (SELECT round(quantile_cont(s, 0.95), 4) FROM s) AS p95_true_s FROM m",
    "latency_csv": f"""WITH {LATENCY} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, CAST(row_count AS VARCHAR) AS row_count, printf('%.3f', round(avg_latency_s, 6) + 1e-9) AS avg_latency_s,
printf('%.3f', round(p95_latency_s, 6) + 1e-9) AS p95_latency_s, printf('%.3f', round(max_latency_s, 6) + 1e-9) AS max_latency_s FROM ({MINUTES} GROUP BY 1)""",
    "load_counts": """WITH c AS (SELECT count(*) AS n FROM customer)
SELECT * FROM (SELECT unnest(['animal', 'animal', 'animal', 'observation', 'observation', 'observation']) AS kind, unnest(['c', 'u', 'd', 'c', 'u', 'd']) AS op, unnest([n, n, n // 3, n, n, n // 3]) AS n FROM c) WHERE n > 0""",
    "load_changelog": """WITH c AS (SELECT count(*) AS total FROM customer), r AS (SELECT unnest(range(1, total + 1)) AS id, total FROM c), i AS (SELECT id, (id + 1) % 3 = 0 AND id < total AS gone FROM r),
n AS (SELECT id, string_agg(md5(id || '-' || j), '' ORDER BY j) AS notes FROM i, range(1, 301) r(j) WHERE NOT gone GROUP BY id)
SELECT 'animal' AS kind, id, 'adult' AS status, CAST(0 AS BIGINT) AS n_notes, md5('') AS notes_md5 FROM i WHERE NOT gone UNION ALL SELECT 'observation', id, 'moved', length(notes), md5(notes) FROM n""",
}
