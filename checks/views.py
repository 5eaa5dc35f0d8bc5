"""Faulty tables derived from the given ones; the same text runs in Spark and DuckDB."""

_MESSY_ORDER = """
SELECT CAST(o_orderkey AS STRING) AS order_key,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS STRING) END AS store_id,
 CASE WHEN o_orderkey % 53 = 0 THEN ''
      WHEN o_orderkey % 7 = 0 THEN CONCAT(SUBSTRING(CAST(o_orderdate AS STRING),6,2),'/',SUBSTRING(CAST(o_orderdate AS STRING),9,2),'/',SUBSTRING(CAST(o_orderdate AS STRING),1,4))
      ELSE SUBSTRING(CAST(o_orderdate AS STRING),1,10) END AS date,
 CASE WHEN o_orderkey % 61 = 0 THEN ' nan'
      WHEN o_orderkey % 11 = 0 THEN CONCAT(' SKU', CAST(o_custkey % 40 AS STRING), ' ')
      ELSE CONCAT('SKU', CAST(o_custkey % 40 AS STRING)) END AS sku,
 CASE WHEN o_orderkey % 41 = 0 THEN 'TBD' WHEN o_orderkey % 43 = 0 THEN '-5'
      WHEN o_orderkey % 401 = 0 THEN '99999999'
      ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 1000 AS STRING) END AS sales,
 CASE WHEN o_orderkey % 31 = 0 THEN 'no-at-sign' WHEN o_orderkey % 37 = 0 THEN 'a@@b.com'
      WHEN o_orderkey % 47 = 0 THEN 'x@nodot' WHEN o_orderkey % 59 = 0 THEN NULL
      ELSE CONCAT('user', CAST(o_custkey AS STRING), '@example.com') END AS email,
 CASE WHEN o_orderkey % 71 = 0 THEN 'cafÃ©' ELSE o_orderpriority END AS note
FROM {orders}
"""

MESSY_ORDERS = f"{_MESSY_ORDER} UNION ALL {_MESSY_ORDER} WHERE o_orderkey % 50 = 0"

MESSY_SURVEY = """
SELECT CONCAT('R', CAST(CASE WHEN event_id % 40 = 1 THEN event_id - 1 ELSE event_id END AS STRING)) AS respondent_id,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(user_id % 5 + 1 AS STRING) END AS q1,
 CASE WHEN event_id % 6 = 0 THEN ' ' WHEN event_id % 8 = 3 THEN 'Agree' ELSE CAST(event_id % 5 + 1 AS STRING) END AS q2,
 CASE WHEN event_id % 12 = 0 THEN 'nan' ELSE event_type END AS q3,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS score
FROM {events}
"""

DRIFT_BASELINE = "SELECT event_id, value, event_type FROM {events} WHERE event_id % 2 = 0"

DRIFT_CURRENT = """
SELECT event_id, CASE WHEN event_type = 'click' THEN value * 1.5 ELSE value END AS value,
       CAST(event_id AS STRING) AS extra
FROM {events} WHERE event_id % 2 = 1
"""

# labels with a gap in the label and a customer table with an e-mail, for two contracts
MESSY_LABELS = """
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE quality END AS label, toxic
FROM {labels}
"""

MESSY_CLIENTS = """
SELECT CASE WHEN c_custkey % 101 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END AS customer_id,
 CASE WHEN c_custkey % 17 = 0 THEN 'broken@' WHEN c_custkey % 23 = 0 THEN NULL
      ELSE CONCAT('c', CAST(c_custkey AS STRING), '@bank.example') END AS email,
 c_acctbal AS balance, c_mktsegment AS segment
FROM {customer}
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def in_duckdb(view: str) -> str:
    return view.format(**{t: t for t in TABLES})


def in_spark(spark, sf_dir: str, view: str):
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in view}
    return spark.sql(view, **used)
