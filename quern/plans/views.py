"""Input views that queries derive from the stored tables.

Each view is one SELECT that Spark SQL and the oracle engine read alike. FROM names a
stored table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "corpus": "SELECT doc_id AS document_id, text AS content, doc_id % 3 AS shard_id, lang, source FROM documents",
    "query_batch": (
        "SELECT * FROM (VALUES (1,'the and','or',10),(2,'the and','and',10),(3,'and die the','or',5),(4,'and die the','and',100),(5,'que','or',10),(6,'license thou','and',10),"
        "(7,'THE, the; The!','or',3),(8,'zzzqqq the','and',10),(9,'zzzqqq the','or',10),(10,'!!!','or',10),(11,'   ','or',10),(12,'thou','or',0),(13,'the and','xor',10),(14,'the','AND',5)) AS q(query_id, query, mode, lim) "
        # and the shortest text of each language and source, so that requests grow with the table
        "UNION ALL SELECT CAST(100 + row_number() OVER (ORDER BY lang, source) AS INT), query, CASE WHEN lang = 'en' THEN 'and' ELSE 'or' END, 250 "
        "FROM (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, min_by(text, length(text) * 1000000000000 + doc_id) AS query FROM documents GROUP BY 1, 2) g"
    ),
    # a request for each document, with blank, padded and wrong ones among them
    "requests": (
        "SELECT doc_id AS query_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN '  ' || source || ' the ' WHEN 3 THEN source || '!' ELSE lang || ' ' || source END AS query, "
        "CASE doc_id % 5 WHEN 0 THEN 'and' WHEN 1 THEN '' WHEN 2 THEN 'xor' ELSE 'or' END AS mode, doc_id % 103 - 1 AS lim FROM documents"
    ),
    "request_log": """SELECT event_id AS request_id, ts, user_id % 3 AS node_id,
 CASE WHEN event_type IN ('view','click') THEN 'search' WHEN event_type IN ('signup','purchase') THEN 'write'
      WHEN event_id % 4 < 3 THEN 'search' ELSE 'write' END AS op,
 CASE WHEN event_id % 4 < 2 THEN 1 ELSE 3 END AS rf,
 CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS concurrency,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 429 WHEN event_type = 'error' THEN 503
      WHEN event_type IN ('view','click') THEN 200 ELSE 201 END AS status_code,
 event_type <> 'error' AS success, event_id % 11 <> 0 AS complete, value AS latency_ms,
 CASE event_type WHEN 'error' THEN 'Open' WHEN 'signup' THEN 'HalfOpen' ELSE 'Closed' END AS circuit_state,
 CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 6 = 0 THEN 'Connection failed to node 1'
      WHEN event_id % 6 = 1 THEN 'reset by peer' WHEN event_id % 6 = 2 THEN 'read timeout'
      WHEN event_id % 6 = 3 THEN 'Document with id 1 not found' WHEN event_id % 6 = 4 THEN 'Internal server error'
      ELSE 'strange' END AS error_message
FROM events""",
    # log_offset is the order of the log; the ids in it come from several writers and clash
    "mutation_log": """SELECT event_id AS log_offset, event_id % 97 AS document_id, topic,
 CASE WHEN et = 'error' AND event_id % 3 = 0 THEN 'not json'
      WHEN et = 'error' AND event_id % 3 = 1 THEN '{"event_id":' || (event_id % 1000) || ',"event_type":"document_indexed","document_id":' || (event_id % 97) || '}'
      ELSE '{"event_id":' || (event_id % 1000) || ',"event_type":"' || CASE et WHEN 'view' THEN 'document_indexed' WHEN 'signup' THEN 'document_indexed'
             WHEN 'click' THEN 'document_updated' WHEN 'purchase' THEN 'document_removed' ELSE 'document_archived' END
           || '","document_id":' || (event_id % 97) || ',"shard_id":' || (event_id % 97 % 3) || ',"source_node_id":' || (user_id % 3)
           || CASE WHEN et = 'purchase' THEN '' WHEN event_id % 23 = 0 THEN ',"document_content":"   "' ELSE ',"document_content":"text v' || (user_id % 2) || '"' END || '}' END AS payload
FROM (SELECT event_id, user_id, event_type AS et, CASE WHEN event_id % 101 = 0 THEN 'other.topic' ELSE 'documents.mutations' END AS topic FROM events) e""",
    "outbox_log": """SELECT event_id AS seq, event_id % 53 AS outbox_id, CASE event_type WHEN 'view' THEN 'mark_dispatching' WHEN 'click' THEN 'record_attempt'
 WHEN 'purchase' THEN 'mark_published' WHEN 'error' THEN 'mark_failed' ELSE 'requeue' END AS action FROM events""",
    "outbox": """SELECT event_id AS id, 'documents.mutations' AS topic, event_id % 97 AS doc_key, CASE event_type WHEN 'purchase' THEN 'PUBLISHED' WHEN 'error' THEN 'FAILED'
 WHEN 'click' THEN 'DISPATCHING' ELSE 'PENDING' END AS status, event_id % 4 AS attempt_count FROM events""",
    "attempt_log": "SELECT event_id % 211 AS message_id, event_id AS seq, 'topic-' || (event_id % 211 % 2) AS topic, event_type = 'purchase' AS ok FROM events",
    "lag_samples": """SELECT event_id % 40 AS sample_index, CASE WHEN event_id % 40 < 5 THEN 'baseline' WHEN event_id % 40 < 30 THEN 'workload' WHEN event_id % 40 < 31 THEN 'workload_end' ELSE 'drain' END AS phase,
 'node-' || (user_id % 3) AS consumer_group, (event_id + user_id) % 3 AS part, MIN(event_id) AS log_start_offset, MAX(event_id) AS log_end_offset,
 MAX(CASE WHEN event_type <> 'error' THEN event_id END) AS current_offset, MAX(CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END) = 1 AS query_failed
FROM events GROUP BY 1,2,3,4""",
    "replica_inventory": """SELECT n.node_id, d.doc_id AS document_id, d.doc_id % 3 AS shard_id, CASE WHEN d.doc_id % 31 = 0 AND n.node_id = 1 THEN d.text || '!' ELSE d.text END AS content
FROM documents d CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2)) AS v(node_id)) n
WHERE ((n.node_id - d.doc_id % 3 + 3) % 3 < 2 AND (d.doc_id + n.node_id) % 17 <> 0) OR ((n.node_id - d.doc_id % 3 + 3) % 3 = 2 AND d.doc_id % 29 = 0)""",
    # the answers of each replica to a count and to a search, at the last span of the log in
    # which one shard had no replica that counts and one that counts could not be searched
    "shard_health": """WITH answers AS (SELECT event_id - event_id % 50 AS span, event_id % 3 AS shard_id, user_id % 2 AS replica_rank, max_by(event_type, event_id) AS et FROM events GROUP BY 1, 2, 3),
 pins AS (SELECT span, shard_id, count(*) AS k, min(CASE WHEN et <> 'error' THEN replica_rank END) AS pin, min_by(et, CASE WHEN et <> 'error' THEN replica_rank ELSE 9 END) AS pin_et FROM answers GROUP BY 1, 2),
 partly AS (SELECT span FROM pins GROUP BY span HAVING sum(k) = 6 AND sum(CASE WHEN pin IS NULL THEN 1 ELSE 0 END) = 1 AND sum(CASE WHEN pin IS NOT NULL AND pin_et = 'signup' THEN 1 ELSE 0 END) = 1)
SELECT shard_id, replica_rank, (shard_id + replica_rank) % 3 AS node_id, et <> 'error' AS count_ok, et NOT IN ('error', 'signup') AS search_ok
FROM answers WHERE span = coalesce((SELECT max(span) FROM partly), (SELECT max(span) FROM answers))""",
    "propagation_log": """SELECT event_id AS document_id, value AS t_write_done, value + event_id % 7 AS t_published,
 CASE WHEN event_id % 37 = 0 THEN NULL ELSE value + event_id % 13 END AS t_node1, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value + event_id % 17 END AS t_node2 FROM events""",
    # writes of few contents by 997 documents, so that contents come again
    "write_log": """SELECT event_id AS write_id, event_id % 997 AS document_id, CASE WHEN event_type = 'purchase' THEN NULL ELSE 'v' || (user_id % 4) END AS content, ts AS t_write FROM events""",
    # when the topic (0) and the nodes first showed a write: lost, stale, late and early ones among them
    "observation_log": """SELECT n.node_id, event_id % 997 AS document_id,
 CASE WHEN (event_id + n.node_id) % 31 = 0 THEN 'stale' WHEN event_type = 'purchase' THEN NULL ELSE 'v' || (user_id % 4) END AS content,
 ts + INTERVAL '1' SECOND * CAST((event_id * (n.node_id + 3)) % (3 + 3 * n.node_id) + CASE WHEN event_id % 53 = n.node_id THEN 25 ELSE 0 END - CASE WHEN event_id % 71 = 5 THEN 90 ELSE 0 END AS INT) AS t_seen
FROM events CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2)) AS v(node_id)) n WHERE (event_id + 2 * n.node_id) % 43 <> 0""",
    # a write for each document, and a second one: new, clashing, repeated and blank ones
    "write_batch": """SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS document_id, CASE WHEN doc_id % 15 = 0 THEN '  ' ELSE text || ' v2' END AS content FROM documents
UNION ALL SELECT doc_id + 5000000000, CASE WHEN doc_id % 9 = 3 THEN doc_id + 1000000000 ELSE doc_id + 2000000000 END, 'again' FROM documents""",
    # writes of all kinds; a quarter of them go to one id, and every fourth id is new
    "mixed_batch": """SELECT doc_id * 4 + v AS seq, CASE WHEN doc_id % 4 = 0 THEN 7 WHEN doc_id % 4 = 1 THEN doc_id + 1000000000 ELSE doc_id END AS document_id,
 CASE (doc_id * 7 + v * 5 + doc_id % 11) % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' WHEN 2 THEN 'insert' ELSE 'update' END AS kind,
 CASE WHEN (doc_id + v) % 13 = 0 THEN '  ' WHEN (doc_id + v) % 6 = 5 THEN text ELSE text || ' v' || v END AS content
FROM documents CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2),(3)) AS v(v)) x""",
    # copies as nodes hold them, some under a second shard or not where they should be
    "placed_inventory": """SELECT n.node_id, d.doc_id AS document_id, CASE WHEN d.doc_id % 37 = 5 AND n.node_id = (d.doc_id + 1) % 3 THEN (d.doc_id + 1) % 3 ELSE d.doc_id % 3 END AS shard_id,
 CASE WHEN d.doc_id % 31 = 0 AND n.node_id = 1 THEN d.text || '!' ELSE d.text END AS content
FROM documents d CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2)) AS v(node_id)) n
WHERE ((n.node_id - d.doc_id % 3 + 3) % 3 < 2 AND (d.doc_id + n.node_id) % 17 <> 0) OR ((n.node_id - d.doc_id % 3 + 3) % 3 = 2 AND d.doc_id % 29 = 0)""",
    # what each replica answered to a write
    "replica_results": """SELECT event_id AS op_id, r AS replica_rank, (event_id + r) % 5 <> 0 AS ok, event_id % 40 + 1 AS terms_indexed,
 CASE WHEN (event_id + r) % 5 = 0 THEN 'node ' || r || ' failed' ELSE '' END AS message FROM events CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2)) AS v(r)) x""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _used(sql: str) -> set[str]:
    return set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) & set(TABLES)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a stored table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for table in _used(sql):
        view(spark, sf_dir, table).createOrReplaceTempView(f"quern_in_{table}")
        sql = re.sub(rf"((?:FROM|JOIN)\s+){table}\b", rf"\1quern_in_{table}", sql)
    return spark.sql(sql)


def with_views(names: str, body: str, **ctes: str) -> str:
    """Oracle SQL: body under the named views and further common table expressions."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names.split() if n in VIEWS] + [f"{n} AS ({s})" for n, s in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
