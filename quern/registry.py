"""Registered queries over the stored tables and the oracle SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import audit as D
from .operators import bitmaps as BM
from .operators import blocks as B
from .operators import index as I
from .operators import mutations as M
from .operators import outbox as O  # noqa: E741
from .operators import search as S
from .operators import telemetry as T
from .plans.storage import stored
from .plans.views import view, with_views

_QUERIES: dict = {}
_ORACLE: dict[str, str] = {}


def query(name: str, views: str, body: str | None = None, **ctes: str):
    """Register fn(*views) under a name, with oracle SQL over the same views."""

    def register(fn):
        names = views.split()
        _QUERIES[name] = lambda spark, sf_dir: fn(*[view(spark, sf_dir, n) for n in names])
        if body is not None:
            _ORACLE[name] = with_views(views, body, **ctes)
        return fn

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


TOK = "SELECT document_id, lower(t) AS term FROM (SELECT document_id, unnest(regexp_extract_all(content, '[A-Za-z0-9]+')) AS t FROM corpus)"
POST = "SELECT term, document_id, count(*) AS tf FROM tok GROUP BY ALL"
POSTINGS = {"tok": TOK, "postings": POST}
DFN = {"df": "SELECT term, count(*) AS df FROM postings GROUP BY term", "n": "SELECT count(*) AS n FROM corpus"}
BLANK = "NOT regexp_matches(content, '[^ \\t\\n\\r]')"
TRIM = "regexp_replace(query, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"



def _quoted(text: str) -> str:
    """The inside of a SQL string."""
    return text.replace("'", "''")


# --- sources and text -------------------------------------------------------------------


@query("documents_snapshot", "corpus", "SELECT document_id, content FROM corpus")
def _(corpus):
    return corpus.select("document_id", "content")


@query("tokenize", "corpus", "SELECT document_id, len(t) AS n_tokens, array_to_string(list_transform(t, lambda x: lower(x)), ' ') AS tokens FROM (SELECT document_id, regexp_extract_all(content, '[A-Za-z0-9]+') AS t FROM corpus)")
def _(corpus):
    t = X.tokens(F.col("content"))
    return corpus.select("document_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("distinct_terms", "corpus", "SELECT c.document_id, coalesce(string_agg(DISTINCT term, ' ' ORDER BY term), '') AS terms FROM corpus c LEFT JOIN tok USING (document_id) GROUP BY 1", tok=TOK)
def _(corpus):
    return corpus.select("document_id", F.array_join(X.distinct_terms(F.col("content")), " ").alias("terms"))


@query("terms_indexed", "corpus", "SELECT c.document_id, count(DISTINCT term) AS terms_indexed FROM corpus c LEFT JOIN tok USING (document_id) GROUP BY 1", tok=TOK)
def _(corpus):
    return corpus.select("document_id", X.terms_indexed(F.col("content")).alias("terms_indexed"))


@query("trim_query", "requests", f"SELECT query_id, {TRIM} AS trimmed FROM requests")
def _(requests):
    return requests.select("query_id", X.trim_query(F.col("query")).alias("trimmed"))


@query("blank_content", "requests", f"SELECT query_id, {BLANK.replace('content', 'query')} AS blank FROM requests")
def _(requests):
    return requests.select("query_id", X.blank(F.col("query")).alias("blank"))


@query(
    "validate_search_requests",
    "requests",
    f"SELECT query_id, e <> '' AS is_error, e AS error_message FROM (SELECT query_id, CASE WHEN mode NOT IN ('', 'and', 'or') THEN '{_quoted(X.MSG_MODE)}' WHEN lim NOT BETWEEN 1 AND 100 THEN '{X.MSG_LIMIT}' WHEN {TRIM} = '' THEN '{X.MSG_REQUEST}' ELSE '' END AS e FROM requests)",
)
def _(requests):
    e = F.coalesce(X.request_error(F.col("query"), F.col("mode"), F.col("lim")), F.lit(""))
    return requests.select("query_id", (e != "").alias("is_error"), e.alias("error_message"))


@query(
    "validate_ingest_payloads",
    "mutation_log",
    f"""SELECT log_offset, CASE WHEN b IS NULL THEN '{X.MSG_JSON}' WHEN NOT coalesce(json_type(b, '$.id') = 'UBIGINT' AND CAST(b ->> '$.id' AS HUGEINT) <= {X.MAX_ID}, false) THEN '{_quoted(X.MSG_ID)}'
      WHEN coalesce(json_type(b, '$.content') <> 'VARCHAR', true) THEN '{_quoted(X.MSG_CONTENT)}' ELSE '' END AS reject_reason FROM bodies""",
    bodies="SELECT log_offset, CASE WHEN json_valid(t) THEN t END AS b FROM (SELECT log_offset, replace(replace(payload, 'document_id', 'id'), 'document_content', 'content') AS t FROM mutation_log)",
)
def _(log):
    body = F.regexp_replace(F.regexp_replace("payload", "document_id", "id"), "document_content", "content")
    return log.select("log_offset", F.coalesce(X.ingest_error(body), F.lit("")).alias("reject_reason"))


EVENT_CHAIN = {
    "j": "SELECT log_offset AS rid, topic, payload, CASE WHEN json_valid(payload) THEN payload END AS p FROM mutation_log",
    "e": "SELECT rid, topic, CAST(p ->> '$.event_id' AS BIGINT) AS event_id, p ->> '$.event_type' AS event_type, CAST(p ->> '$.document_id' AS BIGINT) AS document_id, CAST(p ->> '$.shard_id' AS BIGINT) AS shard_id, coalesce(CAST(p ->> '$.source_node_id' AS BIGINT), 0) AS source_node_id, coalesce(p ->> '$.document_content', '') AS content FROM j",
}


@query("decode_mutation_event", "mutation_log", "SELECT rid, event_id, event_type, document_id, shard_id, source_node_id, content, (event_id IS NULL OR document_id IS NULL OR shard_id IS NULL) AS is_malformed FROM e", **EVENT_CHAIN)
def _(log):
    e = log.select(F.col("log_offset").alias("rid"), X.decode_event(F.col("payload")).alias("e"))
    bad = F.col("e.event_id").isNull() | F.col("e.document_id").isNull() | F.col("e.shard_id").isNull()
    return e.select("rid", "e.event_id", "e.event_type", "e.document_id", "e.shard_id", F.coalesce("e.source_node_id", F.lit(0)).alias("source_node_id"), F.coalesce("e.document_content", F.lit("")).alias("content"), bad.alias("is_malformed"))


@query(
    "encode_mutation_event",
    "corpus",
    "SELECT document_id, '{\"event_id\":' || document_id || ',\"event_type\":\"' || CASE WHEN document_id % 4 = 0 THEN 'document_removed' ELSE 'document_indexed' END || '\",\"document_id\":' || document_id || ',\"shard_id\":' || shard_id || ',\"source_node_id\":0' || CASE WHEN document_id % 4 = 0 THEN '' ELSE ',\"document_content\":' || CAST(to_json(content) AS VARCHAR) END || '}' AS payload FROM corpus",
)
def _(corpus):
    gone = F.col("document_id") % 4 == 0
    content = F.when(~gone, F.col("content"))
    kind = F.when(gone, "document_removed").otherwise("document_indexed")
    return corpus.select("document_id", X.encode_event(F.col("document_id"), kind, F.col("document_id"), F.col("shard_id"), F.lit(0), content).alias("payload"))


def _category_sql() -> str:
    parts = " ".join("WHEN " + " OR ".join(f"contains(error_message, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in X.CATEGORIES)
    return f"CASE {parts} ELSE 'Unknown' END"


@query(
    "failure_categories",
    "request_log",
    f"SELECT node_id, category, category IN {X.RETRYABLE} AS retryable, count(*) AS failures FROM (SELECT node_id, {_category_sql()} AS category FROM request_log WHERE NOT success) GROUP BY ALL",
)
def _(log):
    return T.failure_categories(log)


# --- index ------------------------------------------------------------------------------


@query("build_postings", "corpus", "SELECT * FROM postings", **POSTINGS)
def _(corpus):
    return I.build_postings(corpus)


@query("postings_lists", "corpus", "SELECT term, string_agg(document_id || ':' || tf, ' ' ORDER BY document_id) AS postings FROM postings GROUP BY term", **POSTINGS)
def _(corpus):
    text = F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["document_id"].cast("string"), x["tf"].cast("string"))), " ")
    return I.postings_lists(I.build_postings(corpus)).select("term", text.alias("postings"))


@query("postings_lookup", "corpus", "SELECT * FROM postings WHERE term IN ('the', 'que', 'zzzqqq')", **POSTINGS)
def _(corpus):
    return I.postings_lookup(I.build_postings(corpus), "the", "que", "zzzqqq")


@query("document_frequency", "corpus", "SELECT * FROM df", **POSTINGS, **DFN)
def _(corpus):
    return I.document_frequency(I.build_postings(corpus))


@query("idf", "corpus", "SELECT term, df, round(ln(n / df), 6) AS idf FROM df, n", **POSTINGS, **DFN)
def _(corpus):
    return I.idf(I.build_postings(corpus), corpus).withColumn("idf", F.round("idf", 6))


@query("vocabulary", "corpus", "SELECT DISTINCT term FROM postings", **POSTINGS)
def _(corpus):
    return I.vocabulary(I.build_postings(corpus))


@query(
    "corpus_stats",
    "corpus",
    "SELECT (SELECT n FROM n) AS documents, (SELECT count(*) FROM tok) AS tokens, (SELECT count(*) FROM corpus WHERE document_id NOT IN (SELECT document_id FROM tok)) AS empty_documents, (SELECT count(*) FROM df) AS terms",
    **POSTINGS,
    **DFN,
)
def _(corpus):
    return I.corpus_stats(corpus)


@query("forward_index", "corpus", "SELECT document_id, string_agg(term, ' ' ORDER BY term) AS terms FROM postings GROUP BY 1", **POSTINGS)
def _(corpus):
    return I.forward_index(I.build_postings(corpus)).withColumn("terms", F.array_join("terms", " "))


@query("remove_from_index", "corpus", "SELECT * FROM postings WHERE document_id % 5 <> 0", **POSTINGS)
def _(corpus):
    return I.remove_from_index(I.build_postings(corpus), corpus.where("document_id % 5 = 0"))


CHANGED = {"changed": "SELECT document_id, content || ' ' || source || ' again' AS content FROM corpus WHERE document_id % 5 = 0"}
NEWTOK = {"ntok": TOK.replace("corpus", "changed")}


@query("update_index", "corpus", "SELECT * FROM postings WHERE document_id % 5 <> 0 UNION ALL SELECT term, document_id, count(*) FROM ntok GROUP BY ALL", **POSTINGS, **CHANGED, **NEWTOK)
def _(corpus):
    changed = corpus.where("document_id % 5 = 0").select("document_id", F.concat("content", F.lit(" "), "source", F.lit(" again")).alias("content"))
    return I.update_index(I.build_postings(corpus), changed)


@query("tfidf_weights", "corpus", "SELECT term, document_id, round(tf * ln(n / df), 6) AS weight FROM postings JOIN df USING (term), n", **POSTINGS, **DFN)
def _(corpus):
    return I.tfidf_weights(I.build_postings(corpus), corpus).withColumn("weight", F.round("weight", 6))


# --- retrieval --------------------------------------------------------------------------


@query("postings_intersect", "corpus", "SELECT document_id FROM postings WHERE term = 'the' INTERSECT SELECT document_id FROM postings WHERE term = 'and'", **POSTINGS)
def _(corpus):
    return S.intersect(I.build_postings(corpus), "the", "and")


@query("postings_union", "corpus", "SELECT document_id FROM postings WHERE term = 'que' UNION SELECT document_id FROM postings WHERE term = 'die'", **POSTINGS)
def _(corpus):
    return S.union(I.build_postings(corpus), "que", "die")


@query("and_query", "corpus", "SELECT document_id FROM postings WHERE term IN ('and', 'in', 'the') GROUP BY 1 HAVING count(*) = 3", **POSTINGS)
def _(corpus):
    return S.boolean_query(I.build_postings(corpus), "The in, and the", "and")


@query("or_query", "corpus", "SELECT DISTINCT document_id FROM postings WHERE term IN ('que', 'license', 'zzzqqq')", **POSTINGS)
def _(corpus):
    return S.boolean_query(I.build_postings(corpus), "que license zzzqqq", "or")


def _ranked(terms: list[str], mode: str, limit: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    total = " + ".join(f"coalesce(max(CASE WHEN term = '{t}' THEN tf * ln(n / df) END), 0)" for t in terms)
    having = f" HAVING count(*) = {len(terms)}" if mode == "and" else ""
    return f"SELECT document_id, round(score, 6) AS score FROM (SELECT document_id, {total} AS score FROM postings JOIN df USING (term), n WHERE term IN ({listed}) GROUP BY 1{having}) ORDER BY score DESC, document_id{limit}"


@query("ranked_and", "corpus", _ranked(["and", "the"], "and"), **POSTINGS, **DFN)
def _(corpus):
    return S.search(corpus, "the and", "and", None).withColumn("score", F.round("score", 6))


@query("ranked_or", "corpus", _ranked(["and", "die", "the"], "or"), **POSTINGS, **DFN)
def _(corpus):
    return S.search(corpus, "and die the", "or", None).withColumn("score", F.round("score", 6))


@query("search", "corpus", f"SELECT document_id, round(s, 6) AS score FROM ({_ranked(['and', 'die', 'the'], 'or', ' LIMIT 10').replace('round(score, 6) AS score', 'score AS s')})", **POSTINGS, **DFN)
def _(corpus):
    return S.search(corpus, "and die the", "or", 10).withColumn("score", F.round("score", 6))


BATCH = {
    "qt": "SELECT query_id, mode, lim, len(list_distinct(t)) AS n_terms, unnest(list_distinct(t)) AS term FROM (SELECT *, list_transform(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM query_batch WHERE lim >= 1 AND mode IN ('and', 'or'))",
    "scored": "SELECT query_id, document_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(tf * ln(n / df) ORDER BY term)), lambda a, b: a + b) AS score, any_value(lim) AS lim FROM qt JOIN postings USING (term) JOIN df USING (term), n GROUP BY query_id, document_id, mode, n_terms HAVING mode = 'or' OR count(*) = n_terms",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM scored",
}
HITS = "SELECT query_id, rank, document_id, round(score, 6) AS score FROM ranked WHERE rank <= lim"


@query("search_batch", "query_batch corpus", HITS, **POSTINGS, **DFN, **BATCH)
def _(requests, corpus):
    return S.search_batch(requests, S.asked_postings(requests, corpus), I.corpus_size(corpus)).withColumn("score", F.round("score", 6))


@query(
    "search_totals",
    "query_batch corpus",
    f"SELECT q.query_id, CAST(coalesce(t.total, 0) AS BIGINT) AS total, m OR e AS is_error, CASE WHEN m THEN '{_quoted(X.MSG_MODE)}' WHEN e THEN '{X.MSG_REQUEST}' ELSE '' END AS error_message, true AS complete FROM (SELECT *, mode NOT IN ('and', 'or') AS m, (lim < 1 OR {TRIM} = '') AS e FROM query_batch) q LEFT JOIN (SELECT query_id, count(*) AS total FROM scored GROUP BY 1) t USING (query_id)",
    **POSTINGS,
    **DFN,
    **BATCH,
)
def _(requests, corpus):
    return S.search_totals(requests, S.asked_postings(requests, corpus), I.corpus_size(corpus))


@query("sharded_search", "query_batch corpus", HITS, **POSTINGS, **DFN, **BATCH)
def _(requests, corpus):
    return S.sharded_search(requests, corpus).withColumn("score", F.round("score", 6))


HEALTH = {
    "pinned": "SELECT shard_id, min(replica_rank) FILTER (WHERE count_ok) AS rk, min_by(node_id, replica_rank) AS primary_node FROM shard_health GROUP BY 1",
    "counted": "SELECT shard_id FROM pinned WHERE rk IS NOT NULL",
    "searched": "SELECT p.shard_id FROM pinned p JOIN shard_health h ON h.shard_id = p.shard_id AND h.replica_rank = p.rk WHERE search_ok",
}
PARTIAL = {
    **HEALTH,
    "tok": TOK + " WHERE document_id IN (SELECT document_id FROM corpus WHERE shard_id IN (SELECT shard_id FROM searched))",
    "postings": POST,
    "df": DFN["df"],
    "n": "SELECT count(*) AS n FROM corpus WHERE shard_id IN (SELECT shard_id FROM counted)",
    **BATCH,
}


@query("partial_availability_search", "query_batch corpus shard_health", HITS.replace(" FROM ranked", ", (SELECT count(*) FROM searched) = (SELECT count(DISTINCT shard_id) FROM shard_health) AS complete FROM ranked"), **PARTIAL)
def _(requests, corpus, health):
    return S.partial_search(requests, corpus, health).withColumn("score", F.round("score", 6))


@query(
    "search_failure_rows",
    "query_batch corpus shard_health",
    f"""SELECT query_id, primary_node AS node_id, shard_id, 'count_failure' AS category, '' AS term FROM (SELECT DISTINCT query_id FROM qv), pinned WHERE rk IS NULL
    UNION ALL SELECT query_id, primary_node, shard_id, 'search_failure', term FROM qv LEFT JOIN stop USING (query_id), pinned
      WHERE (stop IS NULL OR term <= stop) AND shard_id NOT IN (SELECT shard_id FROM searched) AND (SELECT n FROM n) > 0""",
    **PARTIAL,
    qv=f"SELECT qt.* FROM qt JOIN query_batch b USING (query_id) WHERE {TRIM} <> ''",
    stop="SELECT query_id, min(term) AS stop FROM qv WHERE mode = 'and' AND term NOT IN (SELECT term FROM df) GROUP BY 1",
)
def _(requests, corpus, health):
    return S.failure_rows(requests, corpus, health)


@query("get_document", "corpus write_batch", "SELECT w.document_id, c.document_id IS NOT NULL AS found, c.content FROM (SELECT DISTINCT document_id FROM write_batch) w LEFT JOIN corpus c USING (document_id)")
def _(corpus, batch):
    return S.get_documents(batch.select("document_id").distinct(), corpus)


@query("contains_documents", "corpus write_batch", "SELECT w.document_id, w.document_id IN (SELECT document_id FROM corpus) AS present FROM (SELECT DISTINCT document_id FROM write_batch) w")
def _(corpus, batch):
    return S.get_documents(batch.select("document_id").distinct(), corpus).select("document_id", F.col("found").alias("present"))


@query("total_document_count", "replica_inventory", "SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT shard_id, count(DISTINCT document_id) AS n FROM replica_inventory GROUP BY 1)")
def _(inventory):
    return S.total_document_count(inventory)


# --- mutations --------------------------------------------------------------------------

TERMS = "len(list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z0-9]+'), lambda x: lower(x))))"
INGEST = {
    "ops": f"SELECT *, {BLANK} AS b, document_id IN (SELECT document_id FROM corpus) AS held FROM write_batch",
    "nth": "SELECT *, row_number() OVER (PARTITION BY document_id, b ORDER BY seq) AS k FROM ops",
    "out": f"SELECT seq, document_id, content, CASE WHEN b THEN 'invalid' WHEN held OR k > 1 THEN 'conflict' ELSE 'created' END AS status, {TERMS} AS t FROM nth",
}


@query(
    "ingest_documents",
    "corpus write_batch",
    f"SELECT seq, document_id, status, CASE status WHEN 'invalid' THEN '{X.MSG_BLANK}' WHEN 'conflict' THEN 'Document with id ' || document_id || ' already exists' ELSE '' END AS message, CAST(CASE WHEN status = 'created' THEN t ELSE 0 END AS BIGINT) AS terms_indexed FROM out",
    **INGEST,
)
def _(corpus, batch):
    return M.ingest_documents(batch, corpus).drop("content")


@query(
    "update_documents",
    "corpus write_batch",
    f"SELECT seq, document_id, status, CASE status WHEN 'invalid' THEN '{X.MSG_BLANK}' WHEN 'not_found' THEN 'Document with id ' || document_id || ' not found' ELSE '' END AS message, CAST(CASE WHEN status = 'updated' THEN t ELSE 0 END AS BIGINT) AS terms_indexed FROM (SELECT seq, document_id, CASE WHEN b THEN 'invalid' WHEN NOT held THEN 'not_found' ELSE 'updated' END AS status, {TERMS} AS t FROM ops)",
    ops=INGEST["ops"],
)
def _(corpus, batch):
    return M.update_documents(batch, corpus).drop("content")


@query(
    "updated_snapshot",
    "corpus write_batch",
    "SELECT document_id, coalesce(new, content) AS content FROM corpus LEFT JOIN (SELECT document_id, max_by(content, seq) AS new FROM ops WHERE NOT b AND held GROUP BY 1) USING (document_id)",
    ops=INGEST["ops"],
)
def _(corpus, batch):
    return M.updated_table(batch, corpus)


@query(
    "delete_documents",
    "corpus write_batch",
    "SELECT seq, document_id, status, CASE WHEN status = 'deleted' THEN '' ELSE 'Document with id ' || document_id || ' not found' END AS message FROM (SELECT seq, document_id, CASE WHEN document_id IN (SELECT document_id FROM corpus) AND row_number() OVER (PARTITION BY document_id ORDER BY seq) = 1 THEN 'deleted' ELSE 'not_found' END AS status FROM write_batch)",
)
def _(corpus, batch):
    return M.delete_documents(batch, corpus)


@query(
    "emit_mutation_events",
    "corpus write_batch",
    "SELECT event_id, document_id, '{\"event_id\":' || event_id || ',\"event_type\":\"document_indexed\",\"document_id\":' || document_id || ',\"shard_id\":' || document_id % 3 || ',\"source_node_id\":0,\"document_content\":' || CAST(to_json(content) AS VARCHAR) || '}' AS payload FROM (SELECT document_id, content, row_number() OVER (ORDER BY seq) AS event_id FROM out WHERE status = 'created')",
    **INGEST,
)
def _(corpus, batch):
    return M.emit_mutation_events(M.ingest_documents(batch, corpus))


@query(
    "replicated_write_outcome",
    "replica_results",
    "SELECT op_id, bool_and(ok) AS success, coalesce(min_by(message, replica_rank) FILTER (WHERE NOT ok), '') AS error_message, CAST(coalesce(max_by(terms_indexed, replica_rank) FILTER (WHERE ok AND (f IS NULL OR replica_rank < f)), 0) AS BIGINT) AS terms_indexed FROM (SELECT *, min(CASE WHEN NOT ok THEN replica_rank END) OVER (PARTITION BY op_id) AS f FROM replica_results) GROUP BY op_id",
)
def _(results):
    return M.replicated_write_outcome(results)


CLASS = {
    **EVENT_CHAIN,
    "cl": "SELECT *, CASE WHEN topic <> 'documents.mutations' THEN 'skipped' WHEN event_type IS NULL THEN 'malformed' WHEN event_type NOT IN ('document_indexed', 'document_updated', 'document_removed') THEN 'skipped' WHEN event_id IS NULL OR document_id IS NULL OR shard_id IS NULL THEN 'malformed' WHEN source_node_id = 0 THEN 'self_skipped' WHEN shard_id NOT IN (0, 1) THEN 'skipped' ELSE 'candidate' END AS class FROM e",
}
FOLD = {
    **CLASS,
    "ev": f"SELECT rid, event_id, document_id, event_type, content, {BLANK} AS b, row_number() OVER (PARTITION BY document_id ORDER BY rid) AS k FROM cl WHERE class = 'candidate'",
    "st": """SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS rid, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS outcome FROM ev
    UNION ALL SELECT e.document_id, e.k, e.rid, e.event_id, e.event_type,
      CASE e.event_type WHEN 'document_removed' THEN NULL WHEN 'document_indexed' THEN CASE WHEN s.state IS NULL AND NOT e.b THEN e.content ELSE s.state END ELSE CASE WHEN s.state IS NULL OR e.b THEN s.state ELSE e.content END END,
      CASE e.event_type WHEN 'document_removed' THEN CASE WHEN s.state IS NULL THEN 'Skipped' ELSE 'Applied' END
        WHEN 'document_indexed' THEN CASE WHEN s.state IS NULL THEN CASE WHEN e.b THEN 'Failed' ELSE 'Applied' END WHEN s.state = e.content THEN 'Skipped' ELSE 'Failed' END
        ELSE CASE WHEN s.state IS NULL THEN 'Failed' WHEN s.state = e.content THEN 'Skipped' WHEN e.b THEN 'Failed' ELSE 'Applied' END END
    FROM st s JOIN ev e ON e.document_id = s.document_id AND e.k = s.k + 1""",
}


def _recursive(name: str) -> None:
    _ORACLE[name] = _ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)


@query("classify_mutation_events", "mutation_log", "SELECT rid, class FROM cl", **CLASS)
def _(log):
    return M.classify_mutation_events(log).select(F.col("log_offset").alias("rid"), "class")


@query("apply_mutations", "mutation_log", "SELECT rid AS log_offset, event_id, document_id, event_type, outcome, state AS content_after FROM st WHERE k > 0", **FOLD)
def _(log):
    return M.apply_mutations(M.candidates(log))


@query("materialize_documents", "mutation_log", "SELECT document_id, state AS content FROM (SELECT document_id, arg_max(state IS NULL, k) AS gone, max_by(coalesce(state, ''), k) AS state FROM st GROUP BY 1) WHERE NOT gone", **FOLD)
def _(log):
    return M.materialize_documents(M.candidates(log))


@query(
    "apply_stats",
    "mutation_log",
    """SELECT * FROM (SELECT count(*) AS received, count(*) FILTER (WHERE class = 'self_skipped') AS self_skipped, count(*) FILTER (WHERE class = 'malformed') AS malformed FROM cl WHERE topic = 'documents.mutations'),
    (SELECT count(*) FILTER (WHERE outcome = 'Applied') AS processed, count(*) FILTER (WHERE outcome = 'Failed') AS failed,
       count(*) FILTER (WHERE outcome = 'Skipped') + (SELECT count(*) FROM cl WHERE topic = 'documents.mutations' AND class IN ('skipped', 'self_skipped')) AS skipped,
       count(*) FILTER (WHERE outcome = 'Applied' AND event_type = 'document_indexed') AS index_operations, count(*) FILTER (WHERE outcome = 'Applied' AND event_type = 'document_updated') AS update_operations,
       count(*) FILTER (WHERE outcome = 'Applied' AND event_type = 'document_removed') AS remove_operations FROM st)""",
    **FOLD,
)
def _(log):
    return M.apply_stats(log)


for _name in ("apply_mutations", "materialize_documents", "apply_stats"):
    _recursive(_name)


@query("latest_state_from_log", "mutation_log", "SELECT document_id, content FROM (SELECT document_id, arg_max(event_type, rid) AS t, arg_max(content, rid) AS content FROM cl WHERE class = 'candidate' GROUP BY 1) WHERE t <> 'document_removed'", **CLASS)
def _(log):
    return M.latest_state(M.candidates(log))


# --- outbox and delivery ----------------------------------------------------------------

_ORACLE["outbox_replay_transitions"] = with_views(
    "outbox_log",
    "SELECT outbox_id, arg_max(status, k) AS status, arg_max(attempts, k) AS attempt_count, arg_max(retried, k) AS retried FROM st GROUP BY 1",
    o="SELECT outbox_id, action, row_number() OVER (PARTITION BY outbox_id ORDER BY seq) AS k FROM outbox_log",
    st="""SELECT DISTINCT outbox_id, CAST(0 AS BIGINT) AS k, 'PENDING' AS status, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS retried FROM o
    UNION ALL SELECT o.outbox_id, o.k,
      CASE WHEN action = 'mark_dispatching' AND status = 'PENDING' THEN 'DISPATCHING' WHEN action = 'mark_published' AND status = 'DISPATCHING' THEN 'PUBLISHED' WHEN action = 'mark_failed' AND status = 'DISPATCHING' THEN 'FAILED' WHEN action = 'requeue' AND status = 'FAILED' THEN 'PENDING' ELSE status END,
      attempts + CASE WHEN action = 'record_attempt' THEN 1 ELSE 0 END, retried + CASE WHEN action = 'requeue' AND status = 'FAILED' THEN 1 ELSE 0 END
    FROM st s JOIN o ON o.outbox_id = s.outbox_id AND o.k = s.k + 1""",
)
_recursive("outbox_replay_transitions")


@query("outbox_replay_transitions", "outbox_log")
def _(log):
    return O.replay_transitions(log)


@query("outbox_by_status", "outbox", "SELECT * FROM outbox WHERE status = 'FAILED'")
def _(outbox):
    return O.by_status(outbox, "FAILED")


@query("outbox_by_topic", "outbox", "SELECT * FROM outbox WHERE topic = 'documents.mutations' AND status = 'PENDING'")
def _(outbox):
    return O.by_topic(outbox, "documents.mutations", "PENDING")


@query(
    "outbox_stats",
    "outbox",
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'DISPATCHING') AS dispatching, count(*) FILTER (WHERE status = 'PUBLISHED') AS published, count(*) FILTER (WHERE status = 'FAILED') AS failed, CAST(sum(greatest(attempt_count - 1, 0)) AS BIGINT) AS retried FROM outbox",
)
def _(outbox):
    return O.stats(outbox)


@query("outbox_recover", "outbox", "SELECT * REPLACE (CASE WHEN status = 'DISPATCHING' THEN 'PENDING' ELSE status END AS status), (SELECT greatest(17, max(id) + 1) FROM outbox) AS next_id FROM outbox")
def _(outbox):
    return O.recover(outbox).crossJoin(F.broadcast(O.next_id(outbox, 17)))  # one row


@query("outbox_replay_failed", "outbox", "SELECT id, topic, doc_key, 'PENDING' AS status, attempt_count FROM outbox WHERE status = 'FAILED'")
def _(outbox):
    return O.replay_failed(outbox)[1]


ATT = {"a": "SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS k FROM attempt_log"}


@query(
    "dispatch_outcome",
    "attempt_log",
    "SELECT message_id, CASE WHEN h IS NOT NULL THEN 'PUBLISHED' WHEN n >= 4 THEN 'FAILED' ELSE 'PENDING' END AS status, coalesce(h, n) AS attempts, coalesce(h, n) - 1 AS retried, coalesce(h, n) - CASE WHEN h IS NULL THEN 0 ELSE 1 END AS broker_errors, CASE WHEN h IS NULL AND n >= 4 THEN 'broker rejected' ELSE '' END AS error_message FROM (SELECT message_id, min(k) FILTER (WHERE ok) AS h, count(*) AS n FROM a WHERE k <= 4 GROUP BY 1)",
    **ATT,
)
def _(log):
    return O.dispatch_outcome(log)


@query("dedup_messages", "attempt_log", "SELECT message_id, seq, topic, ok FROM a WHERE k = 1", **ATT)
def _(log):
    return O.dedup_messages(log)


@query("dead_letters", "attempt_log", "SELECT message_id, topic, count(*) AS attempts FROM a WHERE k <= 3 GROUP BY ALL HAVING count(*) >= 3 AND NOT bool_or(ok)", **ATT)
def _(log):
    return O.dead_letters(log)


@query("assign_offsets", "attempt_log", 'SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS log_offset FROM attempt_log')
def _(log):
    return O.assign_offsets(log)


@query(
    "broker_stats",
    "attempt_log",
    "SELECT topic, count(*) AS published, CAST(sum(coalesce(h, n)) AS BIGINT) AS delivered, count(h) AS acknowledged, CAST(sum(coalesce(h, n) - 1) AS BIGINT) AS retried, count(*) FILTER (WHERE h IS NULL AND n >= 3) AS dead_lettered, count(*) FILTER (WHERE h IS NULL AND n < 3) AS depth FROM (SELECT topic, message_id, min(k) FILTER (WHERE ok) AS h, count(*) AS n FROM a WHERE k <= 3 GROUP BY ALL) GROUP BY 1",
    **ATT,
)
def _(log):
    return O.broker_stats(log)


@query("self_event_filter", "mutation_log", "SELECT node_id, e.event_id FROM e, (VALUES (0), (1), (2)) v(node_id) WHERE e.event_id IS NOT NULL AND e.source_node_id <> node_id", **EVENT_CHAIN)
def _(log):
    e = log.select(X.decode_event(F.col("payload")).alias("e")).where("e.event_id is not null")
    nodes = e.select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("node_id"), "e.event_id", F.coalesce("e.source_node_id", F.lit(0)).alias("s"))
    return nodes.where("s <> node_id").select("node_id", "event_id")


@query(
    "in_order_check",
    "mutation_log",
    "SELECT document_id, log_offset, event_id, previous FROM (SELECT document_id, rid AS log_offset, event_id, lag(event_id) OVER (PARTITION BY document_id ORDER BY rid) AS previous FROM e WHERE event_id IS NOT NULL AND document_id IS NOT NULL) WHERE event_id < previous",
    **EVENT_CHAIN,
)
def _(log):
    e = log.select("log_offset", X.decode_event(F.col("payload")).alias("e")).select("e.document_id", "log_offset", "e.event_id").where("event_id is not null and document_id is not null")
    return O.in_order_check(e, "document_id", "log_offset", "event_id")


# --- telemetry --------------------------------------------------------------------------

CNT = "count(*) FILTER (WHERE op = 'search') AS searches, count(*) FILTER (WHERE op = 'search' AND NOT success) AS search_errors, count(*) FILTER (WHERE op = 'search' AND NOT complete) AS search_incomplete, count(*) FILTER (WHERE op = 'write') AS writes, count(*) FILTER (WHERE op = 'write' AND NOT success) AS write_errors"
LAT = "round(quantile_cont(latency_ms, 0.5) FILTER (WHERE success), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (WHERE success), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99) FILTER (WHERE success), 6) AS p99_ms, round(avg(latency_ms) FILTER (WHERE success), 6) AS mean_ms"
SUM = f"count(*) AS requests, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS errors, {LAT}, round(CAST(count(*) AS DOUBLE) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE), 0), 9) AS throughput_rps"


@query("request_counters", "request_log", f"SELECT {CNT} FROM request_log")
def _(log):
    return T.request_counters(log)


@query("per_node_metrics", "request_log", f"SELECT node_id, {CNT}, count(*) FILTER (WHERE status_code = 503) AS retries FROM request_log GROUP BY 1")
def _(log):
    return T.per_node_metrics(log)


@query(
    "latency_last_n",
    "request_log",
    "SELECT round(avg(latency_ms), 6) AS avg_ms, max(CASE WHEN r = CAST(floor(CAST(0.99 AS DOUBLE) * (k - 1)) AS BIGINT) + 1 THEN latency_ms END) AS p99_ms, count(*) AS sample_count FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms, request_id) AS r, count(*) OVER () AS k FROM (SELECT * FROM request_log ORDER BY ts DESC, request_id DESC LIMIT 1000))",
)
def _(log):
    return T.latency_last_n(log)


@query(
    "breaker_transitions",
    "request_log",
    "SELECT node_id, count(*) FILTER (WHERE circuit_state = 'Open' AND b <> 'Open') AS open_events, count(*) FILTER (WHERE circuit_state <> 'Open' AND b = 'Open') AS close_events FROM (SELECT *, lag(circuit_state, 1, 'Closed') OVER (PARTITION BY node_id ORDER BY ts, request_id) AS b FROM request_log) GROUP BY 1",
)
def _(log):
    return T.breaker_transitions(log)


@query(
    "failure_trips",
    "request_log",
    "SELECT node_id, request_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY node_id, island ORDER BY ts, request_id) AS k FROM (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS island FROM request_log) WHERE NOT success) WHERE k = 5",
)
def _(log):
    return T.failure_trips(log)


@query("latency_percentiles", "request_log", f"SELECT op, min(latency_ms) AS min_ms, {LAT}, max(latency_ms) AS max_ms FROM request_log WHERE success GROUP BY op")
def _(log):
    return T.latency_percentiles(log, "op")


@query(
    "sketch_percentiles",
    "request_log",
    "SELECT node_id, count(*) AS samples, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, true AS p50_near, true AS p95_near, true AS p99_near FROM request_log WHERE success AND latency_ms IS NOT NULL GROUP BY 1",
)
def _(log):
    """Quantiles out of stored sketches, with the ranks of the log to hold them against: less than 1 % off."""
    found = T.sketch_percentiles(stored(T.latency_sketches(log), "latency-sketches"), ("node_id",))
    off = T.sketch_rank_errors(log, found, ("node_id",)).select("node_id", *[(F.col(m) < 0.01).alias(m.replace("_ms", "_near")) for m in T.PERCENTILES])
    return found.join(off, "node_id").select("node_id", "samples", "min_ms", "max_ms", "p50_near", "p95_near", "p99_near")


@query("run_summary", "request_log", f"SELECT rf, concurrency, {SUM} FROM request_log GROUP BY 1, 2")
def _(log):
    return T.run_summary(log)


@query("mixed_workload_breakdown", "request_log", f"SELECT concurrency, op, {SUM} FROM request_log GROUP BY GROUPING SETS ((concurrency), (concurrency, op))")
def _(log):
    return T.mixed_workload_breakdown(log)


def _over(c: str, name: str, sign: str = "") -> str:
    return f"CASE WHEN r.rf = 1 THEN CAST(0 AS DOUBLE) WHEN b.{c} > 0 THEN round({sign}1.0::DOUBLE * (r.{c} - b.{c}) / b.{c} * 100.0::DOUBLE, 4) END AS {name}"


@query(
    "replication_overhead",
    "request_log",
    f"SELECT r.rf, r.concurrency, r.requests, r.successful, r.errors, {_over('p50_ms', 'p50_overhead_percent')}, {_over('p95_ms', 'p95_overhead_percent')}, {_over('p99_ms', 'p99_overhead_percent')}, {_over('throughput_rps', 'throughput_impact_percent', '-')} FROM runs r LEFT JOIN (SELECT * FROM runs WHERE rf = 1) b ON b.concurrency = r.concurrency WHERE r.rf IN (1, 3)",
    runs=f"SELECT rf, concurrency, {SUM} FROM request_log GROUP BY 1, 2",
)
def _(log):
    return T.replication_overhead(log)


@query(
    "load_shed_report",
    "request_log",
    "SELECT concurrency, count(*) AS total_requests, count(*) FILTER (WHERE success) AS accepted, count(*) FILTER (WHERE status_code = 429) AS rejected_429, count(*) FILTER (WHERE NOT success AND status_code <> 429) AS other_errors, round(CAST(count(*) FILTER (WHERE status_code = 429) AS DOUBLE) / count(*) * CAST(100 AS DOUBLE), 2) AS rejected_percent, round(median(latency_ms) FILTER (WHERE success), 6) AS accepted_p50_ms, max(latency_ms) FILTER (WHERE success AND r = CAST(floor(CAST(0.95 AS DOUBLE) * (k - 1)) AS BIGINT) + 1) AS accepted_p95_ms, max(latency_ms) FILTER (WHERE success AND r = CAST(floor(CAST(0.99 AS DOUBLE) * (k - 1)) AS BIGINT) + 1) AS accepted_p99_ms FROM (SELECT *, row_number() OVER (PARTITION BY concurrency, success ORDER BY latency_ms, request_id) AS r, count(*) OVER (PARTITION BY concurrency, success) AS k FROM request_log) GROUP BY 1",
)
def _(log):
    return T.load_shed_report(log)


@query(
    "metric_deltas",
    "request_log",
    "SELECT metric, a - b AS delta FROM (UNPIVOT (SELECT " + CNT + " FROM request_log WHERE request_id % 2 = 0) ON COLUMNS(*) INTO NAME metric VALUE b) JOIN (UNPIVOT (SELECT " + CNT + " FROM request_log) ON COLUMNS(*) INTO NAME metric VALUE a) USING (metric)",
)
def _(log):
    return T.metric_deltas(T.request_counters(log.where("request_id % 2 = 0")), T.request_counters(log))


FAILED = "op = 'write' AND NOT success"


@query(
    "recovery_check",
    "request_log",
    f"SELECT *, recovery_failed = 0 AS recovered, final_failed = baseline_failed + outage_failed AS consistent FROM (SELECT count(*) FILTER (WHERE {FAILED} AND request_id < 2000) AS baseline_failed, count(*) FILTER (WHERE {FAILED} AND request_id >= 2000 AND request_id < 8000) AS outage_failed, count(*) FILTER (WHERE {FAILED} AND request_id >= 8000) AS recovery_failed, count(*) FILTER (WHERE {FAILED}) AS final_failed FROM request_log)",
)
def _(log):
    return T.recovery_check(log, 2000, 8000)


@query(
    "read_failovers",
    "request_log",
    "SELECT shard_id, count(*) AS reads, count(*) FILTER (WHERE r > 0) AS failovers FROM (SELECT request_id % 3 AS shard_id, (node_id - request_id % 3 + 3) % 3 AS r FROM request_log WHERE op = 'search') WHERE r < 2 GROUP BY 1",
)
def _(log):
    served = log.withColumn("shard_id", F.col("request_id") % 3)
    return T.read_failovers(served, D.replica_placement(served.select("shard_id").distinct()))


@query(
    "interval_samples",
    "request_log",
    """SELECT s.interval, requests, CAST(sum(a) OVER w AS BIGINT) AS cumulative_accepted, CAST(sum(r) OVER w AS BIGINT) AS cumulative_rejected, CAST(sum(e) OVER w AS BIGINT) AS cumulative_errors,
      round(CASE WHEN len(l) > 0 THEN list_median(l) ELSE 0 END, 6) AS recent_p50_ms,
      round(CASE WHEN len(l) >= 10 THEN list_sort(l)[CAST(floor(CAST(0.99 AS DOUBLE) * (len(l) - 1)) AS BIGINT) + 1] WHEN len(l) > 0 THEN list_median(l) ELSE 0 END, 6) AS recent_p99_ms
    FROM s JOIN ends USING (interval) WINDOW w AS (ORDER BY s.interval ROWS UNBOUNDED PRECEDING)""",
    t="SELECT *, epoch_us(ts) // 10000000 AS interval FROM request_log",
    s="SELECT interval, count(*) AS requests, count(*) FILTER (WHERE success) AS a, count(*) FILTER (WHERE status_code = 429) AS r, count(*) FILTER (WHERE NOT success AND status_code <> 429) AS e FROM t GROUP BY 1",
    m="SELECT interval, ts, request_id, list(CASE WHEN success THEN latency_ms END) OVER (ORDER BY ts, request_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS raw FROM t",
    ends="SELECT interval, list_filter(arg_max(raw, (ts, request_id)), lambda x: x IS NOT NULL) AS l FROM m GROUP BY 1",
)
def _(log):
    return T.interval_samples(log)


# --- lag, placement and audits ----------------------------------------------------------

LAG = {"l": "SELECT *, CASE WHEN query_failed OR log_end_offset IS NULL THEN NULL ELSE greatest(0, log_end_offset - coalesce(current_offset, 0)) END AS lag FROM lag_samples"}
STRICT = "CASE WHEN bool_or(lag IS NULL) THEN NULL ELSE CAST({}(lag) AS BIGINT) END AS lag"
TOTAL = {**LAG, "tot": f"SELECT sample_index, phase, {STRICT.format('sum')}, bool_or(lag IS NULL) AS failed FROM l GROUP BY 1, 2"}


@query("partition_lag", "lag_samples", "SELECT *, lag IS NULL AS failed FROM l", **LAG)
def _(samples):
    return D.partition_lag(samples)


@query("group_lag", "lag_samples", f"SELECT sample_index, phase, consumer_group, {STRICT.format('sum')} FROM l GROUP BY 1, 2, 3", **LAG)
def _(samples):
    return D.group_lag(D.partition_lag(samples))


@query("max_partition_lag", "lag_samples", f"SELECT sample_index, phase, part, {STRICT.format('max')} FROM l GROUP BY 1, 2, 3", **LAG)
def _(samples):
    return D.max_partition_lag(D.partition_lag(samples))


@query("total_lag", "lag_samples", "SELECT * FROM tot", **TOTAL)
def _(samples):
    return D.total_lag(D.partition_lag(samples))


@query(
    "lag_summary",
    "lag_samples",
    """SELECT consumer_group, round(avg(lag) FILTER (WHERE NOT failed AND phase IN ('workload', 'workload_end')), 2) AS mean_lag, max(lag) FILTER (WHERE NOT failed) AS max_lag, arg_max(lag, sample_index) FILTER (WHERE NOT failed AND phase = 'drain') AS final_lag,
      count(*) FILTER (WHERE failed) AS failed_samples, CASE WHEN coalesce(arg_max(total, sample_index) FILTER (WHERE NOT failed AND phase = 'drain'), 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM g JOIN (SELECT sample_index, lag AS total, failed FROM tot) USING (sample_index) GROUP BY 1""",
    **TOTAL,
    g=f"SELECT sample_index, phase, consumer_group, {STRICT.format('sum')} FROM l GROUP BY 1, 2, 3",
)
def _(samples):
    return D.lag_summary(D.partition_lag(samples))


@query(
    "drain_time",
    "lag_samples",
    "SELECT drain_start, drained_at, drained_at - drain_start AS took, (drained_at IS NULL OR drained_at - drain_start > 15) AS timed_out FROM (SELECT min(sample_index) AS drain_start, min(sample_index) FILTER (WHERE lag = 0) AS drained_at FROM tot WHERE phase = 'drain')",
    **TOTAL,
)
def _(samples):
    return D.drain_time(D.partition_lag(samples))


@query(
    "final_lag_verdict",
    "lag_samples",
    "SELECT sample_index, coalesce(NOT failed AND lag = 0, false) AS passed, CASE WHEN failed THEN 'query failed' WHEN lag IS NULL THEN 'unknown' WHEN lag <> 0 THEN 'remaining lag = ' || lag ELSE 'reached zero' END AS message FROM tot",
    **TOTAL,
)
def _(samples):
    return D.final_lag_verdict(D.partition_lag(samples))


@query("consumer_lag", "lag_samples", "SELECT sample_index, consumer_group, CAST(sum(greatest(0, log_end_offset - coalesce(current_offset, log_start_offset))) AS BIGINT) AS lag FROM lag_samples GROUP BY 1, 2")
def _(samples):
    return D.consumer_lag(samples)


@query(
    "propagation_latency",
    "propagation_log",
    "SELECT document_id, round(CASE WHEN t_node1 IS NOT NULL THEN greatest(0, t_node1 - t_write_done) END, 6) AS node1, round(CASE WHEN t_node2 IS NOT NULL THEN greatest(0, t_node2 - t_write_done) END, 6) AS node2, round(CASE WHEN NOT t THEN greatest(0, greatest(t_node1, t_node2) - t_write_done) END, 6) AS both_nodes, round(CASE WHEN NOT t THEN greatest(0, greatest(t_node1, t_node2) - t_published) END, 6) AS from_publish, t AS timeout FROM (SELECT *, t_node1 IS NULL OR t_node2 IS NULL AS t FROM propagation_log)",
)
def _(log):
    return D.propagation_latency(log)


@query(
    "propagation_summary",
    "propagation_log",
    "SELECT count(*) AS mutations, count(*) FILTER (WHERE t IS NULL) AS timeouts, round(quantile_cont(t, 0.5), 6) AS p50, round(quantile_cont(t, 0.95), 6) AS p95, round(quantile_cont(t, 0.99), 6) AS p99, round(max(t), 6) AS most FROM (SELECT CASE WHEN t_node1 IS NOT NULL AND t_node2 IS NOT NULL THEN round(greatest(0, greatest(t_node1, t_node2) - t_write_done), 6) END AS t FROM propagation_log)",
)
def _(log):
    return D.propagation_summary(log)


@query("shard_routing", "corpus", "SELECT document_id % 5 AS shard_id, count(*) AS documents, round(count(*) * 5 / CAST((SELECT count(*) FROM corpus) AS DOUBLE), 6) AS skew FROM corpus GROUP BY 1")
def _(corpus):
    return D.shard_routing(corpus, 5)


@query("replica_placement", "corpus", "SELECT shard_id, CAST(r AS INTEGER) AS replica_rank, (shard_id + r) % 3 AS node_id FROM (SELECT DISTINCT shard_id FROM corpus), range(2) t(r)")
def _(corpus):
    return D.replica_placement(corpus.select("shard_id").distinct())


@query(
    "placement_violations",
    "replica_inventory",
    """SELECT 'node_out_of_range' AS rule, shard_id, node_id FROM pl WHERE node_id NOT BETWEEN 0 AND 2 UNION ALL SELECT DISTINCT 'shard_out_of_range', shard_id, CAST(NULL AS BIGINT) FROM pl WHERE shard_id NOT BETWEEN 0 AND 3
    UNION ALL SELECT 'replica_count', shard_id, NULL FROM pl GROUP BY shard_id HAVING count(*) <> 2 UNION ALL SELECT 'duplicate_node', shard_id, node_id FROM pl GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'shard_missing', CAST(s AS BIGINT), NULL FROM range(4) r(s) WHERE s NOT IN (SELECT shard_id FROM pl)""",
    pl="SELECT DISTINCT CAST(shard_id AS BIGINT) AS shard_id, CAST(node_id AS BIGINT) AS node_id FROM replica_inventory",
)
def _(inventory):
    return D.placement_violations(inventory.select("shard_id", "node_id").distinct(), shards=4)


@query("select_replica", "corpus shard_health", "SELECT c.shard_id, n AS documents, node_id, primary_node AS primary_node_id FROM (SELECT shard_id, count(*) AS n FROM corpus GROUP BY 1) c JOIN pinned p USING (shard_id) LEFT JOIN shard_health h ON h.shard_id = p.shard_id AND h.replica_rank = p.rk", pinned=HEALTH["pinned"])
def _(corpus, health):
    docs = corpus.groupBy("shard_id").agg(F.count(F.lit(1)).alias("documents"))
    return docs.join(S.select_replicas(health), "shard_id").select("shard_id", "documents", "node_id", "primary_node_id")


@query(
    "replica_audit",
    "corpus replica_inventory",
    "SELECT node_id, count(w) AS expected, count(*) FILTER (WHERE h IS NULL) AS missing, count(*) FILTER (WHERE w IS NULL) AS unexpected, CASE WHEN count(*) FILTER (WHERE h IS NULL OR w IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT document_id, (shard_id + r) % 3 AS node_id, 1 AS w FROM corpus, range(2) t(r)) FULL JOIN (SELECT document_id, CAST(node_id AS BIGINT) AS node_id, 1 AS h FROM replica_inventory) USING (document_id, node_id) GROUP BY 1",
)
def _(corpus, inventory):
    return D.replica_audit(corpus, inventory)


@query("replica_content_mismatch", "replica_inventory", "SELECT document_id, count(*) AS copies, count(DISTINCT content) AS contents FROM replica_inventory GROUP BY 1 HAVING count(DISTINCT content) > 1")
def _(inventory):
    return D.replica_content_mismatch(inventory)


# --- a stored index ---------------------------------------------------------------------


@query("index_search", "query_batch corpus", HITS, **POSTINGS, **DFN, **BATCH)
def _(requests, corpus):
    return B.search_blocks(requests, B.write_index(corpus))[0].withColumn("score", F.round("score", 6))


@query("index_weights", "corpus", "SELECT term, document_id, round(tf * ln(n / df), 6) AS weight FROM postings JOIN df USING (term), n", **POSTINGS, **DFN)
def _(corpus):
    return B.weights(B.write_index(corpus)).withColumn("weight", F.round("weight", 6))


@query("index_lookup", "corpus", "SELECT term, document_id, tf FROM postings WHERE term IN ('the', 'die', 'que', 'zzzqqq')", **POSTINGS)
def _(corpus):
    return B.read_postings(B.write_index(corpus), "the", "die", "que", "zzzqqq")


# --- writes of mixed kinds, in order ----------------------------------------------------

# the plain fold: one step for each further write of an id
MIXED = {
    "mo": f"SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY seq) AS BIGINT) AS k, (kind <> 'delete' AND {BLANK}) AS b, {TERMS} AS t FROM mixed_batch",
    "ids": "SELECT DISTINCT m.document_id, c.document_id IS NOT NULL AS held, c.content FROM mo m LEFT JOIN corpus c USING (document_id)",
    "fold": "SELECT document_id, CAST(0 AS BIGINT) AS k, held AS present, content, CAST(NULL AS BIGINT) AS seq, '' AS kind, '' AS status, CAST(0 AS BIGINT) AS t FROM ids "
    "UNION ALL SELECT f.document_id, o.k, CASE WHEN o.b THEN f.present WHEN o.kind = 'insert' THEN true WHEN o.kind = 'delete' THEN false ELSE f.present END, "
    "CASE WHEN NOT o.b AND ((o.kind = 'insert' AND NOT f.present) OR (o.kind = 'update' AND f.present)) THEN o.content ELSE f.content END, o.seq, o.kind, "
    "CASE WHEN o.b THEN 'invalid' WHEN o.kind = 'insert' THEN CASE WHEN f.present THEN 'conflict' ELSE 'created' END WHEN NOT f.present THEN 'not_found' WHEN o.kind = 'update' THEN 'updated' ELSE 'deleted' END, CAST(o.t AS BIGINT) "
    "FROM fold f JOIN mo o ON o.document_id = f.document_id AND o.k = f.k + 1",
}


def _recursive(name: str) -> None:
    _ORACLE[name] = _ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "mixed_writes",
    "corpus mixed_batch",
    f"SELECT seq, document_id, kind, status, CASE status WHEN 'invalid' THEN '{X.MSG_BLANK}' WHEN 'conflict' THEN 'Document with id ' || document_id || ' already exists' WHEN 'not_found' THEN 'Document with id ' || document_id || ' not found' ELSE '' END AS message, CASE WHEN status IN ('created', 'updated') THEN t ELSE 0 END AS terms_indexed FROM fold WHERE k > 0",
    **MIXED,
)
def _(corpus, batch):
    return M.mixed_writes(batch, corpus).drop("content")


@query(
    "mixed_snapshot",
    "corpus mixed_batch",
    "SELECT document_id, content FROM corpus WHERE document_id NOT IN (SELECT document_id FROM ids) UNION ALL SELECT document_id, content FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY k DESC) AS z FROM fold) WHERE z = 1 AND present",
    **MIXED,
)
def _(corpus, batch):
    return M.mixed_table(batch, corpus)


_recursive("mixed_writes")
_recursive("mixed_snapshot")

# --- replicas by digests, Boolean retrieval by bitmaps ----------------------------------


@query(
    "replica_differences",
    "corpus placed_inventory",
    "SELECT document_id, shard_id, node_id, CASE WHEN h IS NULL THEN 'missing' WHEN w IS NULL THEN 'unexpected' ELSE 'content' END AS difference FROM (SELECT document_id, shard_id, CAST((shard_id + r) % 3 AS BIGINT) AS node_id, content AS want, 1 AS w FROM corpus, range(2) t(r)) FULL JOIN (SELECT document_id, shard_id, CAST(node_id AS BIGINT) AS node_id, content AS have, 1 AS h FROM placed_inventory) USING (document_id, shard_id, node_id) WHERE h IS NULL OR w IS NULL OR want IS DISTINCT FROM have",
)
def _(corpus, inventory):
    return D.replica_differences(corpus, inventory)


@query(
    "ambiguous_placement",
    "corpus placed_inventory",
    "SELECT document_id, coalesce(k, 0) AS shards, CASE WHEN k IS NULL THEN 'not_found' ELSE 'ambiguous' END AS problem FROM (SELECT document_id FROM corpus UNION SELECT document_id FROM placed_inventory) LEFT JOIN (SELECT document_id, count(DISTINCT shard_id) AS k FROM placed_inventory WHERE node_id = shard_id % 3 GROUP BY 1) USING (document_id) WHERE k IS NULL OR k <> 1",
)
def _(corpus, inventory):
    return D.ambiguous_placement(corpus, inventory)


@query("bitmap_and", "corpus", "SELECT document_id FROM postings WHERE term IN ('and', 'in', 'the') GROUP BY 1 HAVING count(*) = 3", **POSTINGS)
def _(corpus):
    return BM.boolean_bitmaps(BM.build_bitmaps(I.build_postings(corpus)), "The in, and the", "and")


@query("bitmap_or", "corpus", "SELECT DISTINCT document_id FROM postings WHERE term IN ('que', 'license', 'zzzqqq')", **POSTINGS)
def _(corpus):
    return BM.boolean_bitmaps(BM.build_bitmaps(I.build_postings(corpus)), "que license zzzqqq", "or")


@query("bitmap_totals", "corpus", "SELECT count(DISTINCT document_id) AS total FROM postings WHERE term IN ('que', 'the')", **POSTINGS)
def _(corpus):
    return BM.count_matches(BM.build_bitmaps(I.build_postings(corpus)), "que the", "or")

# --- write log against observations -----------------------------------------------------

# the first observation at or after each write, by a plain join and minimum
SEEN = {
    "firsts": "SELECT w.write_id, w.document_id, any_value(epoch_us(w.t_write)) AS t, "
    + ", ".join(f"min(epoch_us(o.t_seen)) FILTER (WHERE o.node_id = {n}) AS s{n}" for n in (0, 1, 2))
    + " FROM write_log w LEFT JOIN observation_log o ON o.document_id = w.document_id AND o.content IS NOT DISTINCT FROM w.content AND o.t_seen >= w.t_write GROUP BY 1, 2",
    "pub": "SELECT *, CASE WHEN s0 <= t + 10000000 THEN s0 END AS p FROM firsts",
    "nod": "SELECT *, CASE WHEN s1 <= p + 10000000 THEN s1 END AS n1, CASE WHEN s2 <= p + 10000000 THEN s2 END AS n2 FROM pub",
    "vis": "SELECT write_id, document_id, p - t AS publish_us, n1 - t AS node1_us, n2 - t AS node2_us, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN greatest(n1, n2) - t END AS visible_us, "
    "CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN greatest(0, greatest(n1, n2) - p) END AS from_publish_us, "
    "CASE WHEN p IS NULL THEN 'not published' WHEN n1 IS NULL AND n2 IS NULL THEN 'missing on 1, 2' WHEN n1 IS NULL THEN 'missing on 1' WHEN n2 IS NULL THEN 'missing on 2' ELSE '' END AS error FROM nod",
}


@query("write_visibility", "write_log observation_log", "SELECT * FROM vis", **SEEN)
def _(writes, observations):
    return D.write_visibility(writes, observations)


@query(
    "write_visibility_summary",
    "write_log observation_log",
    "SELECT error, count(*) AS writes, max(visible_us) AS most_us, "
    + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 3) AS {name}_p{round(q * 100)}_us" for c, name in (("visible_us", "visible"), ("from_publish_us", "from_publish")) for q in (0.5, 0.95, 0.99))
    + " FROM vis GROUP BY 1",
    **SEEN,
)
def _(writes, observations):
    return D.visibility_summary(D.write_visibility(writes, observations))
