"""All registered queries with their DuckDB SQL. A query takes (spark, sf_dir); its name is its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ann, catalog, chunks, evaluation, graph, history, merkle, search, symbols, telemetry, trigrams, vectors
from ..sources import ingest, scratch, versions
from ..sources import tables as t
from ..streaming import changes, cumulative, keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NOW = "2024-01-31 00:00:00"

_FILES = """files AS (SELECT source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.' || ['py','ts','go','sql'][CAST(doc_id % 4 AS INT) + 1] AS path,
  text AS content, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents)"""
_LINES = _FILES + """, parts AS (SELECT path, string_split(content, chr(10)) AS p FROM files),
 numbered AS (SELECT path, p, unnest(range(1, len(p) + 1)) AS line FROM parts),
 lines AS (SELECT path, CAST(line AS INT) AS line, regexp_replace(p[line], '\\r$', '') AS text FROM numbered WHERE NOT (line = len(p) AND p[line] = ''))"""
_CLAMP = "substring(regexp_replace(text, '\\s+$', ''), 1, 200)"
_SYMBOLS = """symbols AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, ['function','class','method','constant','type'][CAST(p_partkey % 5 AS INT) + 1] AS kind,
  p_brand AS file, p_size AS line, p_type AS signature, string_split(p_name, ' ') AS keywords, sha256(p_name || '|' || p_type) AS content_hash FROM part)"""
_EDGES = """edges AS (SELECT DISTINCT l_suppkey AS source, l_partkey % (SELECT count(*) FROM supplier) AS target FROM lineitem
  WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier))"""
_LINKS = """links AS (SELECT 'page_' || CAST(page_id AS VARCHAR) AS source_file, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS specifier FROM pages)"""
_CALLS = """calls AS (SELECT ts AS captured_at, event_type AS tool_name, user_id AS session, abs(value) AS duration_ms,
  CAST(floor(abs(value)) AS BIGINT) AS request_tokens, CAST(floor(abs(value)) AS BIGINT) * 2 AS response_tokens, CAST(floor(abs(value)) AS BIGINT) * 3 AS total_tokens,
  CAST(floor(abs(value)) AS BIGINT) + 5 AS input_tokens_saved, CAST(event_id % 7 AS BIGINT) AS output_tokens_saved,
  CAST(floor(abs(value)) AS BIGINT) + 5 + CAST(event_id % 7 AS BIGINT) AS tokens_saved, event_id FROM events)"""


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- lexical search ------------------------------------------------------------------------------------------------


@_query(f"""WITH {_LINES} SELECT path, line, {_CLAMP} AS text, CAST(greatest((length(text) - length(replace(lower(text), 'the', ''))) / 3, 1) AS INT) AS score
  FROM lines WHERE contains(lower(text), 'the')""")
def search_text_lexical(spark, sf_dir):
    return search.matching_lines(t.lines(t.files(spark, sf_dir)), "the")


@_query(f"""WITH {_LINES} SELECT path, line, {_CLAMP} AS text, CAST(len(regexp_extract_all(text, '(?i)th[a-z]+ing')) AS INT) AS score
  FROM lines WHERE regexp_matches(text, '(?i)th[a-z]+ing')""")
def search_text_regex(spark, sf_dir):
    return search.matching_lines(t.lines(t.files(spark, sf_dir)), "th[a-z]+ing", is_regex=True)


@_query(f"""WITH {_LINES}, hits AS (SELECT path, line, {_CLAMP} AS text, CAST(greatest((length(text) - length(replace(lower(text), 'idiot', ''))) / 5, 1) AS INT) AS score FROM lines WHERE contains(lower(text), 'idiot')),
 near AS (SELECT h.path, h.line, l.line AS pos, substring(regexp_replace(l.text, '\\s+$', ''), 1, 200) AS t FROM hits h JOIN lines l ON h.path = l.path AND l.line BETWEEN h.line - 2 AND h.line + 2 AND l.line <> h.line),
 a AS (SELECT path, line, string_agg(t, '|' ORDER BY pos) FILTER (WHERE pos < line) AS before, string_agg(t, '|' ORDER BY pos) FILTER (WHERE pos > line) AS after FROM near GROUP BY 1, 2)
 SELECT h.path, h.line, h.text, h.score, coalesce(a.before, '') AS before, coalesce(a.after, '') AS after FROM hits h LEFT JOIN a ON h.path = a.path AND h.line = a.line""")
def search_text_context(spark, sf_dir):
    lines = t.lines(t.files(spark, sf_dir))
    found = search.with_context(lines, search.matching_lines(lines, "idiot"), 2)
    return found.select("path", "line", "text", "score", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@_query(f"""WITH {_LINES}, h AS (SELECT path, line, {_CLAMP} AS text, CAST(greatest((length(text) - length(replace(lower(text), 'license', ''))) / 7, 1) AS INT) AS score
  FROM lines WHERE contains(lower(text), 'license') ORDER BY path, line LIMIT 20) SELECT *, (SELECT count(*) FROM h) >= 20 AS truncated FROM h""")
def search_text_first(spark, sf_dir):
    return search.first_lines(search.matching_lines(t.lines(t.files(spark, sf_dir)), "license"), 20)


@_query(f"""WITH {_LINES} SELECT path, count(*) AS match_count, CAST(min(line) AS INT) AS first_line, CAST(sum(CAST(greatest((length(text) - length(replace(lower(text), 'and', ''))) / 3, 1) AS INT)) AS BIGINT) AS score
  FROM lines WHERE contains(lower(text), 'and') AND regexp_matches(path, '^src1[^/]*/en/[^/]*\\.py$') GROUP BY path""")
def search_text_by_file(spark, sf_dir):
    return search.by_file(search.matching_lines(t.lines(t.files(spark, sf_dir)), "and", file_pattern="src1*/en/*.py"))


@_query(f"""WITH {_LINES} SELECT path, line, {_CLAMP} AS text, CAST(greatest((length(text) - length(replace(lower(text), 'license', ''))) / 7, 1) AS INT) AS score
  FROM lines WHERE contains(lower(text), 'license')""")
def trigram_search(spark, sf_dir):
    return trigrams.build(t.files(spark, sf_dir).where("path is not null"), scratch.folder(spark, "trigrams")).search("license")


@_query(f"""WITH {_LINES} SELECT path, line, {_CLAMP} AS text, CAST(len(regexp_extract_all(text, '(?i)(?:licen[cs]e|copyright)[ a-z]*(?:the|and)')) AS INT) AS score
  FROM lines WHERE regexp_matches(text, '(?i)(?:licen[cs]e|copyright)[ a-z]*(?:the|and)')""")
def trigram_regex(spark, sf_dir):
    return trigrams.build(t.files(spark, sf_dir).where("path is not null"), scratch.folder(spark, "trigrams")).search("(?:licen[cs]e|copyright)[ a-z]*(?:the|and)", is_regex=True)


def _vector_sql(k: int, queries: str) -> str:
    return f"""q AS (SELECT vec_id AS query_id, label AS q_label, embedding AS qe FROM embeddings WHERE {queries}),
 pairs AS (SELECT query_id, q_label, vec_id, label, list_sum(list_transform(range(1, len(qe) + 1), lambda i: CAST(qe[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) /
   (sqrt(list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS score FROM q, embeddings),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM pairs), topk AS (SELECT * FROM ranked WHERE rank <= {k})"""


_ASKED = "vec_id % 20 = 0"


def _asked(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 20, as a query."""
    v = t.vectors(spark, sf_dir)
    return v.where("cast(id as bigint) % 20 = 0").select(F.col("id").alias("query_id"), "namespace", "embedding", F.col("label").alias("q_label"))


@_query("WITH " + _vector_sql(5, _ASKED) + " SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM topk")
def vector_topk(spark, sf_dir):
    found = vectors.top_k(t.vectors(spark, sf_dir), _asked(spark, sf_dir), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _ranked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ten nearest of each query, written once; which of them are relevant to it: the vectors of its label; and how many vectors are."""
    v, q = t.vectors(spark, sf_dir), _asked(spark, sf_dir)
    ranked = scratch.Steps(spark, "ranked").save(vectors.top_k(v, q, 10))
    return ranked, *vectors.judged_by_label(ranked, v, q)


_RECALL = "SELECT CAST(r.query_id AS VARCHAR) AS query_id, count(*) FILTER (WHERE r.label = r.q_label) / (SELECT count(*) FROM embeddings e WHERE e.label = r.q_label) AS recall FROM topk r GROUP BY r.query_id, r.q_label"
_MRR = "SELECT CAST(query_id AS VARCHAR) AS query_id, coalesce(1.0 / min(rank) FILTER (WHERE label = q_label), 0) AS reciprocal_rank FROM topk GROUP BY query_id"


@_query(f"WITH {_vector_sql(10, _ASKED)}, x AS ({_RECALL}) SELECT query_id, round(recall, 6) AS recall FROM x")
def recall_at_k(spark, sf_dir):
    ranked, judged, total = _ranked(spark, sf_dir)
    return vectors.recall_at_k(ranked, judged, 10, total).select("query_id", F.round("recall", 6).alias("recall"))


@_query(f"WITH {_vector_sql(10, _ASKED)}, x AS ({_MRR}) SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM x")
def mrr_at_k(spark, sf_dir):
    ranked, judged, _ = _ranked(spark, sf_dir)
    return vectors.mrr_at_k(ranked, judged, 10).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@_query(f"WITH {_vector_sql(10, _ASKED)}, x AS ({_RECALL}), y AS ({_MRR}) SELECT (SELECT count(*) FROM x) AS query_count, (SELECT CAST(round(avg(recall), 6) AS DOUBLE) FROM x) AS mean_recall, (SELECT CAST(round(avg(reciprocal_rank), 6) AS DOUBLE) FROM y) AS mean_mrr")
def mean_measures(spark, sf_dir):
    ranked, judged, total = _ranked(spark, sf_dir)
    found = evaluation.mean_measures(vectors.recall_at_k(ranked, judged, 10, total), vectors.mrr_at_k(ranked, judged, 10))
    return found.select("query_count", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_mrr", 6).alias("mean_mrr"))


@_query()
def ann_topk(spark, sf_dir):
    """The ten nearest of each query by the inverted file, with as many probes as a recall of 0.95 needs; measured in tests/test_ann.py."""
    found = ann.nearest(t.vectors(spark, sf_dir), _asked(spark, sf_dir), 10, scratch.folder(spark, "ann"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) > 0) AS n_valid FROM embeddings")
def vector_validation(spark, sf_dir):
    return t.vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.count(F.when(vectors.valid(F.col("embedding")), 1)).alias("n_valid"))


@_query("""SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 3 = 0 THEN -label ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 1""")
def vector_upsert_delete(spark, sf_dir):
    v = t.vectors(spark, sf_dir)
    rows = v.where("cast(id as bigint) % 3 = 0").select("namespace", "id", "embedding", (-F.col("label")).alias("label"), F.lit(1).alias("seq"))
    after = vectors.upsert(v, rows)
    gone = after.where("cast(id as bigint) % 5 = 1").select("namespace", "id")
    return after.join(gone, ["namespace", "id"], "left_anti").select("id", "label")


#: A file's vector is that of the document's id.
_NEAR = """qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), vf AS (SELECT e.vec_id, list_sum(list_transform(range(1, len(qe) + 1), lambda i: CAST(qe[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) /
   (sqrt(list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS score FROM qv, embeddings e),
 nf AS (SELECT * FROM vf ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 60)"""


@_query(f"""WITH {_LINES}, {_NEAR}, lx AS (SELECT path, line, {_CLAMP} AS text, greatest((length(text) - length(replace(lower(text), 'stupid', ''))) / 6, 1) AS score FROM lines WHERE contains(lower(text), 'stupid') ORDER BY path, line LIMIT 250),
 sm AS (SELECT l.path, l.line, substring(regexp_replace(l.text, '\\s+$', ''), 1, 200) AS text, nf.score FROM nf JOIN lines l ON regexp_extract(l.path, '/doc_(\\d+)\\.', 1) = CAST(nf.vec_id AS VARCHAR) WHERE l.line = 1),
 m AS (SELECT coalesce(lx.path, sm.path) AS path, coalesce(lx.line, sm.line) AS line, coalesce(lx.text, sm.text) AS text, lx.score AS l, CASE WHEN sm.score > 0 THEN sm.score END AS s FROM lx FULL OUTER JOIN sm ON lx.path = sm.path AND lx.line = sm.line),
 n AS (SELECT path, line, text, CASE WHEN l IS NULL THEN 0.0 WHEN max(l) OVER () = min(l) OVER () THEN 1.0 ELSE (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()) END AS lexical_score,
   CASE WHEN s IS NULL THEN 0.0 WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS semantic_score FROM m),
 f AS (SELECT path, line, text, lexical_score, semantic_score, 0.4 * lexical_score + 0.6 * semantic_score AS score FROM n ORDER BY 6 DESC, 4 DESC, 5 DESC, 1, 2, 3 LIMIT 20)
 SELECT path, line, text, CAST(round(lexical_score, 6) AS DOUBLE) AS lexical_score, CAST(round(semantic_score, 6) AS DOUBLE) AS semantic_score, CAST(round(score, 6) AS DOUBLE) AS score FROM f""")
def search_text_hybrid(spark, sf_dir):
    """Lines with a word, fused with the first lines of the files whose vectors are nearest to that of file 0."""
    lines, v = t.lines(t.files(spark, sf_dir)), t.vectors(spark, sf_dir)
    lexical = search.matching_lines(lines, "stupid").orderBy("path", "line").limit(250)
    near = vectors.top_k(v, v.where("id = '0'").select(F.col("id").alias("query_id"), "namespace", "embedding"), 60).select("id", "score")
    first = lines.where("line = 1").withColumn("id", F.regexp_extract("path", r"/doc_(\d+)\.", 1))
    semantic = first.join(near, "id").select("path", "line", tx.clamp_line(F.col("text")).alias("text"), "score")
    found = search.fuse(lexical, semantic, search.hybrid_weights(0.4, 0.6), 20)
    return found.select("path", "line", "text", *[F.round(c, 6).alias(c) for c in ("lexical_score", "semantic_score", "score")])


# ---- catalog -------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_FILES}, p AS (SELECT string_split(path, '/') AS p, size_bytes FROM files), d AS (SELECT unnest(['(root)', p[1] || '/', p[1] || '/' || p[2] || '/']) AS directory, size_bytes FROM p)
 SELECT directory, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM d GROUP BY 1""")
def file_tree(spark, sf_dir):
    return catalog.file_tree(t.files(spark, sf_dir))


@_query(f"""WITH {_FILES}, {_SYMBOLS} SELECT 'directories' AS section, string_split(path, '/')[1] || '/' AS key, count(*) AS n FROM files GROUP BY 2
 UNION ALL SELECT 'kinds', kind, count(*) FROM symbols GROUP BY 2
 UNION ALL SELECT 'languages', CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' ELSE 'sql' END, count(*) FROM files GROUP BY 2""")
def repo_outline(spark, sf_dir):
    return catalog.repo_outline(t.files(spark, sf_dir), t.symbols(spark, sf_dir))


@_query(f"""WITH {_FILES}, p AS (SELECT path, string_split(content, chr(10)) AS p FROM files), c AS (SELECT path, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM p)
 SELECT path, CAST(least(2, greatest(len(p), 1)) AS INT) AS start_line, CAST(least(4, greatest(len(p), 1)) AS INT) AS end_line, CAST(len(p) AS INT) AS line_count, array_to_string(p[least(2, greatest(len(p), 1)):least(4, greatest(len(p), 1))], chr(10)) AS content FROM c""")
def file_content_slice(spark, sf_dir):
    return catalog.content_slice(t.files(spark, sf_dir), 2, 4)


@_query(f"""WITH {_SYMBOLS}, f AS (SELECT DISTINCT p_brand AS path FROM part), s AS (SELECT file, count(*) AS n, string_agg(name, ',' ORDER BY line, id) AS names FROM symbols GROUP BY 1)
 SELECT f.path, CAST(NULL AS VARCHAR) AS language, coalesce(s.n, 0) AS symbol_count, coalesce(s.names, '') AS names FROM f LEFT JOIN s ON f.path = s.file""")
def file_outline(spark, sf_dir):
    files = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("path")).distinct()
    return catalog.file_outline(files, t.symbols(spark, sf_dir))


@_query(f"""WITH {_FILES}, a AS (SELECT path, sha256(content) AS h FROM files WHERE size_bytes % 10 <> 1), b AS (SELECT path, CASE WHEN size_bytes % 7 = 0 THEN sha256(content || '!') ELSE sha256(content) END AS h FROM files WHERE size_bytes % 10 <> 2)
 SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h""")
def file_diff(spark, sf_dir):
    f = t.files(spark, sf_dir)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    a = f.where("size_bytes % 10 <> 1").select("path", hashed(F.col("content")).alias("content_hash"))
    b = f.where("size_bytes % 10 <> 2").select("path", F.when(F.col("size_bytes") % 7 == 0, hashed(F.concat("content", F.lit("!")))).otherwise(hashed(F.col("content"))).alias("content_hash"))
    return catalog.file_diff(a, b)


@_query(f"""WITH {_SYMBOLS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY file, line, id) AS rn FROM symbols WHERE CAST(id AS BIGINT) % 10 <> 1) WHERE rn = 1),
 b AS (SELECT * REPLACE (CASE WHEN line % 4 = 0 THEN 'x' || content_hash ELSE content_hash END AS content_hash) FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY file, line, id) AS rn FROM symbols WHERE CAST(id AS BIGINT) % 10 <> 2) WHERE rn = 1)
 SELECT coalesce(a.name, b.name) AS name, coalesce(a.kind, b.kind) AS kind, coalesce(b.file, a.file) AS file, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS status,
  a.content_hash <> b.content_hash AS hash_changed FROM a FULL OUTER JOIN b ON a.name = b.name AND a.kind = b.kind""")
def symbol_diff(spark, sf_dir):
    s = t.symbols(spark, sf_dir)
    b = s.where("cast(id as bigint) % 10 <> 2").withColumn("content_hash", F.when(F.col("line") % 4 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")))
    return catalog.symbol_diff(s.where("cast(id as bigint) % 10 <> 1"), b)


@_query(f"""WITH {_FILES} SELECT string_split(path, '/')[1] AS directory, sha256(string_agg(path || chr(0) || sha256(content) || chr(10), '' ORDER BY path)) AS tree_sha256, count(*) AS file_count FROM files GROUP BY 1""")
def tree_hash(spark, sf_dir):
    return catalog.tree_hash(t.files(spark, sf_dir))


@_query(f"""WITH {_FILES} SELECT path, sha256(content) AS sha256, sha1(path) AS sha1, regexp_replace(regexp_replace(path, '[^A-Za-z0-9._-]', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM files""")
def content_hashes(spark, sf_dir):
    return t.files(spark, sf_dir).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.sha1(F.col("path").cast("binary")).alias("sha1"), tx.slug(F.col("path")).alias("slug"))


#: Over 30 % of the first 4096 bytes are no tab, line end or printable ASCII, or there is a NUL.
_BINARY = """bytes AS (SELECT path, content, size_bytes, substring(hex(encode(content)), 1, 8192) AS h FROM files), judged AS (SELECT path, size_bytes, contains(content, chr(0)) OR
  len(list_filter(range(0, len(h) // 2), lambda i: NOT regexp_matches(substring(h, 2 * i + 1, 2), '^(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])$'))) > 0.3 * (len(h) // 2) AS bin FROM bytes)"""


@_query(f"""WITH {_FILES}, {_BINARY} SELECT path, CASE WHEN regexp_matches(path, '^src3/') THEN 'gitignore' WHEN regexp_matches(path, '[^/]*_1[^/]*\\.sql$') THEN 'extra_ignore' WHEN size_bytes > 512000 THEN 'too_large' WHEN bin THEN 'binary' END AS skip_reason FROM judged""")
def discovery_filter(spark, sf_dir):
    return catalog.discover(t.files(spark, sf_dir), ignore=["src3/"], extra_ignore=["*_1*.sql"]).select("path", "skip_reason")


@_query(f"""WITH {_FILES} SELECT path FROM files WHERE regexp_matches(path, '^src3/') OR regexp_matches(path, '_1[^/]*\\.sql$') OR regexp_matches(path, '^src[^/]*/fr/')""")
def scoped_ignores(spark, sf_dir):
    """Files that an ignore file of their folder or one above leaves out: one at the top, and one in each top folder."""
    f = t.files(spark, sf_dir).select("path", "content")
    top = f.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("d")).distinct()
    own = top.select(F.concat("d", F.lit("/.gitignore")).alias("path"), F.lit("# made\nfr/\n!kept\n*_1*.sql\n").alias("content"))
    root = spark.range(1).select(F.lit(".gitignore").alias("path"), F.lit("./src3/\n").alias("content"))
    return catalog.scoped_ignored(f, catalog.ignore_rules(f.unionByName(own).unionByName(root)))


_BLOCKS = "substring(sha256({0}), 1, 3)"


@_query(f"""WITH {_FILES}, b AS (SELECT string_split(path, '/')[1] AS directory, {_BLOCKS.format('path')} AS block, sha256(string_agg(path || chr(0) || sha256(coalesce(content, '')) || chr(10), '' ORDER BY path)) AS d, count(*) AS n FROM files WHERE path IS NOT NULL GROUP BY 1, 2)
 SELECT directory, sha256(string_agg(d, '' ORDER BY block)) AS tree_sha256, CAST(sum(n) AS BIGINT) AS file_count FROM b GROUP BY 1""")
def tree_digest(spark, sf_dir):
    return catalog.tree_digest(t.files(spark, sf_dir))


@_query(f"""WITH {_FILES}, cur AS (SELECT path, CASE WHEN size_bytes % 7 = 0 THEN content || '!' ELSE content END AS content FROM files WHERE size_bytes % 10 <> 1),
 st AS (SELECT path, content FROM files WHERE size_bytes % 10 <> 2) SELECT cur.path, CASE WHEN st.path IS NULL THEN 'new' WHEN sha256(st.content) <> sha256(cur.content) THEN 'changed' ELSE 'kept' END AS origin, sha256(cur.content) AS content_hash FROM cur LEFT JOIN st ON cur.path = st.path""")
def incremental_snapshot(spark, sf_dir):
    """The snapshot after files went, came and changed, with what was done for each file that it has."""
    f = t.files(spark, sf_dir).select("path", "content", "size_bytes")
    stored = f.where("size_bytes % 10 <> 2").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    current = f.where("size_bytes % 10 <> 1").withColumn("content", F.when(F.col("size_bytes") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ingest.incremental(stored, current.select("path", "content"))


@_query(f"""WITH {_FILES} SELECT string_split(path, '/')[1] AS directory, 'sha256:' || sha256(unhex(string_agg(hex(encode(path)) || '0A' || sha256(content), '' ORDER BY path))) AS digest, count(*) AS file_count FROM files GROUP BY 1""")
def fixture_digest(spark, sf_dir):
    return catalog.fixture_digest(t.files(spark, sf_dir))


def _fold_sql(name: str, children: str) -> str:
    """name: directory, digest, file_count, size_bytes of children (directory, name, kind, digest, n, size)."""
    return f"""{name}_b AS (SELECT directory, {_BLOCKS.format('name')} AS block, sha256(string_agg(name || chr(0) || kind || chr(0) || digest || chr(10), '' ORDER BY name)) AS d, sum(n) AS n, sum(size) AS size FROM ({children}) GROUP BY 1, 2),
 {name} AS (SELECT directory, sha256(string_agg(block || d, '' ORDER BY block)) AS digest, sum(n) AS n, sum(size) AS size FROM {name}_b GROUP BY 1)"""


_UP = "SELECT regexp_replace(directory, '/?[^/]*$', '') AS directory, string_split(directory, '/')[-1] AS name, 'd' AS kind, digest, n, size FROM "


@_query(f"""WITH {_FILES}, leaf AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, string_split(path, '/')[-1] AS name, 'f' AS kind, sha256(coalesce(content, '')) AS digest, 1 AS n, coalesce(size_bytes, 0) AS size FROM files),
 {_fold_sql("two", "FROM leaf")}, {_fold_sql("one", _UP + "two")}, {_fold_sql("zero", _UP + "one")}, every AS (FROM two UNION ALL FROM one UNION ALL FROM zero)
 SELECT directory, digest, CAST(n AS BIGINT) AS file_count, CAST(size AS BIGINT) AS size_bytes FROM every""")
def merkle_directories(spark, sf_dir):
    """Digest, files and bytes of every directory."""
    return merkle.fold(t.files(spark, sf_dir))[0]


@_query(ORACLE_SQL["file_diff"])
def merkle_diff(spark, sf_dir):
    """The files that differ between two stored trees, found from their roots down."""
    f = t.files(spark, sf_dir)
    at = scratch.folder(spark, "trees")
    a = merkle.Tree(spark, f"{at}/a").write(f.where("size_bytes % 10 <> 1"))
    b = f.where("size_bytes % 10 <> 2").withColumn("content", F.when(F.col("size_bytes") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return merkle.diff(a, merkle.Tree(spark, f"{at}/b").write(b))


_NEST = """SELECT {up} AS directory, '[' || string_agg(node, ',' ORDER BY name) || ']' AS tree FROM {rows} GROUP BY 1"""
_DIRECTORY = """SELECT directory AS place, string_split(directory, '/')[-1] AS name, '{{"children":' || tree || ',"path":"' || string_split(directory, '/')[-1] || '/","type":"dir"}}' AS node FROM {0}"""


@_query(f"""WITH {_FILES}, leaf AS (SELECT regexp_replace(path, '/[^/]*$', '') AS place, string_split(path, '/')[-1] AS name, '{{"language":"' || CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' ELSE 'sql' END || '","path":"' || path || '","symbol_count":0,"type":"file"}}' AS node FROM files),
 two AS ({_NEST.format(up="place", rows="leaf")}), one AS ({_NEST.format(up="string_split(place, '/')[1]", rows="(" + _DIRECTORY.format("two") + ")")}), zero AS ({_NEST.format(up="''", rows="(" + _DIRECTORY.format("one") + ")")})
 FROM two UNION ALL FROM one UNION ALL FROM zero""")
def nested_tree(spark, sf_dir):
    return merkle.nested(t.files(spark, sf_dir))


_COMMITS = f"""WITH {_FILES}, first AS (SELECT path, content FROM files WHERE size_bytes % 10 <> 1),
 second AS (SELECT path, CASE WHEN size_bytes % 7 = 0 AND size_bytes % 10 <> 1 THEN content || '!' ELSE content END AS content, size_bytes FROM files WHERE size_bytes % 10 NOT IN (1, 2) OR (size_bytes % 10 = 1 AND size_bytes % 3 = 0)),
 third AS (SELECT path, content FROM second WHERE size_bytes % 10 <> 1 OR size_bytes % 2 = size_bytes % 4 UNION ALL SELECT path, 'back' FROM files WHERE size_bytes % 10 = 2 AND size_bytes % 4 = 0)"""


def _three_commits(spark, sf_dir) -> versions.Snapshots:
    """A store with three versions: some files, then changes of all kinds, then files that come back and go."""
    f = t.files(spark, sf_dir).select("path", "content", "size_bytes")
    own = versions.Snapshots(spark, scratch.folder(spark, "versions"), 64)
    size = F.col("size_bytes")
    own.replace(f.where(size % 10 != 1))
    kind = F.when(size % 10 == 2, "deleted").when((size % 10 == 1) & (size % 3 == 0), "added").when((size % 10 != 1) & (size % 7 == 0), "modified")
    own.commit(f.select("path", kind.alias("change_type"), F.when(kind == "modified", F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content")).where("change_type is not null"))
    kind = F.when((size % 10 == 2) & (size % 4 == 0), "added").when((size % 10 == 1) & (size % 3 == 0) & (size % 2 != size % 4), "deleted")
    own.commit(f.select("path", kind.alias("change_type"), F.lit("back").alias("content")).where("change_type is not null"))
    return own


@_query(f"""{_COMMITS} SELECT third.path, sha256(third.content) AS content_hash, CAST(strlen(third.content) AS BIGINT) AS size_bytes, first.path IS NOT NULL AS in_first FROM third LEFT JOIN first ON third.path = first.path""")
def snapshot_versions(spark, sf_dir):
    """The third version, and whether a reader of the first has the file."""
    own = _three_commits(spark, sf_dir)
    first = own.read(1).select("path", F.lit(True).alias("in_first"))
    return own.read().join(first, "path", "left").select("path", "content_hash", "size_bytes", F.coalesce("in_first", F.lit(False)).alias("in_first"))


@_query(f"""{_COMMITS} SELECT coalesce(first.path, third.path) AS path, CASE WHEN first.path IS NULL THEN 'new' WHEN third.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
 FROM first FULL OUTER JOIN third ON first.path = third.path WHERE first.path IS NULL OR third.path IS NULL OR sha256(first.content) <> sha256(third.content)""")
def snapshot_changes(spark, sf_dir):
    """What differs between the first version and the third, from the buckets that differ."""
    return _three_commits(spark, sf_dir).changes(1, 3)


# ---- symbols -------------------------------------------------------------------------------------------------------

_TOKENS = "list_transform(regexp_extract_all(regexp_replace({0}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[a-zA-Z0-9]{{2,}}'), lambda x: lower(x))"
_SCORE = f"""WITH {_SYMBOLS}, n AS (SELECT file, count(*) AS n FROM symbols GROUP BY 1), s AS (SELECT s.*, CASE WHEN n.n > 1 THEN 0.3 * ln(n.n) ELSE 0 END AS centrality,
  CAST(3 * len(list_filter({_TOKENS.format('name')}, lambda x: x = 'blue')) + 2 * len(list_filter(flatten(list_transform(keywords, lambda k: {_TOKENS.format('k')})), lambda x: x = 'blue')) + 2 * len(list_filter({_TOKENS.format('signature')}, lambda x: x = 'blue')) + CASE WHEN lower(name) = 'blue' THEN 50 ELSE 0 END AS DOUBLE) AS lexical
  FROM symbols s JOIN n ON s.file = n.file)"""


@_query(f"{_SCORE} SELECT id, name, kind, file, line, lexical, round(lexical + centrality, 6) AS score FROM s WHERE lexical > 0")
def search_symbols_scored(spark, sf_dir):
    found = symbols.search(t.symbols(spark, sf_dir), "blue")
    return found.select("id", "name", "kind", "file", "line", "lexical", F.round("score", 6).alias("score"))


@_query(f"{_SCORE} SELECT id, name, kind, file, line, round(lexical + centrality, 6) AS score FROM s WHERE lexical > 0 AND kind = 'class' ORDER BY lexical + centrality DESC, file, line, name, id LIMIT 10")
def search_symbols_ranked(spark, sf_dir):
    found = symbols.ranked(symbols.search(t.symbols(spark, sf_dir), "blue", kind="class"), 10)
    return found.select("id", "name", "kind", "file", "line", F.round("score", 6).alias("score"))


@_query(f"WITH {_SYMBOLS}, n AS (SELECT file, count(*) AS n FROM symbols GROUP BY 1) SELECT id, round(CASE WHEN n > 1 THEN 0.3 * ln(n) ELSE 0 END, 6) AS centrality FROM symbols s JOIN n ON s.file = n.file")
def symbol_centrality(spark, sf_dir):
    return symbols.centrality(t.symbols(spark, sf_dir)).select("id", F.round("centrality", 6).alias("centrality"))


@_query(f"""{_SCORE.replace("WITH symbols", "WITH RECURSIVE symbols")}, b AS (SELECT s.*, CAST(floor(p_retailprice) AS BIGINT) AS size, row_number() OVER (ORDER BY lexical + centrality DESC, file, line, name, s.id) AS rn FROM s JOIN part ON CAST(p_partkey AS VARCHAR) = s.id WHERE lexical > 0),
 f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS id UNION ALL SELECT b.rn, CASE WHEN f.used + b.size <= 16000 THEN f.used + b.size ELSE f.used END, CASE WHEN f.used + b.size <= 16000 THEN b.id END FROM f JOIN b ON b.rn = f.rn + 1)
 SELECT id, CAST((SELECT max(used) FROM f) // 4 AS BIGINT) AS tokens_used FROM f WHERE id IS NOT NULL""")
def search_symbols_budget(spark, sf_dir):
    return symbols.pack_budget(symbols.search(t.symbols(spark, sf_dir), "blue"), 4000).select("id", "tokens_used")


@_query(f"""WITH {_SYMBOLS}, tg AS (SELECT file, {_TOKENS.format('name')} AS tk FROM symbols WHERE id = '7'), i AS (SELECT DISTINCT substring(p_brand, 1, length(p_brand) - 1) AS who, p_brand AS file FROM part),
 sh AS (SELECT DISTINCT file FROM i WHERE who IN (SELECT who FROM i, tg WHERE i.file = tg.file)),
 s AS (SELECT s.id, s.name, s.kind, s.file, s.line, CASE WHEN s.file = tg.file THEN 3.0 WHEN s.file IN (SELECT file FROM sh) THEN 1.5 ELSE 0.0 END + 0.5 * len(list_intersect(list_distinct({_TOKENS.format('s.name')}), tg.tk)) AS score FROM symbols s, tg WHERE s.id <> '7')
 SELECT id, name, kind, file, line, CAST(round(score, 2) AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, file, name, id LIMIT 50""")
def related_symbols(spark, sf_dir):
    """Brands are files; those that differ in their last digit only have an importer in common."""
    brand = F.col("p_brand")
    imports = t.table(spark, sf_dir, "part").select(F.substring(brand, F.lit(1), F.length(brand) - 1).alias("source_file"), brand.alias("resolved")).distinct()
    return symbols.related(t.symbols(spark, sf_dir), imports, "7", 50)


@_query(f"WITH {_SYMBOLS}, k AS (SELECT unnest(keywords) AS k FROM symbols) SELECT lower(trim(k)) AS keyword, count(*) AS n FROM k WHERE trim(k) <> '' GROUP BY 1 ORDER BY n DESC, keyword LIMIT 15")
def keyword_histogram(spark, sf_dir):
    return symbols.keyword_histogram(t.symbols(spark, sf_dir))


@_query(f"""WITH {_SYMBOLS}, b AS (SELECT id, unnest(list_distinct({_TOKENS.format('name')})) AS t FROM symbols), a AS (SELECT * FROM b WHERE CAST(id AS BIGINT) % 20 = 0)
 SELECT a.id AS a, b.id AS b, CAST(count(*) AS INT) AS overlap FROM a JOIN b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2""")
def token_overlap(spark, sf_dir):
    """Symbols whose names share tokens with those of the symbols with an id divisible by 20."""
    return symbols.token_overlap(t.symbols(spark, sf_dir), F.expr("cast(id as bigint) % 20 = 0"))


_CLASSES = "b AS (SELECT 'C' || p_partkey AS name, 'C' || (p_partkey // 3) AS base FROM part WHERE p_partkey <> p_partkey // 3 UNION ALL SELECT 'C' || p_partkey, 'I' || (p_partkey % 10) FROM part)"


@_query(f"""WITH RECURSIVE {_CLASSES}, up AS (SELECT base AS name, 1 AS level FROM b WHERE name = 'C' || (SELECT max(p_partkey) FROM part) UNION ALL SELECT b.base, up.level + 1 FROM up JOIN b ON up.name = b.name)
 SELECT name, CAST(min(level) AS INT) AS level FROM up GROUP BY 1""")
def class_ancestors(spark, sf_dir):
    last = t.table(spark, sf_dir, "part").agg(F.concat(F.lit("C"), F.max("p_partkey"))).first()[0]
    return symbols.closure(_bases(spark, sf_dir), last)


@_query(f"""WITH RECURSIVE {_CLASSES}, dn AS (SELECT name, 1 AS level FROM b WHERE base = 'C1' UNION ALL SELECT b.name, dn.level + 1 FROM dn JOIN b ON dn.name = b.base)
 SELECT name, CAST(min(level) AS INT) AS level FROM dn GROUP BY 1""")
def class_descendants(spark, sf_dir):
    return symbols.closure(_bases(spark, sf_dir), "C1", up=False)


def _bases(spark, sf_dir) -> DataFrame:
    """Parts as classes, parsed from signatures of several forms: each extends the part with a third of its number, and implements one of ten interfaces."""
    key = F.col("p_partkey")
    up, own = F.concat(F.lit("C"), F.floor(key / 3).cast("string")), F.concat(F.lit("C"), key.cast("string"))
    face = F.concat(F.lit("I"), (key % 10).cast("string"))
    forms = F.when(key % 2 == 0, F.concat(F.lit("export class "), own, F.lit(" extends "), up, F.lit(" implements "), face, F.lit("<T> {"))).otherwise(F.concat(F.lit("class "), own, F.lit("("), up, F.lit("<T>, "), face, F.lit("):")))
    return symbols.class_bases(t.table(spark, sf_dir, "part").select(own.alias("name"), F.lit("class").alias("kind"), forms.alias("signature")))


# ---- imports and graph ---------------------------------------------------------------------------------------------


@_query(f"WITH {_LINKS} SELECT specifier AS file, count(*) AS imported_by FROM links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def most_imported(spark, sf_dir):
    return symbols.most_imported(t.links(spark, sf_dir))


@_query("""WITH i AS (SELECT p_partkey AS k, (p_partkey * 7) % 50 AS to_k FROM part) SELECT 'pkg/m' || k || '.py' AS file, 'pkg/m3' AS specifier, k = 3 OR k IN (SELECT to_k FROM i) AS has_importers FROM i WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = 3) ORDER BY file LIMIT 200""")
def importers(spark, sf_dir):
    """Modules that import pkg/m3, and whether others import them."""
    files = _modules(spark, sf_dir)
    steps = scratch.Steps(spark, "imports")
    found = steps.save(graph.extract_imports(files.repartition(2 * spark.sparkContext.defaultParallelism)))  # few small files are many contents
    imports = steps.save(graph.resolve_imports(found, files))
    return graph.importers(imports, "pkg/m3.py", 200).select("file", "specifier", "has_importers")


def _graph_sql(depth: int, forward: bool) -> str:
    e = _EDGES if forward else _EDGES.replace("edges AS (", "fwd AS (") + ", edges AS (SELECT target AS source, source AS target FROM fwd)"
    return f"WITH RECURSIVE {e}, walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION SELECT e.target, w.level + 1 FROM walk w JOIN edges e ON w.node = e.source WHERE w.level < {depth}), nodes AS (SELECT node, min(level) AS level FROM walk GROUP BY 1)"


def _start(spark) -> DataFrame:
    return spark.range(1, 2).select(F.col("id").alias("node"))


@_query(_graph_sql(2, True) + " SELECT node, CAST(level AS INT) AS level FROM nodes")
def dependency_nodes(spark, sf_dir):
    return graph.bfs(t.edges(spark, sf_dir), _start(spark), 2)[0]


@_query(_graph_sql(2, True) + " SELECT e.source, e.target FROM edges e JOIN nodes n ON e.source = n.node WHERE n.level < 2")
def dependency_edges(spark, sf_dir):
    return graph.bfs(t.edges(spark, sf_dir), _start(spark), 2)[1]


@_query(_graph_sql(3, False) + " SELECT node, CAST(level AS INT) AS level FROM nodes")
def dependency_importers(spark, sf_dir):
    return graph.bfs(t.edges(spark, sf_dir), _start(spark), 3, "importers")[0]


@_query(_graph_sql(1, True) + """, i AS (SELECT e.source, e.target FROM edges e WHERE source IN (SELECT node FROM nodes) AND target IN (SELECT node FROM nodes))
 SELECT coalesce(a.node, b.node) AS node, coalesce(a.n, 0) AS n_imports, coalesce(b.n, 0) AS n_imported_by FROM (SELECT source AS node, count(*) AS n FROM i GROUP BY 1) a FULL OUTER JOIN (SELECT target AS node, count(*) AS n FROM i GROUP BY 1) b ON a.node = b.node""")
def dependency_neighbours(spark, sf_dir):
    return _neighbours(spark, t.edges(spark, sf_dir))


def _neighbours(spark, e: DataFrame) -> DataFrame:
    found = graph.neighbours(e, graph.bfs(e, _start(spark), 1)[0])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("node", F.when(F.col("imports").isNull(), 0).otherwise(size("imports")).cast("long").alias("n_imports"), F.when(F.col("imported_by").isNull(), 0).otherwise(size("imported_by")).cast("long").alias("n_imported_by"))


@_query(_graph_sql(2, False) + """ SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(level AS INT) AS level, CAST(len(regexp_extract_all(s_name, '\\bSupplier\\b')) AS INT) AS references, CASE WHEN regexp_matches(s_name, '\\bSupplier\\b') THEN 'confirmed' ELSE 'potential' END AS status FROM supplier JOIN nodes ON s_suppkey = node WHERE level > 0""")
def blast_radius(spark, sf_dir):
    return _blast_radius(spark, sf_dir, t.edges(spark, sf_dir))


def _blast_radius(spark, sf_dir, edges: DataFrame) -> DataFrame:
    files = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_name").alias("content"))
    e = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    return graph.blast_radius(files, e, "Supplier", "1", 2)


@_query(f"""WITH {_FILES}, {_LINKS}, w AS (SELECT unnest(['idiot', 'license', 'zzzz', '1']) AS identifier), h AS (SELECT DISTINCT source_file, regexp_extract(specifier, '([^/]*)$', 1) AS name FROM links), f AS (SELECT identifier, count(*) AS n FROM w JOIN files ON contains(lower(content), identifier) GROUP BY 1),
 g AS (SELECT identifier, count(DISTINCT source_file) AS n FROM w JOIN h ON lower(h.name) = identifier OR regexp_replace(lower(h.name), '\\.[^.]*$', '') = identifier GROUP BY 1)
 SELECT w.identifier, coalesce(g.n, 0) AS import_files, coalesce(f.n, 0) AS content_files, coalesce(g.n, 0) + coalesce(f.n, 0) > 0 AS is_referenced FROM w LEFT JOIN f ON w.identifier = f.identifier LEFT JOIN g ON w.identifier = g.identifier""")
def check_references(spark, sf_dir):
    return graph.check_references(t.links(spark, sf_dir), t.files(spark, sf_dir), t.symbols(spark, sf_dir), ["idiot", "license", "zzzz", "1"])


@_query(f"""WITH {_LINES}, w AS (SELECT unnest(['idiot', 'license', 'zzzz']) AS identifier), d AS (SELECT path FROM files WHERE path LIKE '%1.py'),
 h AS (SELECT identifier, path, row_number() OVER (PARTITION BY identifier ORDER BY path) AS k FROM w JOIN files ON contains(lower(content), identifier) WHERE NOT (identifier = 'idiot' AND path IN (SELECT path FROM d)))
 SELECT h.identifier, l.path AS file, l.line, substring(regexp_replace(l.text, '\\s+$', ''), 1, 200) AS text FROM h JOIN lines l ON l.path = h.path AND contains(lower(l.text), h.identifier) WHERE h.k <= 20""")
def content_references(spark, sf_dir):
    """Lines with identifiers in files that do not define them; files with a name that ends in 1.py define one."""
    f = t.files(spark, sf_dir)
    defined = f.where("path like '%1.py'").select(F.col("path").alias("file"), F.lit("Idiot").alias("name"))
    return graph.content_references(f, defined, ["idiot", "license", "zzzz"], 20)


# ---- chunks and columns --------------------------------------------------------------------------------------------


_CHUNKS = """f AS (SELECT path, line, text, 1 AS start, 1 AS n, strlen(text) AS size FROM lines WHERE line = 1
 UNION ALL SELECT l.path, l.line, l.text, CASE WHEN f.n >= 80 OR f.size + 1 + strlen(l.text) > 3000 THEN l.line ELSE f.start END, CASE WHEN f.n >= 80 OR f.size + 1 + strlen(l.text) > 3000 THEN 1 ELSE f.n + 1 END,
  CASE WHEN f.n >= 80 OR f.size + 1 + strlen(l.text) > 3000 THEN strlen(l.text) ELSE f.size + 1 + strlen(l.text) END FROM f JOIN lines l ON l.path = f.path AND l.line = f.line + 1),
 c AS (SELECT path, start, max(line) AS stop, string_agg(text, chr(10) ORDER BY line) AS t FROM f GROUP BY 1, 2),
 chunks AS (SELECT path, sha1('corpus' || chr(0) || path || chr(0) || CAST(start AS VARCHAR) || chr(0) || CAST(stop AS VARCHAR) || chr(0) || regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS chunk_id, CAST(start AS INT) AS start_line, CAST(stop AS INT) AS end_line, CAST(strlen(t) AS INT) AS chunk_bytes FROM c WHERE trim(t) <> '')"""


@_query(f"WITH RECURSIVE {_LINES}, {_CHUNKS} SELECT * FROM chunks")
def chunk_documents(spark, sf_dir):
    return chunks.chunk(t.files(spark, sf_dir), "corpus").select("path", "chunk_id", "start_line", "end_line", F.octet_length("chunk_text").alias("chunk_bytes"))


_NOW_FILES = """files AS (SELECT path, CASE WHEN size_bytes % 7 = 0 THEN content || ' and more' ELSE content END AS content FROM all_files WHERE size_bytes % 10 <> 1)"""


@_query(f"WITH RECURSIVE {_LINES.replace('files AS (', 'all_files AS (', 1).replace(', parts AS', ', ' + _NOW_FILES + ', parts AS', 1)}, {_CHUNKS} SELECT path, chunk_id AS id FROM chunks")
def vector_sync(spark, sf_dir):
    """The vectors' ids after files went and changed: only chunks that are new are embedded."""
    f = t.files(spark, sf_dir)
    stored = vectors.embed_chunks(chunks.chunk(f, "corpus"), "main")
    touched = f.where("size_bytes % 10 = 1 or size_bytes % 7 = 0").select("path")
    now = f.where("size_bytes % 10 <> 1").withColumn("content", F.when(F.col("size_bytes") % 7 == 0, F.concat("content", F.lit(" and more"))).otherwise(F.col("content")))
    now = now.join(touched, "path", "left_semi")
    return vectors.sync_chunks(stored, chunks.chunk(now, "corpus"), touched, "main").select("path", "id")


@_query(f"""WITH {_FILES}, c AS (SELECT DISTINCT 'doc_' || CAST(p_partkey AS VARCHAR) AS model, p_type AS col FROM part), s AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS model FROM files WHERE path LIKE '%.sql')
 SELECT c.model, c.col AS "column", s.path AS file FROM c LEFT JOIN s ON c.model = s.model""")
def column_models(spark, sf_dir):
    """Columns of models with the .sql file that defines each."""
    c = t.table(spark, sf_dir, "part").select(F.concat(F.lit("doc_"), F.col("p_partkey").cast("string")).alias("model"), F.col("p_type").alias("column")).distinct()
    return chunks.model_files(c, t.files(spark, sf_dir).select(F.col("path").alias("file"))).select("model", "column", "file")


@_query("""WITH c AS (SELECT DISTINCT p_brand AS model, p_type AS col FROM part), s AS (SELECT model, col, CASE WHEN lower(col) = 'standard' THEN 30 WHEN contains(lower(col), 'standard') THEN 15 ELSE 5 * CAST(contains(lower(col), 'standard') AS INT) END + CASE WHEN contains(lower(model), 'standard') THEN 8 ELSE 0 END AS score FROM c)
 SELECT 'parts' AS source, model, col AS "column", model AS description, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, model, col LIMIT 20""")
def column_search(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select(F.lit("parts").alias("source"), F.col("p_brand").alias("model"), F.col("p_type").alias("column"), F.col("p_brand").alias("description")).distinct()
    return chunks.search_columns(p, "standard")


# ---- telemetry -----------------------------------------------------------------------------------------------------


def _calls(spark, sf_dir) -> DataFrame:
    return telemetry.normalise_calls(t.call_events(spark, sf_dir))


@_query(f"""WITH {_CALLS} SELECT time_bucket(INTERVAL 1 DAY, captured_at, TIMESTAMP '1970-01-01') AS bucket, tool_name, count(*) AS call_count, CAST(sum(request_tokens) AS BIGINT) AS request_tokens, CAST(sum(response_tokens) AS BIGINT) AS response_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens_saved) AS BIGINT) AS input_tokens_saved, CAST(sum(output_tokens_saved) AS BIGINT) AS output_tokens_saved, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved
 FROM calls WHERE captured_at >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY AND captured_at < TIMESTAMP '{_NOW}' GROUP BY 1, 2""")
def trend_by_tool(spark, sf_dir):
    return telemetry.trend_by_tool(_calls(spark, sf_dir), "last_30d", _NOW)


_COMMIT_GRAPH = "p AS (SELECT o_orderkey AS c, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 1 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 2)"
_REACH = "{0} AS (SELECT {1} AS c UNION SELECT parent FROM p JOIN {0} ON p.c = {0}.c)"


def _commit_graph(spark, sf_dir) -> DataFrame:
    """Orders as commits: each follows the one with half its number, and every fifth merges the one with a third of it."""
    o, key = t.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pair = lambda df, n: df.select(key.cast("string").alias("commit"), F.floor(key / n).cast("string").alias("parent"))
    return pair(o.where("o_orderkey > 1"), 2).unionByName(pair(o.where("o_orderkey % 5 = 0 and o_orderkey > 2"), 3)).unionByName(o.where("o_orderkey <= 1").select(key.cast("string").alias("commit"), F.lit(None).cast("string").alias("parent")))


@_query(f"""WITH RECURSIVE {_COMMIT_GRAPH}, h AS (SELECT max(o_orderkey) AS h FROM orders), {_REACH.format("a", "h").replace("SELECT h AS c", "SELECT h AS c FROM h")}, {_REACH.format("b", "h // 3").replace("SELECT h // 3 AS c", "SELECT h // 3 AS c FROM h")}
 SELECT CAST(c AS VARCHAR) AS commit FROM a WHERE c NOT IN (SELECT c FROM b)""")
def commits_ahead(spark, sf_dir):
    """What the last commit has that the one with a third of its number has not."""
    head = t.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return history.ahead(_commit_graph(spark, sf_dir), str(head // 3), str(head))


_RAW = """raw AS (SELECT CASE doc_id % 6 WHEN 0 THEN './' || path WHEN 1 THEN ' /' || replace(path, '/', chr(92)) || ' ' WHEN 2 THEN 'a/../' || path WHEN 3 THEN '../' || path WHEN 4 THEN 'node_modules//' || path ELSE replace(path, '.', '_secret.') END AS raw_path,
  path, size_bytes, CASE WHEN doc_id % 4 = 0 THEN ' ' || upper(sha256(path)) END AS blob_sha, doc_id % 6 AS k FROM (SELECT *, CAST(regexp_extract(path, '/doc_(\\d+)\\.', 1) AS BIGINT) AS doc_id FROM files))"""


@_query(f"""WITH {_FILES}, {_RAW}, c AS (SELECT *, CASE k WHEN 3 THEN '../' || path WHEN 4 THEN 'node_modules/' || path WHEN 5 THEN replace(path, '.', '_secret.') ELSE path END AS p FROM raw)
 SELECT raw_path, p AS path, CASE WHEN blob_sha IS NULL THEN sha256(p) ELSE sha256(path) END AS blob_sha, CASE WHEN k = 3 THEN 'path_traversal' WHEN k = 4 THEN 'skip_dir' WHEN regexp_matches(p, '^src3/') THEN 'gitignore' WHEN regexp_matches(p, '[^/]*_1[^/]*\\.sql$') THEN 'extra_ignore' WHEN k = 5 THEN 'secret' WHEN size_bytes > 512000 THEN 'too_large' END AS skip_reason FROM c WHERE path IS NOT NULL""")
def remote_discovery(spark, sf_dir):
    """A remote tree's listing with raw paths of all kinds."""
    f = t.files(spark, sf_dir).where("path is not null").withColumn("id", F.regexp_extract("path", r"/doc_(\d+)\.", 1).cast("long"))
    path, k = F.col("path"), F.col("id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("./"), path)).when(k == 1, F.concat(F.lit(" /"), F.replace(path, F.lit("/"), F.lit("\\")), F.lit(" "))).when(k == 2, F.concat(F.lit("a/../"), path))
        .when(k == 3, F.concat(F.lit("../"), path)).when(k == 4, F.concat(F.lit("node_modules//"), path)).otherwise(F.replace(path, F.lit("."), F.lit("_secret.")))
    )
    listed = f.select(raw.alias("path"), "size_bytes", F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), F.upper(F.sha2(path.cast("binary"), 256)))).alias("blob_sha"))
    return catalog.discover_remote(listed, ignore=["src3/"], extra_ignore=["*_1*.sql"])


_ROLLUP = """count(*) AS call_count, CAST(sum(request_tokens) AS BIGINT) AS request_tokens, CAST(sum(response_tokens) AS BIGINT) AS response_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens_saved) AS BIGINT) AS input_tokens_saved,
 CAST(sum(output_tokens_saved) AS BIGINT) AS output_tokens_saved, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, count(*) AS logical_calls, round(sum(duration_ms), 6) AS duration_ms, min(captured_at) AS first_call_at, max(captured_at) AS last_call_at"""


@_query(f"WITH {_CALLS} SELECT session, {_ROLLUP} FROM calls GROUP BY session")
def session_rollup(spark, sf_dir):
    return telemetry.rollup(_calls(spark, sf_dir), "session")


@_query(f"WITH {_CALLS} SELECT tool_name, {_ROLLUP} FROM calls GROUP BY tool_name")
def tool_breakdown(spark, sf_dir):
    return telemetry.rollup(_calls(spark, sf_dir), "tool_name")


@_query(f"""WITH {_CALLS}, s AS (SELECT tool_name, CAST(sum(input_tokens_saved) AS BIGINT) AS i, CAST(sum(output_tokens_saved) AS BIGINT) AS o FROM calls GROUP BY 1), p AS (SELECT * FROM (VALUES ('claude_code', 3.0, 15.0), ('codex', 1.5, 6.0), ('amp', 1.5, 6.0)) v(competitor, pi, po))
 SELECT tool_name, i AS input_tokens_saved, o AS output_tokens_saved, competitor, CAST(round((i * CAST(pi AS DOUBLE) + o * CAST(po AS DOUBLE)) / 1e6, 12) AS DOUBLE) AS cost_avoided_usd FROM s, p""")
def competitor_costs(spark, sf_dir):
    return telemetry.competitor_costs(_calls(spark, sf_dir), "tool_name")


def _trend_sql(span: int, step: int) -> str:
    return f"""WITH {_CALLS}, b AS (SELECT CAST(unnest(generate_series(CAST(epoch(TIMESTAMP '{_NOW}') AS BIGINT) - {span} - (CAST(epoch(TIMESTAMP '{_NOW}') AS BIGINT) - {span}) % {step}, CAST(epoch(TIMESTAMP '{_NOW}') AS BIGINT) - 1, {step})) AS BIGINT) AS b),
 s AS (SELECT CAST(floor(epoch(captured_at) / {step}) AS BIGINT) * {step} AS b, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tt, CAST(sum(tokens_saved) AS BIGINT) AS ts FROM calls WHERE captured_at >= TIMESTAMP '{_NOW}' - INTERVAL {span} SECOND AND captured_at < TIMESTAMP '{_NOW}' GROUP BY 1)
 SELECT TIMESTAMP '1970-01-01 00:00:00' + to_seconds(b.b) AS bucket, coalesce(n, 0) AS call_count, coalesce(tt, 0) AS total_tokens, coalesce(ts, 0) AS tokens_saved FROM b LEFT JOIN s ON b.b = s.b"""


@_query(_trend_sql(86_400, 3_600))
def trend_last_24h(spark, sf_dir):
    return telemetry.trend(_calls(spark, sf_dir), "last_24h", _NOW)


@_query(_trend_sql(604_800, 86_400))
def trend_last_7d(spark, sf_dir):
    return telemetry.trend(_calls(spark, sf_dir), "last_7d", _NOW)


@_query(_trend_sql(2_592_000, 86_400))
def trend_last_30d(spark, sf_dir):
    return telemetry.trend(_calls(spark, sf_dir), "last_30d", _NOW)


@_query(f"""WITH {_CALLS} SELECT """ + ", ".join(f"count(*) FILTER (WHERE captured_at >= TIMESTAMP '{_NOW}' - INTERVAL {s} SECOND AND captured_at < TIMESTAMP '{_NOW}') AS {n}_calls, CAST(coalesce(sum(tokens_saved) FILTER (WHERE captured_at >= TIMESTAMP '{_NOW}' - INTERVAL {s} SECOND AND captured_at < TIMESTAMP '{_NOW}'), 0) AS BIGINT) AS {n}_tokens_saved" for n, (s, _) in telemetry.WINDOWS.items()) + " FROM calls")
def trend_windows(spark, sf_dir):
    return telemetry.trends(_calls(spark, sf_dir), _NOW)


@_query(f"""WITH {_CALLS}, d AS (SELECT CAST(captured_at AS DATE) AS day, CAST(sum(tokens_saved) % 5000 AS BIGINT) AS total FROM calls GROUP BY 1), l AS (SELECT day, total, lag(total) OVER (ORDER BY day) AS p FROM d)
 SELECT day, total, CASE WHEN p IS NULL OR total < p THEN total ELSE total - p END AS total_delta FROM l""")
def snapshot_delta(spark, sf_dir):
    daily = _calls(spark, sf_dir).groupBy(F.to_date("captured_at").alias("day")).agg((F.sum("tokens_saved") % 5000).alias("total"))
    return telemetry.snapshot_deltas(daily, ["total"], at="day")


@_query(f"WITH {_CALLS} SELECT tool_name, round(avg(duration_ms), 6) AS mean, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM calls GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return telemetry.latency(_calls(spark, sf_dir), "duration_ms", "tool_name")


@_query(f"WITH {_CALLS} SELECT tool_name, count(*) AS n FROM calls WHERE captured_at >= TIMESTAMP '{_NOW}' - INTERVAL 10 DAY GROUP BY 1")
def retention(spark, sf_dir):
    return telemetry.retain(_calls(spark, sf_dir), _NOW, 10).groupBy("tool_name").agg(F.count("*").alias("n"))


@_query(f"WITH {_CALLS} SELECT event_id, captured_at FROM calls ORDER BY captured_at DESC, event_id DESC LIMIT 2048")
def pending_buffer(spark, sf_dir):
    return telemetry.newest(_calls(spark, sf_dir)).select("event_id", "captured_at")


@_query(f"""WITH {_CALLS}, r AS (SELECT session, CAST(sum(total_tokens) AS BIGINT) AS bi, CAST(sum(response_tokens) AS BIGINT) AS bo, CAST(sum(request_tokens) AS BIGINT) AS ti, CAST(sum(total_tokens) AS BIGINT) AS tt FROM calls GROUP BY 1)
 SELECT session, bi + bo - ti - tt AS tokens_saved, CASE WHEN bi + bo <= 0 THEN 0.0 ELSE round((bi + bo - ti - tt) / (bi + bo), 6) END AS saved_ratio, round(((bi - ti) * 3.0::DOUBLE + (bo - tt) * 15.0::DOUBLE) / 1e6, 9) AS usd FROM r""")
def benchmark_delta(spark, sf_dir):
    runs = _calls(spark, sf_dir).groupBy("session").agg(F.sum("total_tokens").alias("baseline_in"), F.sum("response_tokens").alias("baseline_out"), F.sum("request_tokens").alias("tool_in"), F.sum("total_tokens").alias("tool_out"))
    return telemetry.benchmark_delta(runs).select("session", "tokens_saved", "saved_ratio", F.round("claude_code_usd", 9).alias("usd"))


# ---- streams -------------------------------------------------------------------------------------------------------


@_query("""WITH e AS (SELECT CAST(user_id % 10 AS INT) AS folder, ts, lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS p FROM events), s AS (SELECT folder, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
 SELECT folder, min(ts) AS batch_start, max(ts) + INTERVAL 1 HOUR AS batch_end, count(*) AS n_changes FROM s GROUP BY folder, g""")
def session_debounce(spark, sf_dir):
    return changes.debounce(t.changes(spark, sf_dir), "1 hour")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def tumbling_buckets(spark, sf_dir):
    return changes.buckets(t.table(spark, sf_dir, "events"))


@_query("""WITH RECURSIVE e AS (SELECT CAST(user_id % 10 AS INT) AS folder, CAST(user_id AS VARCHAR) AS path, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'added' ELSE 'deleted' END AS c,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f AS (SELECT folder, path, rn, c AS s FROM e WHERE rn = 1
 UNION ALL SELECT e.folder, e.path, e.rn, CASE WHEN f.s = 'added' AND e.c = 'deleted' THEN 'none' WHEN f.s = 'added' AND e.c = 'modified' THEN 'added' WHEN f.s = 'modified' AND e.c = 'added' THEN 'modified' WHEN f.s = 'deleted' AND e.c = 'added' THEN 'modified' WHEN f.s = 'deleted' AND e.c = 'modified' THEN 'deleted' ELSE e.c END FROM f JOIN e ON e.path = f.path AND e.rn = f.rn + 1)
 SELECT folder, path, s AS change_type FROM (SELECT *, max(rn) OVER (PARTITION BY path) AS m FROM f) WHERE rn = m AND s <> 'none'""")
def change_coalescing(spark, sf_dir):
    return changes.coalesce(t.changes(spark, sf_dir), "folder")


@_query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id % 10 AS INT) AS folder, CAST(user_id AS VARCHAR) AS path, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'added' ELSE 'deleted' END AS c,
  ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM e),
 n AS (SELECT *, row_number() OVER (PARTITION BY path, burst ORDER BY ts, event_id) AS rn FROM g), f AS (SELECT folder, path, burst, rn, c AS s FROM n WHERE rn = 1
 UNION ALL SELECT n.folder, n.path, n.burst, n.rn, CASE WHEN f.s = 'added' AND n.c = 'deleted' THEN 'none' WHEN f.s = 'added' AND n.c = 'modified' THEN 'added' WHEN f.s = 'modified' AND n.c = 'added' THEN 'modified' WHEN f.s = 'deleted' AND n.c = 'added' THEN 'modified' WHEN f.s = 'deleted' AND n.c = 'modified' THEN 'deleted' ELSE n.c END
  FROM f JOIN n ON n.path = f.path AND n.burst = f.burst AND n.rn = f.rn + 1), b AS (SELECT path, burst, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_changes FROM g GROUP BY 1, 2)
 SELECT folder, f.path, s AS change_type, first_at, last_at, n_changes FROM f JOIN b ON f.path = b.path AND f.burst = b.burst AND f.rn = b.n_changes WHERE s <> 'none'""")
def change_bursts(spark, sf_dir):
    """The batch twin of streaming.keyed.bursts."""
    return keyed.batch_bursts(t.changes(spark, sf_dir), 3600.0)


_TOTALS = """tool_name, CAST(sum(greatest(logical, 1)) AS BIGINT) AS call_count, CAST(sum(request_tokens) AS BIGINT) AS request_tokens, CAST(sum(response_tokens) AS BIGINT) AS response_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens_saved) AS BIGINT) AS input_tokens_saved,
 CAST(sum(output_tokens_saved) AS BIGINT) AS output_tokens_saved, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, min(captured_at) AS first_recorded_at"""


@_query(f"""WITH {_CALLS} SELECT {_TOTALS.replace("logical", "1")}, (SELECT count(DISTINCT session) FROM calls) AS session_count FROM calls GROUP BY tool_name""")
def cumulative_totals(spark, sf_dir):
    """A snapshot restored from the calls of some days, then later calls in two batches, the second of which comes twice."""
    calls = t.call_events(spark, sf_dir)
    third = F.pmod(F.unix_timestamp(F.col("captured_at").cast("timestamp")) / 86400, F.lit(3)).cast("int")
    own = cumulative.Cumulative(spark, scratch.folder(spark, "totals"))
    own.add(calls.where(third == 0), 0, "before")
    kept = cumulative.Cumulative(spark, own.path)  # as a new process finds it
    for batch in (0, 1, 1):
        kept.add(calls.where(third == batch + 1), batch)
    sessions = kept.snapshot().select("session_count")
    return kept.tools().select("tool_name", *cumulative.COUNTERS, F.col("first_recorded_at").cast("timestamp_ntz").alias("first_recorded_at")).crossJoin(F.broadcast(sessions))  # one row


@_query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes FROM conversations GROUP BY role")
def conversation_roles(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.octet_length("text")).cast("long").alias("size_bytes"))


# ---- more of discovery, imports, sources, evaluation ---------------------------------------------------------------


def _modules(spark, sf_dir) -> DataFrame:
    """Parts as Python modules that import each other."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("from pkg.m"), ((F.col("p_partkey") * 7) % 50).cast("string"), F.lit(" import n"), k, F.lit(" as x, other\nimport os.path as osp, pkg.m3\n# nothing\n"))
    return t.table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("path"), body.alias("content"), F.octet_length(body).cast("long").alias("size_bytes"))


@_query("""SELECT 'pkg/m' || p_partkey || '.py' AS source_file, 'pkg/m' || CAST((p_partkey * 7) % 50 AS VARCHAR) AS specifier, 'n' || p_partkey || ',other' AS names FROM part
 UNION ALL SELECT 'pkg/m' || p_partkey || '.py', 'os/path', 'osp' FROM part UNION ALL SELECT 'pkg/m' || p_partkey || '.py', 'pkg/m3', 'm3' FROM part""")
def import_extraction(spark, sf_dir):
    found = graph.extract_imports(_modules(spark, sf_dir))
    return found.select("source_file", "specifier", F.array_join("names", ",").alias("names"))


@_query("""WITH i AS (SELECT 'pkg/m' || p_partkey || '.py' AS source_file, 'pkg/m' || CAST((p_partkey * 7) % 50 AS VARCHAR) AS specifier FROM part UNION ALL SELECT 'pkg/m' || p_partkey || '.py', 'os/path' FROM part UNION ALL SELECT 'pkg/m' || p_partkey || '.py', 'pkg/m3' FROM part)
 SELECT i.source_file, i.specifier, 'pkg/m' || p.p_partkey || '.py' AS resolved FROM i LEFT JOIN part p ON i.specifier = 'pkg/m' || p.p_partkey""")
def import_resolution(spark, sf_dir):
    files = _modules(spark, sf_dir)
    return graph.resolve_imports(graph.extract_imports(files), files).select("source_file", "specifier", "resolved")


@_query("""SELECT 'n5' AS identifier, 'pkg/m5.py' AS file, 'pkg/m' || CAST((5 * 7) % 50 AS VARCHAR) AS specifier, 'named' AS match_type
 UNION ALL SELECT 'm3', 'pkg/m' || p_partkey || '.py', 'pkg/m3', 'named' FROM part""")
def find_references(spark, sf_dir):
    return graph.references(graph.extract_imports(_modules(spark, sf_dir)), ["n5", "m3"])


@_query(f"""WITH {_FILES}, {_BINARY}, k AS (SELECT unnest(['skip_dir','symlink','symlink_escape','path_traversal','skip_file','gitignore','extra_ignore','secret','wrong_extension','too_large','unreadable','binary','file_limit']) AS skip_reason),
 f AS (SELECT CASE WHEN path LIKE 'src3/%' THEN 'gitignore' WHEN size_bytes > 512000 THEN 'too_large' WHEN bin THEN 'binary' END AS r FROM judged) SELECT k.skip_reason, (SELECT count(*) FROM f WHERE f.r = k.skip_reason) AS n FROM k""")
def skip_counts(spark, sf_dir):
    return catalog.skip_counts(catalog.discover(t.files(spark, sf_dir), ignore=["src3/"]))


@_query(f"""WITH {_FILES}, {_BINARY}, f AS (SELECT path, CASE WHEN size_bytes > 512000 THEN 'too_large' WHEN bin THEN 'binary' END AS r FROM judged), n AS (SELECT path, r, row_number() OVER (PARTITION BY r IS NULL ORDER BY path) AS rn FROM f)
 SELECT path, CASE WHEN r IS NULL AND rn > 100 THEN 'file_limit' ELSE r END AS skip_reason FROM n""")
def file_cap(spark, sf_dir):
    return catalog.discover(t.files(spark, sf_dir), cap=100).select("path", "skip_reason")


@_query(f"""WITH {_FILES}, r AS (SELECT DISTINCT string_split(path, '/')[1] AS root FROM files UNION ALL SELECT DISTINCT string_split(path, '/')[1] || '/en' FROM files WHERE path LIKE '%/en/%')
 SELECT path, root, 'repo:' || root AS repo FROM (SELECT f.path, r.root, row_number() OVER (PARTITION BY f.path ORDER BY length(r.root) DESC) AS rn FROM files f JOIN r ON starts_with(f.path, r.root || '/')) WHERE rn = 1""")
def longest_root(spark, sf_dir):
    f = t.files(spark, sf_dir)
    top = F.split_part("path", F.lit("/"), F.lit(1))
    roots = f.select(top.alias("root")).distinct().unionByName(f.where("path like '%/en/%'").select(F.concat(top, F.lit("/en")).alias("root")).distinct())
    return catalog.latest_per_root(f, roots.withColumn("repo", F.concat(F.lit("repo:"), "root")))


@_query(f"""WITH {_FILES}, {_SYMBOLS}, x AS (SELECT path, string_split(content, chr(10)) AS p, CAST(regexp_extract(path, '/doc_(\\d+)\\.', 1) AS BIGINT) AS k FROM files), j AS (SELECT s.id, s.name, x.path, s.line, x.p FROM symbols s JOIN x ON CAST(s.id AS BIGINT) % (SELECT count(*) FROM files) = x.k)
 SELECT id, name, path, CAST(greatest(least(line, len(p)), 1) AS INT) AS start_line, CAST(greatest(least(line + 3, len(p)), 1) AS INT) AS end_line, array_to_string(p[greatest(least(line, len(p)), 1):greatest(least(line + 3, len(p)), 1)], chr(10)) AS source FROM j""")
def symbol_source(spark, sf_dir):
    """Every symbol, in the file of the document whose id is the symbol's modulo the number of documents."""
    f = t.files(spark, sf_dir)
    number = F.regexp_extract("path", r"/doc_(\d+)\.[a-z]+$", 1).cast("long")
    n = f.agg(F.count("*").alias("n"))  # one row
    s = t.symbols(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("k", F.col("id").cast("long") % F.col("n"))
    s = s.join(f.select("path", number.alias("k")), "k").withColumn("file", F.col("path")).drop("path", "k", "n")
    return chunks.symbol_source(s, f, None).select("id", "name", "path", "start_line", "end_line", "source")


@_query("""WITH j AS (SELECT CAST(doc_id AS BIGINT) * 2 AS id, quality FROM labels) SELECT 'blank_document' AS fault, count(*) FILTER (WHERE text IS NULL OR trim(text) = '' OR doc_id IS NULL) AS n FROM documents UNION ALL SELECT 'repeated_document', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'unknown_document', count(*) FROM j WHERE id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unknown_query', 0 UNION ALL SELECT 'relevance_range', count(*) FROM j WHERE quality IS NULL OR quality NOT BETWEEN 0 AND 3 UNION ALL SELECT 'query_without_judgment', CAST(1 AS BIGINT)""")
def fixture_faults(spark, sf_dir):
    """All documents, and judgments of twice the labels' ids, so that some are of no document."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    judged = t.table(spark, sf_dir, "labels").select(F.lit("q").alias("query_id"), (F.col("doc_id").cast("long") * 2).alias("id"), F.col("quality").alias("relevance"))
    queries = spark.range(2).select(F.when(F.col("id") == 0, "q").otherwise("none").alias("query_id"))
    return evaluation.fixture_faults(docs, queries, judged)


@_query(f"""WITH {_FILES}, c AS (SELECT string_split(path, '/')[1] AS case_id, path, content FROM files) SELECT case_id, CAST(sum(ceil(strlen(content) / 4)) AS BIGINT) AS baseline_tokens, CAST(sum(ceil((strlen(path) + 1) / 4)) AS BIGINT) AS tool_tokens,
  CAST(sum(ceil(strlen(content) / 4)) - sum(ceil((strlen(path) + 1) / 4)) AS BIGINT) AS tokens_saved, round((sum(ceil(strlen(content) / 4)) - sum(ceil((strlen(path) + 1) / 4))) / sum(ceil(strlen(content) / 4)), 6) AS saved_ratio FROM c GROUP BY 1""")
def token_savings(spark, sf_dir):
    """Listing each top folder against reading its files."""
    f = t.files(spark, sf_dir)
    cases = f.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("case_id"), "path")
    return evaluation.token_savings(cases, f, cases.select("case_id", F.concat("path", F.lit("\n")).alias("payload")))


_RUNS = "SELECT event_type, user_id % 2 AS mode, 1 AS items, abs(value) + 1 AS ms, event_id % 50 = 0 AS failed FROM events"


@_query(f"SELECT event_type, round(sum(items) / (sum(ms) / 1000), 6) AS items_per_s, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(avg(CAST(failed AS INT)), 6) AS error_rate FROM ({_RUNS}) GROUP BY 1")
def slo_metrics(spark, sf_dir):
    return evaluation.throughput(_runs(spark, sf_dir), "event_type")


def _runs(spark, sf_dir) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    return e.select("event_type", (F.col("user_id") % 2).alias("mode"), F.lit(1).alias("items"), (F.abs("value") + 1).alias("ms"), (F.col("event_id") % 50 == 0).alias("failed"))


@_query(f"""WITH r AS ({_RUNS}), m AS (SELECT event_type, mode, round(sum(items) / (sum(ms) / 1000), 6) AS t, round(quantile_cont(ms, 0.95), 6) AS p, round(avg(CAST(failed AS INT)), 6) AS e FROM r GROUP BY 1, 2),
 x AS (SELECT a.event_type, round(a.t / b.t, 6) AS throughput_ratio, round(a.p / b.p, 6) AS p95_ratio, round(a.e - b.e, 6) AS error_delta FROM m a JOIN m b ON a.event_type = b.event_type WHERE a.mode = 1 AND b.mode = 0) SELECT *, throughput_ratio >= 1.10 AND p95_ratio <= 1.25 AND error_delta <= 0 AS passed FROM x""")
def slo_baseline(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return evaluation.against_baseline(evaluation.throughput(r.where("mode = 1"), "event_type"), evaluation.throughput(r.where("mode = 0"), "event_type"), "event_type")


@_query("SELECT user_id AS run_id, max(value) AS v, CASE WHEN user_id % 4 = 0 THEN 'new' ELSE 'stored' END AS origin FROM events GROUP BY 1")
def benchmark_runs_upsert(spark, sf_dir):
    runs = t.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("value").alias("v"))
    return evaluation.combine_runs(runs.withColumn("origin", F.lit("stored")), runs.where("run_id % 4 = 0").withColumn("origin", F.lit("new")))


_ODD_NAMES = ["api_key.txt", "token.py", "secret-santa.md", "my_secret_password.md", "plain.py", ".env.local", "id_rsa.pub"]


@_query(f"""WITH {_FILES}, k AS (SELECT path || '/' || {_ODD_NAMES}[CAST(size_bytes % 7 AS INT) + 1] AS path, size_bytes % 7 IN (0, 1, 5, 6) AS likely_secret FROM files) SELECT * FROM k""")
def secret_paths(spark, sf_dir):
    """Every file, as the folder of one whose name may hint at a secret."""
    name = F.element_at(F.array(*[F.lit(n) for n in _ODD_NAMES]), (F.col("size_bytes") % 7 + 1).cast("int"))
    return t.files(spark, sf_dir).select(F.concat("path", F.lit("/"), name).alias("path")).select("path", catalog.likely_secret(F.col("path")).alias("likely_secret"))
