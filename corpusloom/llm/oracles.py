"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .suffix import LENGTH, PASSAGE_LENGTH, PASSAGE_WORDS

_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
 p AS (SELECT item, least(13, len(w)) AS m, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0), pats AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS t FROM p),
 ms AS (SELECT DISTINCT m FROM pats), dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM d, ms WHERE len(w) >= m), win AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS t FROM dw),
 hits AS (SELECT win.doc_id, win.k, win.m, pats.item FROM win JOIN pats ON win.t = pats.t AND win.m = pats.m), marked AS (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS at FROM hits),
 n AS (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY 1), i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
 FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""



def _repeats(name: str, length: int) -> str:
    """name: the runs (doc_id, a, z) of bytes in strings of that length that are there twice or more."""
    return f"""{name}_w AS (SELECT doc_id, k, md5(substring(h, 2 * k + 1, {2 * length})) AS t FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS k FROM d WHERE n >= {length})),
 {name}_r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY t) AS c FROM {name}_w) WHERE c > 1),
 {name}_g AS (SELECT doc_id, k, sum(CASE WHEN p IS NULL OR k > p + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM {name}_r)),
 {name} AS (SELECT doc_id, min(k) AS a, max(k) + {length} AS z FROM {name}_g GROUP BY doc_id, g)"""


_BLANK = "('20', '09', '0A', '0B', '0C', '0D')"

SUFFIX = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents), {_repeats("s", LENGTH)}, {_repeats("ps", PASSAGE_LENGTH)},
 o AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM s),
 c AS (SELECT o.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS z, string_agg(substring(d.h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM o JOIN d ON o.doc_id = d.doc_id GROUP BY 1),
 x AS (SELECT ps.doc_id, z - a AS size, substring(d.h, 2 * a + 1, 2 * (z - a)) AS x FROM ps JOIN d ON ps.doc_id = d.doc_id),
 y AS (SELECT doc_id, size, len(list_filter(range(0, size), lambda k: substring(x, 2 * k + 1, 2) NOT IN {_BLANK} AND (k = 0 OR substring(x, 2 * k - 1, 2) IN {_BLANK}))) AS words FROM x),
 v AS (SELECT doc_id, count(*) AS n_passages, CAST(sum(size) AS BIGINT) AS passage_bytes FROM y WHERE words >= {PASSAGE_WORDS} GROUP BY 1)
 SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.h ELSE head || substring(d.h, 2 * c.z + 1) END)) AS kept_sha256,
  coalesce(n_passages, 0) AS n_passages, coalesce(passage_bytes, 0) AS passage_bytes, coalesce(n_passages, 0) > 0 AS has_passage FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN v ON d.doc_id = v.doc_id"""

_DIGIT = "(instr('0123456789abcdef', substring(s, 5 * k + {0}, 1)) - 1)"
_FIVE = " + ".join(f"{_DIGIT.format(j + 1)} * {16 ** (4 - j)}" for j in range(5))
_LETTERS = " || ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_FIVE}) // {1 << s}) % 32 AS INT) + 1, 1)" for s in (15, 10, 5, 0))

#: record_bytes is the exact length of the record: its headers are rebuilt here.
WARC = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p),
 l AS (SELECT *, unnest(range(0, 8)) AS k FROM q), x AS (SELECT page_id, string_agg({_LETTERS}, '' ORDER BY k) AS b32 FROM l GROUP BY 1),
 t AS (SELECT q.*, x.b32, strlen('HTTP/1.1 200 OK..Content-Type: text/html; charset=UTF-8..Content-Length: ' || CAST(n AS VARCHAR) || '....') AS http FROM q JOIN x ON q.page_id = x.page_id)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to,
  CAST(strlen('WARC/1.1..WARC-Type: ..WARC-Record-ID: <urn:page:>..WARC-Date: 2024-01-01T00:00:00Z..WARC-Target-URI: ..WARC-Payload-Digest: sha1:..Content-Type: application/http; msgtype=response..Content-Length: ....')
   + strlen(CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END) + strlen(CAST(page_id AS VARCHAR)) + strlen(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A')) + 32
   + CASE WHEN page_id = owner THEN 0 ELSE strlen('WARC-Refers-To: <urn:page:>..WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest..') + strlen(CAST(owner AS VARCHAR)) END
   + strlen(CAST(http + CASE WHEN page_id = owner THEN n ELSE 0 END AS VARCHAR)) + http + CASE WHEN page_id = owner THEN n ELSE 0 END + 4 AS BIGINT) AS record_bytes FROM t"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    """Every rule against every page; the longest that fits decides."""
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return f"""WITH p AS (SELECT page_id, url, row_number() OVER () AS k, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 m AS (SELECT k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS rn
  FROM p JOIN (VALUES {values}) r(host, path, verdict) ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
 SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.k = m.k AND rn = 1"""
