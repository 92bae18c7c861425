"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.llm import sharding


def op1_sharding() -> str:
    """The lookup table goes in as text, three digits a slot; the placement is SQL."""
    size = sharding.TABLE_SIZE
    table = "".join(f"{i:03d}" for i in sharding.lookup_table(sharding.shard_names(), size))
    return f"""
        WITH placed AS (
            SELECT doc_id,
                   CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot
            FROM documents)
        SELECT doc_id, slot, 'shard-' || substr((SELECT '{table}'), slot * 3 + 1, 3) AS shard
        FROM placed"""


OP4_WARC = """
    WITH payloads AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages),
    firsts AS (
        SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
        FROM payloads)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM firsts"""

OP5_LINE_DEDUP = """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    firsts AS (
        SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (
        SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""


OP7_JACCARD = r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
        FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT x, y, m = sx.n AND m = sy.n AS equal FROM common JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
        WHERE 9 * m >= 4 * (sx.n + sy.n)
        UNION ALL
        SELECT a.doc_id, b.doc_id, true FROM worded a JOIN worded b ON a.doc_id <> b.doc_id AND len(a.w) = 0 AND len(b.w) = 0),
    reach AS (
        SELECT doc_id, doc_id AS root FROM documents
        UNION
        SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.doc_id),
    roots AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
    counted AS (SELECT x, count(*) AS n, min(CASE WHEN equal THEN y END) AS copy FROM links GROUP BY x)
    SELECT r.doc_id, least(r.doc_id, coalesce(c.copy, r.doc_id)) AS copy_id, r.class_id, coalesce(c.n, 0) AS n_links
    FROM roots r LEFT JOIN counted c ON c.x = r.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1_sharding(), "op4_warc_zstd": OP4_WARC, "op5_line_dedup": OP5_LINE_DEDUP, "op7_jaccard_forest": OP7_JACCARD}
