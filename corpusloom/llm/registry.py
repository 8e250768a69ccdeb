"""The subpackage's queries and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.ann import neighbour_digest
from corpusloom.llm.bpe import default_ranks, token_digest
from corpusloom.llm.conversations import repair_digest
from corpusloom.llm.decontaminate import leak_digest
from corpusloom.llm.html_extract import extract
from corpusloom.llm.line_dedup import line_digest
from corpusloom.llm.media import media_digest
from corpusloom.llm.sharding import shard_digest
from corpusloom.llm.shared import table
from corpusloom.llm.simhash_dedup import near_digest
from corpusloom.llm.toxicity import toxicity_digest
from corpusloom.llm.url_filter import verdict_digest
from corpusloom.llm.warc import archive_digest
from corpusloom.llm.whitening import whiten_digest


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_ranks()
    return token_digest(table(spark, sf_dir, "documents"), path=path, pattern=pattern)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_digest(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_digest(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_digest(table(spark, sf_dir, "embeddings"))


def op12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_byte_bpe, op3_toxicity, op4_html_extract, op5_warc, op6_url_filter, op7_sharding, op8_ann, op9_simhash_dedup, op10_decontaminate, op11_whitening, op12_media, op13_repair)
}

LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 held AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
 m AS (SELECT k.doc_id, k.line, k.pos, held.keep IS NOT NULL AND held.keep <> k.doc_id AS gone FROM k LEFT JOIN held ON held.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"

WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
 h AS (SELECT page_id, url, keep, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to, url FROM h
"""

#: Every window with any shingle of the item is compared, and every run of a short item's length; no fingerprints.
LEAKS_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
 b AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
 ds AS MATERIALIZED (SELECT doc_id, m, unnest(s) AS g, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, len(w) - 4 AS m, list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM d WHERE len(w) >= 5)),
 bs AS MATERIALIZED (SELECT item_id, n, n - 4 AS width, unnest(s) AS g FROM (SELECT item_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM b WHERE len(w) >= 5)),
 bc AS MATERIALIZED (SELECT item_id, n, width, g, count(*) AS c FROM bs GROUP BY ALL),
 win AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, n, width, unnest(range(greatest(0, pos - width + 1), least(pos, greatest(0, m - width)) + 1)) AS start FROM ds JOIN bc ON bc.g = ds.g),
 ww AS (SELECT win.doc_id, win.item_id, win.n, win.width, win.start, ds.g, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos >= win.start AND ds.pos < win.start + win.width GROUP BY ALL),
 sim AS (SELECT ww.doc_id, ww.item_id, ww.n, ww.width, ww.start, sum(ww.c) AS total, sum(CASE WHEN bc.c IS NULL THEN 0 ELSE least(ww.c, bc.c) END) AS m FROM ww LEFT JOIN bc ON bc.item_id = ww.item_id AND bc.g = ww.g GROUP BY ALL),
 runs AS (SELECT d.doc_id, b.item_id, len(b.w) AS n, d.w AS dw, b.w AS bw, unnest(range(1, len(d.w) - len(b.w) + 2)) AS i FROM d JOIN b ON len(b.w) BETWEEN 1 AND 4),
 r AS (SELECT doc_id, item_id, n, start, m / (total + width - m) AS s FROM sim UNION ALL SELECT doc_id, item_id, n, i - 1, 1.0 FROM runs WHERE list_slice(dw, i, i + n - 1) = bw)
SELECT doc_id, item_id, round(s, 6) AS similarity, start::BIGINT AS window_start, n::BIGINT AS window_words FROM r WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, start) = 1
"""

#: CRC-32 of a text of ASCII characters, bit by bit.
CRC32 = "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(@, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"

#: The grammar's states are 0 to 3; turns inserted before a row lead from one to another, and each row is deleted, kept or reroled.
REPAIR_SQL = rf"""
WITH RECURSIVE k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.replace('@', "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
 damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
 placed AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, NOT regexp_matches(text, '[^ 	-]') AS blank, NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut FROM damaged),
 r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before, coalesce(conv_id, -1) AS c FROM placed),
 inserts(state, mid, made) AS (VALUES (0, 0, []::VARCHAR[]), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']), (1, 1, []), (1, 2, ['user:']), (1, 3, ['user:', 'assistant:']), (2, 2, []), (2, 3, ['assistant:']), (3, 3, []), (3, 2, ['user:'])),
 keeps(mid, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
 moves AS MATERIALIZED (SELECT state, mid AS next, made, 'D' AS edit, 2 AS cost, NULL AS initial FROM inserts UNION ALL SELECT state, next, made, 'K', 0, initial FROM inserts JOIN keeps USING (mid) UNION ALL SELECT state, next, made, 'R', 1, initial FROM inserts JOIN keeps USING (mid) WHERE initial <> 's'),
 walked(c, pos, state, best) AS (SELECT DISTINCT c, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]}} FROM r
  UNION ALL SELECT w.c, w.pos + 1, m.next, min({{'cost': w.best.cost + 5 * len(m.made) + m.cost + CASE WHEN m.edit <> 'D' AND r.cut THEN 5 ELSE 0 END, 'audit': w.best.audit || repeat('I', len(m.made)) || m.edit,
   'rows': list_concat(w.best.rows, m.made, CASE m.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END)}})
  FROM walked w JOIN r ON r.c = w.c AND r.pos = w.pos + 1 JOIN moves m ON m.state = w.state AND (m.edit = 'D' OR NOT (r.blank OR r.again)) AND (m.edit <> 'K' OR m.initial = r.initial) GROUP BY ALL),
 ended AS (SELECT w.c, min({{'cost': w.best.cost + 5 * len(i.made), 'audit': w.best.audit || repeat('I', len(i.made)), 'rows': list_concat(w.best.rows, i.made)}}) AS best FROM walked w JOIN (SELECT c, max(pos) AS pos FROM r GROUP BY c) e ON e.c = w.c AND e.pos = w.pos JOIN inserts i ON i.state = w.state AND i.mid IN (0, 3) GROUP BY w.c),
 counted AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM k) k LEFT JOIN counted ON counted.c = coalesce(k.conv_id, -1) LEFT JOIN ended ON ended.c = coalesce(k.conv_id, -1)
"""

#: The others are tested against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINES_SQL, "op5_warc": WARC_SQL, "op10_decontaminate": LEAKS_SQL, "op13_repair": REPAIR_SQL}
