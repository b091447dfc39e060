"""The numbered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.llm.decontaminate import contamination_report
from boxquarry.llm.exact_dedup import exact_groups
from boxquarry.llm.fill_middle import fill_in_middle, restore
from boxquarry.llm.hard_negatives import mine_negatives
from boxquarry.llm.language_id import identify_languages
from boxquarry.llm.license_scan import license_report
from boxquarry.llm.line_dedup import line_components
from boxquarry.llm.lm_scoring import score_texts
from boxquarry.llm.minhash_dedup import minhash_components
from boxquarry.llm.packing import pack
from boxquarry.llm.quality import quality_scores
from boxquarry.llm.url_filter import judge_urls
from boxquarry.llm.warc import archive_pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_read(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(_read(spark, sf_dir, "documents"))


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(_read(spark, sf_dir, "documents"), _remainder(3) != 1)
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), _remainder(4) != 2)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(_read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(_read(spark, sf_dir, "documents"), _remainder(7) != 2)
    return found.select("doc_id", F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, size AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to,
  CASE WHEN size >= 100 AND page_id <> first THEN 0 ELSE size END AS stored_bytes, TRUE AS intact
FROM f
"""

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM v),
sizes AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON g.k = p.k AND g.win = array_to_string(p.ws[p.i:p.i + p.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = d.doc_id
"""

OP9_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '\A([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '\A[^/?#]*([^?#]*)', 1) AS path FROM u),
r(name, start, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT page_id, arg_max(name || start, (length(name || start), name)) AS rule, arg_max(verdict, (length(name || start), name)) AS verdict
  FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id),
t AS (SELECT h.*, rule, verdict, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS segs FROM h LEFT JOIN f USING (page_id)),
tree AS (SELECT host, segs, count(*) AS n, count(*) FILTER (verdict = 'block') AS b, count(verdict) AS l FROM t GROUP BY ALL),
br AS (SELECT host, segs, n, b, l, k, segs[1:k - 1] AS parent, segs[k] AS seg FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS k FROM tree)),
c AS (SELECT host, parent, seg, sum(n) AS n, sum(b) AS b, sum(l) AS l FROM br GROUP BY ALL),
a AS (SELECT *, count(*) OVER w AS kids, sum(n) OVER w AS an, sum(b) OVER w AS ab, sum(l) OVER w AS al FROM c WINDOW w AS (PARTITION BY host, parent)),
nm AS (SELECT host, parent, seg, CASE WHEN contains(seg, '#') OR (kids > 20 AND n < 0.1::DOUBLE * an) OR (l >= 5 AND al - l >= 5
   AND abs((b + 0.5::DOUBLE) / (l + 1) - (ab - b + 0.5::DOUBLE) / (al - l + 1)) < 2.0::DOUBLE * sqrt((ab + 1.0::DOUBLE) / (al + 2.0::DOUBLE) * (1 - (ab + 1.0::DOUBLE) / (al + 2.0::DOUBLE)) * (1.0::DOUBLE / (l + 1) + 1.0::DOUBLE / (al - l + 1))))
  THEN '*' ELSE seg END AS name FROM a),
tp AS (SELECT br.host, segs, '/' || string_agg(name, '/' ORDER BY k) AS template FROM br JOIN nm ON nm.host = br.host AND nm.parent = br.parent AND nm.seg = br.seg GROUP BY ALL),
x AS (SELECT tree.*, coalesce(template, '') AS template FROM tree LEFT JOIN tp ON tp.host = tree.host AND tp.segs = tree.segs),
q AS (SELECT host, template, (sum(b) + 1.0::DOUBLE) / (sum(l) + 2.0::DOUBLE) AS purity FROM x GROUP BY ALL)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.verdict, CASE WHEN purity >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict, t.host || x.template AS template, purity
FROM t JOIN x ON x.host = t.host AND x.segs = t.segs JOIN q ON q.host = x.host AND q.template = x.template
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda p: ('0x' || substr(h, p, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, a.label AS kind, b.vec_id AS other, b.label, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE label = kind QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, row_number() OVER w AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND s.label <> p.kind AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) QUALIFY rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_bundles": op1_warc_bundles,
        "op2_line_dedup": op2_line_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_language_id": op6_language_id,
        "op7_license_scan": op7_license_scan,
        "op8_packing": op8_packing,
        "op9_url_filter": op9_url_filter,
        "op10_quality": op10_quality,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op9_url_filter": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op13_hard_negatives": OP13_SQL}
