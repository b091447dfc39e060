"""Queries over names, paths, documents and events, and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.functions import text as tx
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import with_ctes
from boxquarry.plans.registry import query
from boxquarry.sources import readers, writers
from boxquarry.sources.scratch import scratch_path

_BASE = with_ctes("classes", "images", "gt", "preds")


@query("a6_label_files", f"{_BASE} SELECT image % 64 AS folder, count(*) AS lines, max(label_lines) AS last_line, sum(class_id)::BIGINT AS classes, sum(x1 + x2)::BIGINT AS cx, sum(y2 - y1)::BIGINT AS h FROM gt JOIN (SELECT image % 64 AS f, count(*) - 1 AS label_lines FROM gt GROUP BY 1) n ON n.f = image % 64 GROUP BY 1")
def a6_label_files(spark: SparkSession, d: str) -> DataFrame:
    """All labels, written as label files of 64 folders and read back."""
    b = a.gt_boxes(spark, d)
    line = g.label_line(F.col("class_id"), g.box(), F.lit(4000), F.lit(4000))
    path = scratch_path(spark, "labels")
    writers.write_label_lines(b.select((F.col("image") % 64).alias("folder"), F.struct("image", "label_index").alias("line_no"), line.alias("line")), path, "folder")
    back = readers.parse_labels(readers.label_files(spark, f"{path}/*/*.txt"), 13, mode="strict").where("problem is null")
    folder = F.regexp_extract("file", r"folder=(\d+)", 1).cast("long")
    return back.groupBy(folder.alias("folder")).agg(F.count("*").alias("lines"), F.max("line_no").cast("long").alias("last_line"), F.sum("class_id").alias("classes"), F.sum(F.round(F.col("values")[0] * 8000).cast("long")).alias("cx"), F.sum(F.round(F.col("values")[3] * 4000).cast("long")).alias("h"))


@query("a7_label_issues", "WITH l AS (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN '3 0.5 0.5 0.1' WHEN 1 THEN 'x 0.5 0.5 0.1 0.1' WHEN 2 THEN '20 0.5 0.5 0.1 0.1' WHEN 3 THEN '2 0.5 oops 0.1 0.1' WHEN 4 THEN '2 0.5 1.5 0.1 0.1' ELSE '2 0.5 0.5 0.1 0.1' END AS line FROM events) SELECT CASE event_id % 6 WHEN 0 THEN 'wrong_number_of_fields' WHEN 1 THEN 'class_is_no_number' WHEN 2 THEN 'class_out_of_range' WHEN 3 THEN 'value_is_no_number' WHEN 4 THEN 'value_out_of_range' END AS problem, count(*) AS lines FROM l GROUP BY 1")
def a7_label_issues(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 6
    line = F.when(kind == 0, "3 0.5 0.5 0.1").when(kind == 1, "x 0.5 0.5 0.1 0.1").when(kind == 2, "20 0.5 0.5 0.1 0.1").when(kind == 3, "2 0.5 oops 0.1 0.1").when(kind == 4, "2 0.5 1.5 0.1 0.1").otherwise("2 0.5 0.5 0.1 0.1")
    lines = a.table(spark, d, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), line.alias("value"))
    return readers.parse_labels(lines, 13).groupBy("problem").agg(F.count("*").alias("lines"))


@query("a11_manifest", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def a11_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    writers.write_manifest(a.table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), path)
    return readers.manifest(spark, path, ["p_partkey", "p_brand"])


@query("a12_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def a12_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    rows = a.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    writers.write_json_lines(rows, path)
    return readers.json_lines(spark, path, rows.schema)


@query("a3_image_list", "SELECT url AS image, count(*) AS exposures FROM pages WHERE page_id % 3 <> 0 GROUP BY url")
def a3_image_list(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "list")
    urls = a.table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "url")).otherwise(F.col("url")).alias("image"))
    writers.write_list(urls, path)
    return readers.image_list(spark, path).groupBy("image").agg(F.count("*").alias("exposures"))


@query("j1_labels_path", "SELECT page_id, 'data/' || 'labels/' || split_part(url, '/', 3) || '/images/' || page_id || '.txt' AS first, 'data/images/' || split_part(url, '/', 3) || '/labels/' || page_id || '.txt' AS last FROM pages")
def j1_labels_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("data/images/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/images/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return a.table(spark, d, "pages").select("page_id", tx.labels_path(path).alias("first"), tx.labels_path(path, "last").alias("last"))


@query("j2_source_groups", "WITH r AS (SELECT lower(replace(p_name, ' ', '_')) AS n FROM part) SELECT CASE WHEN starts_with(n, 'part_1') THEN 'ones' WHEN starts_with(n, 'part_2') THEN 'twos' ELSE split_part(n, '_', 1) END AS source_group, count(*) AS n FROM r GROUP BY 1")
def j2_source_groups(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))
    return a.table(spark, d, "part").groupBy(tx.source_group(name, [("part_1", "ones"), ("part_2", "twos")]).alias("source_group")).agg(F.count("*").alias("n"))


@query("j4_canonical_base", r"WITH p AS (SELECT page_id, 'set/images/' || upper(split_part(url, '/', 4)) || '_' || page_id // 2 || '.rf.' || md5(url) || '.jpg' AS path FROM pages) SELECT regexp_replace(regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '\.[^.]*$', ''), '\.rf\.[0-9a-f]+$', '') AS base, count(*) AS variants FROM p GROUP BY 1")
def j4_canonical_base(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("set/images/"), F.upper(F.split_part("url", F.lit("/"), F.lit(4))), F.lit("_"), F.floor(F.col("page_id") / 2).cast("string"), F.lit(".rf."), F.md5("url"), F.lit(".jpg"))
    return a.table(spark, d, "pages").groupBy(tx.canonical_base(path).alias("base")).agg(F.count("*").alias("variants"))


@query("j6_slugs", "WITH p AS (SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM pages) SELECT page_id, CASE WHEN length(s) <= 40 THEN s ELSE s[1:31] || '_' || sha1(s)[1:8] END AS slug FROM p")
def j6_slugs(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("j8_split_values", "SELECT doc_id, len(list_filter(list_transform(string_split(text, ';'), lambda v: trim(v, ' ')), lambda v: v <> '')) AS n FROM documents")
def j8_split_values(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "documents").select("doc_id", F.size(tx.split_values(F.col("text"))).cast("long").alias("n"))


@query("j11_json_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.plan'), 'none') AS v FROM events")
def j11_json_paths(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.plan"), F.lit("none")).alias("v"))


@query("j13_row_fingerprint", "SELECT conv_id, sha256(string_agg(turn || '|' || role, chr(10) ORDER BY turn, role)) AS fingerprint FROM conversations GROUP BY conv_id")
def j13_row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "conversations").withColumn("row", F.concat_ws("|", F.col("turn").cast("string"), "role"))
    return rows.groupBy("conv_id").agg(tx.fingerprint(["turn", "role"], "row").alias("fingerprint"))


@query("j15_stable_key", "SELECT o_orderkey, sha256('seed|' || o_orderkey || '|' || o_custkey)[1:16] AS key FROM orders")
def j15_stable_key(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "orders").select("o_orderkey", tx.stable_key(F.lit("seed"), F.col("o_orderkey"), F.col("o_custkey")).alias("key"))


@query("j17_compact_counter", f"{_BASE}, n AS (SELECT image, class_id, count(*) AS n FROM gt GROUP BY ALL) SELECT image, string_agg(class_id || '=' || n, ';' ORDER BY class_id::VARCHAR) AS counter FROM n GROUP BY image")
def j17_compact_counter(spark: SparkSession, d: str) -> DataFrame:
    n = a.gt_boxes(spark, d).groupBy("image", "class_id").agg(F.count("*").alias("n"))
    return n.groupBy("image").agg(tx.compact_counter(F.col("class_id"), F.col("n")).alias("counter"))


@query("e17_exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS group_size, count(DISTINCT source) > 1 AS cross_source, count(DISTINCT lang) > 1 AS cross_lang FROM documents GROUP BY 1 HAVING count(*) > 1")
def e17_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    k = a.table(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "source", "lang")
    wide = k.groupBy("hash").agg(F.count("*").alias("group_size"), F.min("source").alias("s0"), F.max("source").alias("s1"), F.min("lang").alias("l0"), F.max("lang").alias("l1"))
    return wide.where("group_size > 1").select("hash", "group_size", (F.col("s0") != F.col("s1")).alias("cross_source"), (F.col("l0") != F.col("l1")).alias("cross_lang"))




@query("c2_regex_stages", "WITH r AS (SELECT url, regexp_matches(url, 'example') AS req, regexp_matches(url, 'casino|/de/') AS blk FROM pages) SELECT count(*) AS before, count(*) FILTER (req) AS after_require, count(*) FILTER (req AND NOT blk) AS after_block FROM r")
def c2_regex_stages(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after each stage, counted in one pass."""
    r = a.table(spark, d, "pages").select(F.col("url").rlike("example").alias("req"), F.col("url").rlike("casino|/de/").alias("blk"))
    return r.agg(F.count("*").alias("before"), F.count_if("req").alias("after_require"), F.count_if(F.col("req") & ~F.col("blk")).alias("after_block"))


@query("e24_requirements", "WITH q(id, col, val, need) AS (VALUES ('a', 'lang', 'en', 100), ('b', 'source', 'src3', 60), ('c', 'lang', 'xx', 1)), u AS (SELECT doc_id, 'lang' AS col, lang AS val FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) SELECT id, need, count(doc_id) AS found, count(doc_id) >= need AS met FROM q LEFT JOIN u USING (col, val) GROUP BY id, need")
def e24_requirements(spark: SparkSession, d: str) -> DataFrame:
    q = F.broadcast(spark.createDataFrame([("a", "lang", "en", 100), ("b", "source", "src3", 60), ("c", "lang", "xx", 1)], "id string, col string, val string, need int").coalesce(1))
    counts = a.table(spark, d, "documents").select("lang", "source").unpivot([], ["lang", "source"], "col", "val").groupBy("col", "val").agg(F.count("*").alias("found"))
    return q.join(counts, ["col", "val"], "left").fillna(0, ["found"]).select("id", "need", "found", (F.col("found") >= F.col("need")).alias("met"))


@query("o1_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def o1_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly windows of the events, by a stream over the table that ends when all is read."""
    from boxquarry.streaming.windows import hourly_counts

    return hourly_counts(spark, f"{d}/events.parquet")
