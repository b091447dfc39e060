"""Scans, writers, names and box arithmetic as queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.functions import geometry as g
from boxquarry.functions import text as tx
from boxquarry.plans import adapters as a
from boxquarry.plans.adapters import sql_area, sql_intersection, with_ctes
from boxquarry.plans.registry import query
from boxquarry.sources import readers, writers
from boxquarry.sources.scratch import scratch_path

_BASE = with_ctes("classes", "images", "gt", "preds")
_PAIRS = f"{_BASE}, pl AS (SELECT p.image, p.pred_index, l.label_index, {sql_intersection('p', 'l')} AS inter, {sql_area('p')} AS pa, {sql_area('l')} AS la, greatest(p.x1 - l.x2, l.x1 - p.x2, 0) AS dx, greatest(p.y1 - l.y2, l.y1 - p.y2, 0) AS dy FROM preds p JOIN gt l USING (image))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    corners = ("x1", "y1", "x2", "y2")
    p = a.pred_boxes(spark, d).select("image", "pred_index", *[F.col(c).alias(f"p_{c}") for c in corners])
    return p.join(a.gt_boxes(spark, d).select("image", "label_index", *[F.col(c).alias(f"l_{c}") for c in corners]), "image")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).join(a.images(spark, d), "image")


# ---- readers and writers: each writes its table and reads it back ----


@query("a1_dataset_config", f"WITH {a.CTES['classes']} SELECT class_name, class_id FROM classes")
def a1_dataset_config(spark: SparkSession, d: str) -> DataFrame:
    """The class names of a dataset's settings; a settings file is small and read by the driver."""
    text = "names:\n" + "".join(f"  {k}: {c[0]}\n" for k, c in enumerate(a.CLASSES)) + "train: images/train\nval: [images/val, images/more]\n"
    names = readers.dataset_config(text)["names"]
    return spark.createDataFrame([(v, k) for k, v in names.items()], "class_name string, class_id long")


@query("a2_dataset_root", "SELECT url, CASE WHEN url LIKE 'http%' THEN url ELSE '/data/' || url END AS resolved FROM pages")
def a2_dataset_root(spark: SparkSession, d: str) -> DataFrame:
    """Paths that aren't absolute stand below the dataset's root."""
    return a.table(spark, d, "pages").select("url", tx.resolved("url", "/data").alias("resolved"))


@query("a4_directory_scan", f"{_BASE} SELECT image % 16 AS part, count(*) AS lines FROM images GROUP BY 1")
def a4_directory_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder tree by their suffix, with the number of lines in each folder."""
    path = scratch_path(spark, "tree")
    a.images(spark, d).select((F.col("image") % 16).alias("part"), F.col("image").cast("string").alias("value")).write.partitionBy("part").text(path)
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("long")
    found = readers.file_inventory(spark, path, "*.txt").select(part.alias("part")).distinct()
    lines = spark.read.text(path).select(F.col("part").cast("long").alias("part"))
    return lines.join(found, "part", "left_semi").groupBy("part").agg(F.count("*").alias("lines"))


@query("a18_image_inventory", f"{_BASE} SELECT count(DISTINCT image % 16) AS folders, count(DISTINCT image % 16) > 0 AS found FROM images")
def a18_image_inventory(spark: SparkSession, d: str) -> DataFrame:
    """An inventory of files by recursive glob, once for each path in any case of letters."""
    path = scratch_path(spark, "inventory")
    a.images(spark, d).select((F.col("image") % 16).alias("part"), F.col("image").cast("string").alias("value")).write.partitionBy("part").text(path)
    inv = readers.file_inventory(spark, path, "*.txt").select(F.regexp_extract("path", r"(part=\d+)/", 1).alias("folder"))
    return inv.agg(F.countDistinct("folder").alias("folders"), (F.count("*") > 0).alias("found"))


@query("a5_split_union", "SELECT url AS image, count(*) AS exposures FROM (SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url FROM pages WHERE page_id % 5 = 0) GROUP BY 1")
def a5_split_union(spark: SparkSession, d: str) -> DataFrame:
    """A split of several lists: all their lines, repeats too."""
    path, pages = scratch_path(spark, "split"), a.table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("image"))
    writers.write_list(pages.where("ord % 2 = 0"), f"{path}/one")
    writers.write_list(pages.where("ord % 5 = 0"), f"{path}/two")
    return readers.image_list(spark, [f"{path}/one", f"{path}/two"]).groupBy("image").agg(F.count("*").alias("exposures"))


@query("a9_clamped_boxes", f"{_BASE}, c AS (SELECT image, label_index, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, width) AS x2, least(y2, height) AS y2, width, height FROM gt JOIN images USING (image)) SELECT image, label_index, x1, y1, x2, y2, {sql_area('c')} AS area, x1 <= 1 OR y1 <= 1 OR x2 >= width - 1 OR y2 >= height - 1 AS edge_touch, least(x2 - x1, y2 - y1) < 30 AS thin FROM c")
def a9_clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    c = g.clamp(g.box(), F.col("width"), F.col("height"))
    b = b.select("image", "label_index", "width", "height", *[v.alias(n) for n, v in zip(c._fields, c, strict=True)])
    box = g.box()
    return b.select("image", "label_index", *[F.col(n).cast("long").alias(n) for n in c._fields], g.area(box).cast("long").alias("area"), g.touches_edge(box, F.col("width"), F.col("height"), 1).alias("edge_touch"), (F.least(box.x2 - box.x1, box.y2 - box.y1) < 30).alias("thin"))


@query("a8_column_labels", "SELECT event_id, (event_id % 13)::INT AS class_id, 8 AS values FROM events WHERE event_id % 10 <> 3")
def a8_column_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label lines of a class and eight corner values; those of another width are left out."""
    corners = F.concat_ws(" ", *[F.lit("0.25")] * 8)
    line = F.concat_ws(" ", (F.col("event_id") % 13).cast("string"), F.when(F.col("event_id") % 10 == 3, "0.5").otherwise(corners))
    lines = a.table(spark, d, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), line.alias("value"))
    return readers.parse_labels(lines, 13, fields=9, mode="lenient").select(F.col("line_no").alias("event_id"), "class_id", F.size("values").alias("values"))


@query("a13_json_report", f"{_BASE} SELECT class_id, count(*) AS n FROM gt GROUP BY 1")
def a13_json_report(spark: SparkSession, d: str) -> DataFrame:
    """A report with a schema tag, written and read back; another tag would raise."""
    path = scratch_path(spark, "report")
    rows = a.gt_boxes(spark, d).groupBy("class_id").agg(F.count("*").alias("n"))
    writers.report_json(rows.withColumn("schema", F.lit("counts/1"))).write.text(path)
    return spark.read.schema("class_id long, n long, schema string").json(path).where(F.assert_true(F.col("schema") == "counts/1").isNull()).select("class_id", "n")


@query("a14_proposal_document", f"{_BASE}, s AS (SELECT image FROM images WHERE image % 40 = 0) SELECT image, (SELECT count(*) FROM gt WHERE gt.image = s.image) AS labels, (SELECT count(*) FROM preds p WHERE p.image = s.image) AS predictions FROM s WHERE image IN (SELECT image FROM gt) OR image IN (SELECT image FROM preds)")
def a14_proposal_document(spark: SparkSession, d: str) -> DataFrame:
    """Proposal documents, one for each image, written and scanned into labels and predictions."""
    path = scratch_path(spark, "proposals")
    corners = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("xyxy")
    lab = a.gt_boxes(spark, d).where("image % 40 = 0").groupBy("image").agg(F.collect_list(F.struct("class_id", corners)).alias("labels"))
    pre = a.pred_boxes(spark, d).where("image % 40 = 0").groupBy("image").agg(F.collect_list(F.struct("class_id", "confidence", corners, F.col("gate_class").cast("string").alias("gate_class"), "gate_conf")).alias("predictions"))
    row = F.struct(F.col("image").cast("string").alias("image"), F.lit("g").alias("source_group"), "labels", "predictions")
    docs = lab.join(pre, "image", "full_outer").select(F.lit("proposals/1").alias("schema"), F.array(row).alias("rows"))
    docs.select(F.to_json(F.struct("schema", "rows")).alias("value")).write.option("lineSep", "\n").text(path)
    labels, preds = readers.proposals(spark, path, "proposals/1", multi_line=False)
    n = labels.groupBy("image").agg(F.count("*").alias("labels")).join(preds.groupBy("image").agg(F.count("*").alias("predictions")), "image", "full_outer")
    return n.fillna(0).select(F.col("image").cast("long").alias("image"), "labels", "predictions")


@query("a15_metric_documents", f"{_BASE} SELECT 'run' || (image % 4) AS run, count(*) AS boxes FROM gt GROUP BY 1")
def a15_metric_documents(spark: SparkSession, d: str) -> DataFrame:
    """Metric documents of several runs, read at once with the name of each from its path."""
    path = scratch_path(spark, "metrics")
    m = a.gt_boxes(spark, d).groupBy(F.concat(F.lit("run"), F.col("image") % 4).alias("run")).agg(F.count("*").alias("boxes"))
    m.write.partitionBy("run").json(path)
    return spark.read.schema("boxes long").json(f"{path}/run=*").select(F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/", 1).alias("run"), "boxes")


@query("a16_optional_scan", "SELECT doc_id, quality FROM labels")
def a16_optional_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table that may be absent: its rows, or none; here one of each."""
    schema = "doc_id long, quality int"
    there = readers.optional(spark, lambda: a.table(spark, d, "labels").select("doc_id", "quality"), schema)
    return there.unionByName(readers.optional(spark, lambda: spark.read.parquet(f"{d}/no_such_table.parquet"), schema))


@query("a17_latest_run", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def a17_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The results of the last of several runs, by the names of their folders."""
    path, c = scratch_path(spark, "runs"), a.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    writers.write_manifest(c.where("c_custkey % 2 = 0"), f"{path}/run=07")
    writers.write_manifest(c.where("c_custkey % 2 = 1"), f"{path}/run=12")
    return readers.latest_run(spark, path, "run")


@query("a19_csv_parser", "SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL AND text <> '' AND NOT contains(text, chr(13))")
def a19_csv_parser(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with quotes, commas and line ends through CSV and back."""
    path = scratch_path(spark, "csv")
    docs = a.table(spark, d, "documents").where("doc_id % 2 = 0 and text <> '' and not contains(text, '\r')")
    docs.select("doc_id", "text").write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("maxCharsPerColumn", "-1").csv(path).select("doc_id", "text")


@query("a20_camera_metadata", "SELECT event_type AS camera, count(*) AS shots, min(json_extract_string(props, '$.k')::BIGINT) AS least, max(json_extract_string(props, '$.k')::BIGINT) AS most FROM events GROUP BY 1")
def a20_camera_metadata(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "camera")
    writers.write_json_lines(a.table(spark, d, "events").select(F.col("event_type").alias("camera"), F.from_json("props", "k long").alias("exif")), path)
    rows = readers.json_lines(spark, path, "camera string, exif struct<k: long>")
    return rows.groupBy("camera").agg(F.count("*").alias("shots"), F.min("exif.k").alias("least"), F.max("exif.k").alias("most"))


@query("b1_report_writer", "SELECT '{\"n\":' || count(*) || ',\"segment\":\"' || c_mktsegment || '\"}' AS line FROM customer GROUP BY c_mktsegment")
def b1_report_writer(spark: SparkSession, d: str) -> DataFrame:
    """JSON rows with their keys in order, written and read back as text."""
    path = scratch_path(spark, "json")
    writers.report_json(a.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("b3_union_header", "SELECT s_suppkey::VARCHAR AS key, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey::VARCHAR, NULL, c_mktsegment FROM customer")
def b3_union_header(spark: SparkSession, d: str) -> DataFrame:
    """Frames with different columns in one manifest."""
    path = scratch_path(spark, "union")
    writers.write_union([a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), a.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))], path)
    return readers.manifest(spark, path, ["key", "name", "segment"])


@query("b5_unique_list", "SELECT source || '/' || lang AS image FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def b5_unique_list(spark: SparkSession, d: str) -> DataFrame:
    """A list with each path once, at its first place."""
    path = scratch_path(spark, "unique")
    rows = a.table(spark, d, "documents").where("source is not null and lang is not null").select(F.col("doc_id").alias("ord"), F.concat_ws("/", "source", "lang").alias("image"))
    writers.write_list(rows, path, unique=True)
    return readers.image_list(spark, path).select("image")


@query("b6_data_settings", f"{_BASE} SELECT split || ': ' || count(*) AS line FROM images GROUP BY split")
def b6_data_settings(spark: SparkSession, d: str) -> DataFrame:
    """A dataset's settings with where its rows come from; a line a split."""
    path = scratch_path(spark, "settings")
    n = a.images(spark, d).groupBy("split").agg(F.count("*").alias("n"))
    n.select(F.concat("split", F.lit(": "), F.col("n").cast("string"))).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("b8_append_inventory", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def b8_append_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to an inventory that has some of them already."""
    path, n = scratch_path(spark, "stock"), a.table(spark, d, "nation").select("n_nationkey", "n_name")
    writers.write_manifest(n.where("n_nationkey < 10"), path)
    stock = readers.manifest(spark, path, ["n_nationkey"]).select(F.col("n_nationkey").cast("int").alias("n_nationkey"))
    writers.append_new(n, stock, ["n_nationkey"], path)
    return readers.manifest(spark, path, ["n_nationkey", "n_name"])


@query("b9_markdown_report", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT '| r_regionkey | r_name |' UNION ALL SELECT '| --- | --- |'")
def b9_markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A report table of a few rows; more than the limit raise."""
    text = writers.markdown_table(a.table(spark, d, "region").select("r_regionkey", "r_name"))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


# ---- box arithmetic ----


@query("c6_touches_edge", f"{_BASE} SELECT image, label_index FROM gt JOIN images USING (image) WHERE x1 <= 2 OR y1 <= 2 OR x2 >= width - 2 OR y2 >= height - 2")
def c6_touches_edge(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).where(g.touches_edge(g.box(), F.col("width"), F.col("height"), 2)).select("image", "label_index")


@query("d1_centre_to_corners", f"{_BASE} SELECT image, label_index, x1::DOUBLE AS px1, y1::DOUBLE AS py1, x2::DOUBLE AS px2, y2::DOUBLE AS py2 FROM gt")
def d1_centre_to_corners(spark: SparkSession, d: str) -> DataFrame:
    """Normalised centres and sizes back to pixels."""
    b, w, h = _boxes(spark, d), F.col("width"), F.col("height")
    c = g.from_centre(*g.to_centre(g.box(), w, h), w, h)
    return b.select("image", "label_index", *[F.round(v, 6).alias(f"p{n}") for n, v in zip(c._fields, c, strict=True)])


@query("d15_corners_to_centre", f"{_BASE} SELECT image, pred_index, round((x1 + x2) / 2.0::DOUBLE / width, 9) AS cx, round((y1 + y2) / 2.0::DOUBLE / height, 9) AS cy, round((x2 - x1) / width::DOUBLE, 9) AS w, round((y2 - y1) / height::DOUBLE, 9) AS h FROM preds JOIN images USING (image)")
def d15_corners_to_centre(spark: SparkSession, d: str) -> DataFrame:
    b = a.pred_boxes(spark, d).join(a.images(spark, d), "image")
    return b.select("image", "pred_index", *[F.round(v, 9).alias(n) for n, v in zip(("cx", "cy", "w", "h"), g.to_centre(g.box(), F.col("width"), F.col("height")), strict=True)])


@query("d6_overlap_metrics", f"{_PAIRS} SELECT image, pred_index, label_index, round(inter / (pa + la - inter)::DOUBLE, 9) AS iou, round(inter / pa::DOUBLE, 9) AS pred_share, round(inter / la::DOUBLE, 9) AS label_share FROM pl WHERE inter > 0")
def d6_overlap_metrics(spark: SparkSession, d: str) -> DataFrame:
    x, p, q = _pairs(spark, d), g.box("p_"), g.box("l_")
    return x.where(g.intersection(p, q) > 0).select("image", "pred_index", "label_index", F.round(g.iou(p, q), 9).alias("iou"), F.round(g.coverage(p, q), 9).alias("pred_share"), F.round(g.coverage(q, p), 9).alias("label_share"))


@query("d7_smaller_overlap_and_gap", f"{_PAIRS} SELECT image, pred_index, label_index, round(inter / least(pa, la)::DOUBLE, 9) AS of_smaller, round(sqrt(dx * dx + dy * dy), 6) AS gap FROM pl")
def d7_smaller_overlap_and_gap(spark: SparkSession, d: str) -> DataFrame:
    p, q = g.box("p_"), g.box("l_")
    return _pairs(spark, d).select("image", "pred_index", "label_index", F.round(g.overlap_of_smaller(p, q), 9).alias("of_smaller"), F.round(g.gap(p, q), 6).alias("gap"))


@query("d9_edge_margin", f"{_BASE} SELECT image, label_index, round(least(x1 / width::DOUBLE, y1 / height::DOUBLE, 1 - x2 / width::DOUBLE, 1 - y2 / height::DOUBLE), 9) AS margin FROM gt JOIN images USING (image)")
def d9_edge_margin(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("image", "label_index", F.round(g.edge_margin(g.box(), F.col("width"), F.col("height")), 9).alias("margin"))


@query("d12_logit_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def d12_logit_argmax(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "embeddings").select("vec_id", g.argmax(F.col("embedding")).alias("best"))


@query("e16_overlap_count", f"{_BASE}, o AS (SELECT x.image, x.label_index FROM gt x JOIN gt y ON x.image = y.image AND x.label_index < y.label_index WHERE {a.sql_iou('x', 'y')} >= 0.02) SELECT image, count(*) AS pairs FROM o GROUP BY 1")
def e16_overlap_count(spark: SparkSession, d: str) -> DataFrame:
    q = a.gt_boxes(spark, d)
    y = q.select("image", F.col("label_index").alias("j"), *[F.col(c).alias(f"y_{c}") for c in ("x1", "y1", "x2", "y2")])
    return q.join(y, "image").where((F.col("label_index") < F.col("j")) & (g.iou(g.box(), g.box("y_")) >= 0.02)).groupBy("image").agg(F.count("*").alias("pairs"))


@query("g40_value_by_class", f"{_BASE} SELECT class_name, currency, count(*) AS n, sum(face_value) AS value FROM gt JOIN classes USING (class_id) GROUP BY 1, 2")
def g40_value_by_class(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).join(a.classes(spark), "class_id").groupBy("class_name", "currency").agg(F.count("*").alias("n"), F.sum("face_value").alias("value"))


@query("r26_class_counter", f"{_BASE} SELECT image, class_id, count(*) AS n FROM gt GROUP BY 1, 2")
def r26_class_counter(spark: SparkSession, d: str) -> DataFrame:
    return a.gt_boxes(spark, d).groupBy("image", "class_id").agg(F.count("*").alias("n"))


# ---- names and metadata ----


@query("j3_source_family", "SELECT doc_id, CASE WHEN source IS NULL THEN 'unknown' WHEN source IN ('src0', 'src1') THEN 'first' ELSE split_part(source, 'c', 1) END AS family FROM documents")
def j3_source_family(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.col("source").isNull(), "unknown").when(F.col("source").isin("src0", "src1"), "first").otherwise(F.split_part("source", F.lit("c"), F.lit(1)))
    return a.table(spark, d, "documents").select("doc_id", family.alias("family"))


@query("j7_normalised_token", "SELECT p_partkey, replace(replace(lower(trim(p_brand)), '#', '_'), ' ', '_') AS token FROM part")
def j7_normalised_token(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "part").select("p_partkey", F.translate(F.lower(F.trim("p_brand")), "# ", "__").alias("token"))


@query("j10_key_value_limits", "SELECT event_id, split_part(spec, '=', 1) AS name, try_cast(split_part(spec, '=', 2) AS DOUBLE) AS most FROM (SELECT event_id, event_type || '=' || round(value, 2) AS spec FROM events)")
def j10_key_value_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits written as name=value."""
    spec = F.concat(F.col("event_type"), F.lit("="), F.round("value", 2).cast("string"))
    parts = F.split(spec, "=", 2)
    return a.table(spark, d, "events").select("event_id", parts[0].alias("name"), parts[1].try_cast("double").alias("most"))


@query("j14_split_fingerprints", f"{_BASE}, l AS (SELECT image, string_agg(label_index || ',' || class_id, chr(0) ORDER BY label_index) AS body FROM gt GROUP BY 1) SELECT split, image, sha256(image || chr(0) || coalesce(body, '')) AS print FROM images LEFT JOIN l USING (image)")
def j14_split_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Each image's name and labels as one digest."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label_index", "class_id"))), lambda x: F.concat_ws(",", x["label_index"].cast("string"), x["class_id"].cast("string"))), "\0")
    lines = a.gt_boxes(spark, d).groupBy("image").agg(body.alias("body"))
    out = a.images(spark, d).join(lines, "image", "left")
    return out.select("split", "image", F.sha2(F.concat(F.col("image").cast("string"), F.lit("\0"), F.coalesce("body", F.lit(""))), 256).alias("print"))


@query("j16_error_pair_text", f"{_BASE} SELECT image, pred_index, CASE WHEN gate_class = class_id THEN class_id::VARCHAR WHEN gate_conf < 0.2 THEN class_id || ' -> ?' ELSE class_id || ' -> ' || gate_class END AS pair FROM preds")
def j16_error_pair_text(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col("class_id").cast("string"), F.col("gate_class").cast("string")
    pair = F.when(F.col("gate_class") == F.col("class_id"), c).when(F.col("gate_conf") < 0.2, F.concat(c, F.lit(" -> ?"))).otherwise(F.concat(c, F.lit(" -> "), k))
    return a.pred_boxes(spark, d).select("image", "pred_index", pair.alias("pair"))


@query("j18_nested_metadata", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'cam' || (json_extract_string(props, '$.k')::BIGINT % 5) AS profile FROM events")
def j18_nested_metadata(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return a.table(spark, d, "events").select("event_id", k.alias("k"), F.concat(F.lit("cam"), (k % 5).cast("string")).alias("profile"))


@query("j19_nested_int", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(try_cast(json_extract_string(props, '$.no.such') AS BIGINT), -1) AS absent FROM events")
def j19_nested_int(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p: F.coalesce(F.get_json_object("props", p).try_cast("long"), F.lit(-1))
    return a.table(spark, d, "events").select("event_id", at("$.k").alias("k"), at("$.no.such").alias("absent"))


@query("j20_year", "SELECT o_orderkey, regexp_extract(strftime(o_orderdate, '%d.%m.%Y'), '[0-9]{4}')::INT AS year FROM orders")
def j20_year(spark: SparkSession, d: str) -> DataFrame:
    """The first four digits in a row of a date text."""
    return a.table(spark, d, "orders").select("o_orderkey", F.regexp_extract(F.date_format("o_orderdate", "dd.MM.yyyy"), "[0-9]{4}", 0).cast("int").alias("year"))


@query("j22_class_for_metadata", f"{_BASE}, m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE 'KHR' END AS currency, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 500 WHEN 2 THEN 20 WHEN 3 THEN 10000 WHEN 4 THEN 7 ELSE 1000 END::DOUBLE AS face FROM events) SELECT event_id, class_name FROM m LEFT JOIN classes c ON c.currency = m.currency AND c.face_value = m.face")
def j22_class_for_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The class of a currency and a face value; null if there is none."""
    face = F.element_at(F.array(*[F.lit(float(v)) for v in (1, 500, 20, 10000, 7, 1000)]), (F.col("event_id") % 6 + 1).cast("int"))
    m = a.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "USD").otherwise("KHR").alias("currency"), face.alias("face_value"))
    return m.join(a.classes(spark), ["currency", "face_value"], "left").select("event_id", "class_name")


@query("j23_csv_escape", """SELECT p_partkey, CASE WHEN contains(v, ',') OR contains(v, '"') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', "x"' ELSE p_name END AS v FROM part)""")
def j23_csv_escape(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "x"'))).otherwise(F.col("p_name"))
    return a.table(spark, d, "part").select("p_partkey", tx.csv_cell(v).alias("cell"))
