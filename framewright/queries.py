"""The registered queries of the operators, each over its whole tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import views as V
from framewright.frame import in_order, with_positions
from framewright.functions import detections as D
from framewright.functions import geometry as G
from framewright.functions import strings as S
from framewright.functions import tags as T
from framewright.nodes import (
    Concat, ExactDedupe, Filter, FilterByAspectRatio, FilterBySize, From, Map, MapCaption, Passthrough, Set, SetCaption, Shuffle, Sleep, Sorted, Take, Workspace,
)
from framewright.operators.captions import caption_variations, one_prompt
from framewright.operators.decisions import acceptance_stats, apply_captions, apply_tag_records
from framewright.operators.dedupe import cluster_stats, exact_dedupe, fuzzy_clusters, fuzzy_dedupe
from framewright.operators.detection import linear_score, suppressed
from framewright.operators.scaling import convert_format, crop_to_aspect, downscale, upscale
from framewright.operators.smart import combine, confusion, verdict
from framewright.operators.tagging import tag_frequencies
from framewright.sources.memo import latest, lookup, matching
from framewright.sources.save import manifest
from framewright.similarity import vector_classes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_IMAGE = ["objectid", "original_path", "width", "height", "format"]
_COLS = "objectid, original_path, width, height, format"
THRESHOLD = 0.4
RATIOS = (0.75, 1.0, 1.33)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def piped(spark: SparkSession, df: DataFrame, *operators: Callable[[], object]) -> DataFrame:
    """The operators, made in a workspace of their own, one after the other over a DataFrame."""
    with Workspace(spark) as w:
        last = From(df)
        for make in operators:
            last = last >> make()
        out = w.run()[-1]
    return out


# Flagship, sources and sinks ---------------------------------------------------------------------------------------


@query(f"""WITH {V.IMAGES_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY _pos) AS k FROM images WHERE least(width, height) >= 512)
SELECT {_COLS}, aesthetic_score, 'a part' AS caption FROM first WHERE k = 1 ORDER BY aesthetic_score DESC, _pos LIMIT 100""")
def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piped(spark, V.images(spark, sf_dir), lambda: FilterBySize(min_edge=512), ExactDedupe, lambda: SetCaption("a part"), lambda: Sorted("aesthetic_score", reverse=True), lambda: Take(100))
    return out.select(*_IMAGE, "aesthetic_score", "caption")


@query(f"""WITH {V.IMAGES_SQL}, named AS (SELECT *, regexp_extract(original_path, '([^/]*)\\.png$', 1)[:80] || '_' || objectid AS stem FROM images),
counted AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY _pos) - 1 AS k FROM named)
SELECT original_path, objectid, stem || CASE WHEN k > 0 THEN '_' || CAST(k AS VARCHAR) ELSE '' END || ext AS file FROM counted""")
def save_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(V.images(spark, sf_dir)).select("original_path", "objectid", F.col("_file").alias("file"))


# Filters -------------------------------------------------------------------------------------------------------------


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS} FROM images WHERE width >= 512 AND height >= 400 AND least(width, height) >= 480 AND width <= 1700 AND greatest(width, height) <= 1500")
def filter_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: FilterBySize(512, 400, 480, 1700, 0, 1500)).select(*_IMAGE)


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS} FROM images WHERE CAST(width AS DOUBLE) / CAST(height AS DOUBLE) BETWEEN 0.5 AND 2")
def filter_by_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: FilterByAspectRatio(0.5, 2)).select(*_IMAGE)


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS} FROM images WHERE aesthetic_score > 950 AND format <> 'WEBP'")
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Filter((F.col("aesthetic_score") > 950) & (F.col("format") != "WEBP"))).select(*_IMAGE)


@query(f"WITH {V.REVIEWED_SQL} SELECT count(*) AS total, count(passed) AS decided, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS accepted FROM reviewed")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance_stats(V.reviewed(spark, sf_dir), "passed").select("total", "decided", "accepted")


def _smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("doc_id") * 7919 % 1000 / F.lit(1000.0)
    return V.reviewed(spark, sf_dir).withColumn("smart", verdict(p, 0.7))


_SMART_SQL = f"""{V.REVIEWED_SQL}, scored AS (SELECT *, CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS p FROM reviewed),
judged AS (SELECT *, CASE WHEN greatest(p, 1 - p) > CAST(0.7 AS DOUBLE) THEN p > 0.5 END AS smart FROM scored)"""


@query(f"WITH {_SMART_SQL} SELECT doc_id, smart FROM judged WHERE coalesce(passed, smart, true)")
def smart_filter_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smart(spark, sf_dir).filter(combine(F.col("passed"), F.col("smart"), "accept")).select("doc_id", "smart")


@query(f"WITH {_SMART_SQL} SELECT passed AS label, count_if(NOT smart) AS rejected, count_if(smart) AS accepted, count_if(smart IS NULL) AS unknown FROM judged WHERE passed IS NOT NULL GROUP BY 1")
def smart_filter_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_smart(spark, sf_dir).filter("passed is not null"), "passed", "smart").withColumnRenamed("passed", "label")


# Rows and captions -----------------------------------------------------------------------------------------------------


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS}, width * height AS area, width * height > 500000 AS large FROM images")
def set_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Set(area=F.col("width") * F.col("height"), large=F.col("area") > 500000)).select(*_IMAGE, "area", "large")


@query(f"WITH {V.IMAGES_SQL} SELECT objectid, upper(format) AS format, width + height AS half FROM images")
def map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Map(lambda df: df.select("_pos", "objectid", F.upper("format").alias("format"), (F.col("width") + F.col("height")).alias("half")))).drop("_pos")


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS}, 'a picture' AS caption FROM images")
def set_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Sleep(0), Passthrough, lambda: SetCaption("a picture")).select(*_IMAGE, "caption")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN role || ': ' || replace(text, 'e', 'E') ELSE text END AS caption FROM conversations")
def map_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "conversations").withColumnRenamed("text", "caption")
    return piped(spark, with_positions(rows), lambda: MapCaption(lambda c: F.concat("role", F.lit(": "), F.replace(c, F.lit("e"), F.lit("E"))))).select("conv_id", "turn", "caption")


_VARIED_SQL = "SELECT doc_id, text AS caption, -1 AS v FROM documents UNION ALL SELECT doc_id, text || ' #' || CAST(v AS VARCHAR), v FROM documents CROSS JOIN range(3) t(v) WHERE length(text) > 0"


@query(f"SELECT doc_id, sha256(caption) AS caption_hash FROM ({_VARIED_SQL})")
def caption_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.documents(spark, sf_dir).select("_pos", "doc_id", "caption")
    return caption_variations(rows, 3, lambda c, k: F.concat(c, F.lit(" #"), k.cast("string"))).select("doc_id", F.sha2("caption", 256).alias("caption_hash"))


@query(f"WITH {V.IMAGES_SQL} SELECT objectid, '{one_prompt('descriptive', 'formal', 'any')} It is ' || CAST(width AS VARCHAR) || ' by ' || CAST(height AS VARCHAR) || '.' AS prompt FROM images")
def llm_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.images(spark, sf_dir).select("objectid", F.format_string(f"{one_prompt('descriptive', 'formal', 'any')} It is %d by %d.", "width", "height").alias("prompt"))


@query(r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '^\s+|\s+$', '', 'g')), '!+$', '') AS caption FROM conversations""")
def clean_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", S.clean_caption(F.col("text")).alias("caption"))


@query(f"WITH {V.IMAGES_SQL} SELECT objectid, CASE WHEN length(original_path) <= 30 THEN original_path ELSE left(original_path, 14) || '...' || right(original_path, 13) END AS short FROM images")
def shorten_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.images(spark, sf_dir).select("objectid", S.shorten_path(F.col("original_path"), 30).alias("short"))


# Tags and decisions -------------------------------------------------------------------------------------------------------


def _tagged(spark: SparkSession, sf_dir: str, new) -> DataFrame:
    return V.documents(spark, sf_dir).select("doc_id", F.array_join(new, ",").alias("tags"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([lang, source, 'kept', 'en'])), ',') AS tags FROM documents")
def add_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, T.add_tags(F.col("tags"), ["kept", "en"]))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([lang, source], lambda t: t NOT IN ('en', 'fr'))), ',') AS tags FROM documents")
def remove_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, T.remove_tags(F.col("tags"), ["en", "fr"]))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN source ELSE lang END, source])), ',') AS tags FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'fr' ELSE lang END AS lang, source FROM documents)")
def rewrite_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, T.rewrite_tags(F.col("tags"), {"en": "english", "de": "fr"}))


@query("""WITH vocabulary AS (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS tag)
SELECT v.tag, count(d.doc_id) AS n FROM vocabulary v LEFT JOIN documents d ON d.lang = v.tag GROUP BY 1""")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_frequencies(V.documents(spark, sf_dir), ["en", "fr", "de", "es", "it"])


@query(f"""WITH {V.REVIEWED_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN passed THEN ['good', source] ELSE [source] END)), ',') AS tags FROM reviewed WHERE NOT coalesce(rejected, false)""")
def human_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.when(F.col("passed").isNotNull(), F.struct(F.lit(1).alias("version"), F.when(F.col("passed"), F.array(F.lit("good"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.col("rejected")))
    rows = V.reviewed(spark, sf_dir).withColumn("human_tags", record)
    return apply_tag_records(rows, 1, ["good", "en", "fr", "de", "es"]).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {V.REVIEWED_SQL} SELECT doc_id, CASE WHEN passed THEN 'checked ' || lang ELSE source END AS caption FROM reviewed")
def human_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("passed"), F.concat(F.lit("checked "), "lang")).otherwise("")
    rows = V.reviewed(spark, sf_dir).withColumn("human_caption", F.when(F.col("passed").isNotNull(), F.struct(F.lit(2).alias("version"), text.alias("caption")))).drop("caption")
    return apply_captions(rows.withColumnRenamed("source", "said"), "said", "caption").select("doc_id", "caption")


# Dedupe, order, sets --------------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS objectid FROM documents GROUP BY 2")
def exact_dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedupe(V.documents(spark, sf_dir)).select("doc_id", "objectid")


@query(f"WITH {V.IMAGES_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY _pos) AS k FROM images) SELECT {_COLS} FROM first WHERE k = 1")
def exact_dedupe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), ExactDedupe).select(*_IMAGE)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("_pos"), F.format_string("%08d", "vec_id").alias("objectid"), F.col("embedding").alias("clip"), (F.col("label") * 10 + 100).alias("width"), F.lit(100).alias("height"))


_CLUSTERS_SQL = f"""WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > CAST({THRESHOLD} AS DOUBLE)),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node WHERE r.root < n.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), clusters AS (SELECT node, root, count(*) OVER (PARTITION BY root) AS size FROM roots)"""


@query(f"{_CLUSTERS_SQL} SELECT printf('%08d', node) AS objectid, printf('%08d', root) AS root, size FROM clusters")
def fuzzy_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_clusters(_vectors(spark, sf_dir), THRESHOLD).select("objectid", "root", "size")


@query(f"""{_CLUSTERS_SQL}, ranked AS (SELECT c.*, row_number() OVER (PARTITION BY root ORDER BY e.label DESC, node) AS k FROM clusters c JOIN embeddings e ON e.vec_id = node)
SELECT printf('%08d', node) AS objectid FROM ranked WHERE k = 1""")
def fuzzy_dedupe_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_dedupe(_vectors(spark, sf_dir), THRESHOLD).select("objectid")


@query(f"{_CLUSTERS_SQL} SELECT count(*) AS clusters, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT root, count(*) AS n FROM roots GROUP BY 1)")
def fuzzy_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_stats(fuzzy_clusters(_vectors(spark, sf_dir), THRESHOLD)).withColumn("mean_size", F.round("mean_size", 6))


@query(f"{_CLUSTERS_SQL}, linked AS (SELECT a, count(*) AS n FROM near GROUP BY 1) SELECT printf('%08d', node) AS objectid, printf('%08d', root) AS root, coalesce(n, 0) AS links FROM roots LEFT JOIN linked ON a = node")
def fuzzy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: its class and how many others are like it."""
    return vector_classes(_vectors(spark, sf_dir), "objectid", "clip", THRESHOLD)


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS}, aesthetic_score FROM images ORDER BY aesthetic_score DESC, _pos LIMIT 50")
def sorted_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Sorted("aesthetic_score", reverse=True), lambda: Take(50)).select(*_IMAGE, "aesthetic_score")


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS} FROM images ORDER BY _pos LIMIT 75")
def take_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Take(75)).select(*_IMAGE)


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS} FROM images ORDER BY sha256('7|' || CAST(_pos AS VARCHAR)), _pos LIMIT 80")
def take_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Take(80, random=True, seed=7)).select(*_IMAGE)


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS} FROM images")
def shuffle_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piped(spark, V.images(spark, sf_dir), lambda: Shuffle(3)).select(*_IMAGE)


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, value FROM events WHERE value > 100")
def branch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").withColumn("_pos", F.col("event_id"))
    with Workspace(spark, sharing=False):
        source = From(e)
        out = Concat(source >> Filter("event_type = 'error'"), source >> Filter("value > 100"))
        return out.dataset().select("event_id", "event_type", "value")


@query(f"WITH {V.IMAGES_SQL} SELECT {_COLS}, aesthetic_score FROM images UNION ALL SELECT {_COLS}, NULL FROM images WHERE width > 1000")
def concat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators.basic import concat

    own = V.images(spark, sf_dir)
    return in_order(concat([own, own.filter("width > 1000").drop("aesthetic_score")])).select(*_IMAGE, "aesthetic_score")


# The memo store -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {V.ENTRIES_SQL} SELECT key, domain, present, value FROM entries")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(V.memo_entries(spark, sf_dir)).select("key", "domain", "present", "value")


@query(f"WITH {V.ENTRIES_SQL} SELECT key, domain, value FROM entries WHERE key GLOB 'events(1*5)' AND domain = 'error'")
def cache_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(latest(V.memo_entries(spark, sf_dir)), "events(1*5)", "error").select("key", "domain", "value")


@query(f"WITH {V.ENTRIES_SQL} SELECT count(*) AS n FROM entries WHERE key GLOB 'events(2?)'")
def cache_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(latest(V.memo_entries(spark, sf_dir)), "events(2?)").agg(F.count("*").alias("n"))


@query(f"""WITH {V.ENTRIES_SQL}, last AS (SELECT key, value, present FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS k FROM raw) WHERE k = 1)
SELECT c_custkey, CAST(l.value AS BIGINT) AS seen, l.key IS NOT NULL AS cached FROM customer LEFT JOIN last l ON l.key = 'events(' || CAST(c_custkey % 3000 AS VARCHAR) || ')'""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("events("), (F.col("c_custkey") % 3000).cast("string"), F.lit(")"))
    return lookup(V.table(spark, sf_dir, "customer"), latest(V.memo_entries(spark, sf_dir)), key, None, "long", "seen").select("c_custkey", "seen", F.col("_cached").alias("cached"))


@query(f"""WITH {V.ENTRIES_SQL} SELECT c_custkey FROM customer WHERE 'events(' || CAST(c_custkey AS VARCHAR) || ')' NOT IN (SELECT key FROM entries)""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("events("), F.col("c_custkey").cast("string"), F.lit(")"))
    return lookup(V.table(spark, sf_dir, "customer"), latest(V.memo_entries(spark, sf_dir)), key).filter("not _cached").select("c_custkey")


# What models see, and geometry ----------------------------------------------------------------------------------------------------


@query("""SELECT event_id // 20 AS image_id, bool_or(event_type IN ('error', 'signup') AND value >= 150) AS has_any, bool_or(event_type = 'error' AND value >= 50) AS has_error, bool_or(starts_with(event_type, 's') AND value >= 100) AS has_s
FROM events GROUP BY 1""")
def detections_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("nudenet")
    return V.detections(spark, sf_dir).select("image_id", D.has_any(d, ["error", "signup"], 150).alias("has_any"), D.has_label(d, "error", 50).alias("has_error"), D.has_prefix(d, ["s"], 100).alias("has_s"))


@query(f"""WITH {V.BOXES_SQL}, kept AS (SELECT * FROM boxes WHERE (x1 <= 51 OR x2 >= 973 OR y1 <= 38 OR y2 >= 730)
AND ((x1 <= 153 AND x2 <= 153) OR (x1 >= 871 AND x2 >= 871) OR (y1 <= 115 AND y2 <= 115) OR (y1 >= 653 AND y2 >= 653))),
depth AS (SELECT l_orderkey, max(CASE WHEN x1 <= 153 THEN x2 END) AS l, max(CASE WHEN x2 >= 871 THEN 1024 - x1 END) AS r, max(CASE WHEN y1 <= 115 THEN y2 END) AS t, max(CASE WHEN y2 >= 653 THEN 768 - y1 END) AS b FROM kept GROUP BY 1),
every AS (SELECT DISTINCT o.l_orderkey, l, r, t, b, least(coalesce(l, 9999), coalesce(r, 9999), coalesce(t, 9999), coalesce(b, 9999)) AS m FROM boxes o LEFT JOIN depth d ON o.l_orderkey = d.l_orderkey),
cut AS (SELECT *, CASE WHEN m = 9999 THEN 'none' WHEN l = m THEN 'l' WHEN r = m THEN 'r' WHEN t = m THEN 't' ELSE 'b' END AS e FROM every)
SELECT l_orderkey, CAST(CASE WHEN e = 'l' THEN m ELSE 0 END AS INTEGER) AS x_from, CAST(CASE WHEN e = 't' THEN m ELSE 0 END AS INTEGER) AS y_from, CAST(CASE WHEN e = 'r' THEN 1024 - m ELSE 1024 END AS INTEGER) AS x_to,
CAST(CASE WHEN e = 'b' THEN 768 - m ELSE 768 END AS INTEGER) AS y_to, e <> 'none' AS modified FROM cut""")
def edge_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = V.boxes(spark, sf_dir).select("l_orderkey", G.edge_crop(F.lit(1024), F.lit(768), F.col("boxes")).alias("c"))
    return cut.select("l_orderkey", F.col("c.left").cast("int").alias("x_from"), F.col("c.top").cast("int").alias("y_from"), F.col("c.right").cast("int").alias("x_to"), F.col("c.bottom").cast("int").alias("y_to"), "c.modified")


@query("""SELECT l_orderkey, l_linenumber, greatest(0, x1 - CAST(trunc((x2 - x1) * CAST(0.25 AS DOUBLE)) AS INTEGER)) AS x1, greatest(0, y1 - CAST(trunc((y2 - y1) * CAST(0.25 AS DOUBLE)) AS INTEGER)) AS y1,
least(1023, x2 + CAST(trunc((x2 - x1) * CAST(0.25 AS DOUBLE)) AS INTEGER)) AS x2, least(767, y2 + CAST(trunc((y2 - y1) * CAST(0.25 AS DOUBLE)) AS INTEGER)) AS y2
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS INTEGER) AS x1, CAST(l_suppkey % 700 AS INTEGER) AS y1, CAST(l_partkey % 1000 + 10 AS INTEGER) AS x2, CAST(l_suppkey % 700 + 2 * l_linenumber AS INTEGER) AS y2 FROM lineitem)""")
def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda c: c.cast("int")
    x, y = F.col("l_partkey") % 1000, F.col("l_suppkey") % 700
    box = F.struct(i(x).alias("x1"), i(y).alias("y1"), i(x + 10).alias("x2"), i(y + 2 * F.col("l_linenumber")).alias("y2"))
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.scale_box(box, 1.5, F.lit(1024), F.lit(768)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


_INTER = "greatest(0, least(q.x2, b.x2) - greatest(q.x1, b.x1)) * greatest(0, least(q.y2, b.y2) - greatest(q.y1, b.y1))"
_UNION = f"(q.x2 - q.x1) * (q.y2 - q.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER}"


@query(f"""WITH RECURSIVE base AS (SELECT l_orderkey, (l_partkey * 37 % 200)::DOUBLE AS x1, (l_suppkey * 53 % 100)::DOUBLE AS y1, 60 + l_partkey * 11 % 130 AS dx, 60 + l_suppkey * 7 % 90 AS dy FROM lineitem),
boxes AS (SELECT l_orderkey, x1, y1, x1 + dx AS x2, y1 + dy AS y2, x1 * 31 % 97 AS score FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, x1, y1, x2, y2) AS k FROM boxes),
step AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS k, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM boxes
UNION ALL SELECT s.l_orderkey, b.k, CASE WHEN len(list_filter(s.kept, lambda q: {_INTER} >= CAST(0.3 AS DOUBLE) * ({_UNION}))) > 0 THEN s.kept ELSE list_append(s.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) END
FROM step s JOIN ranked b ON b.l_orderkey = s.l_orderkey AND b.k = s.k + 1), done AS (SELECT l_orderkey, arg_max(kept, k) AS kept FROM step GROUP BY 1)
SELECT l_orderkey, u.x1, u.y1, u.x2, u.y2 FROM (SELECT l_orderkey, unnest(kept) AS u FROM done)""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each order that greedy suppression keeps."""
    x1, y1 = (F.col("l_partkey") * 37 % 200).cast("double"), (F.col("l_suppkey") * 53 % 100).cast("double")
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 60 + F.col("l_partkey") * 11 % 130).alias("x2"), (y1 + 60 + F.col("l_suppkey") * 7 % 90).alias("y2"), (x1 * 31 % 97).alias("score"))
    boxes = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return boxes.select("l_orderkey", F.explode(suppressed("boxes")).alias("b")).select("l_orderkey", "b.x1", "b.y1", "b.x2", "b.y2")


@query("""WITH scored AS (SELECT vec_id, label, round(list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * ((i % 7) - 3) / 8)) + CAST(0.5 AS DOUBLE), 6) AS score FROM embeddings)
SELECT vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 100""")
def aesthetic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_pos"), "vec_id", F.round(linear_score(F.col("embedding"), [((i % 7) - 3) / 8 for i in range(64)], 0.5), 6).alias("score"))
    return piped(spark, rows, lambda: Sorted("score", reverse=True), lambda: Take(100)).select("vec_id", "score")


_RATIO = "CAST(width AS DOUBLE) / CAST(height AS DOUBLE)"
_NEAREST = " ".join(f"WHEN abs({_RATIO} - CAST({r} AS DOUBLE)) = m THEN CAST({r} AS DOUBLE)" for r in RATIOS)


@query(f"""WITH {V.IMAGES_SQL}, near AS (SELECT *, least({", ".join(f"abs({_RATIO} - CAST({r} AS DOUBLE))" for r in RATIOS)}) AS m FROM images), picked AS (SELECT *, CASE {_NEAREST} END AS t FROM near)
SELECT objectid, original_path, t AS crop_target_ratio, width AS crop_original_width, height AS crop_original_height, CASE WHEN t > {_RATIO} THEN width ELSE CAST(floor(CAST(height AS DOUBLE) * t) AS INTEGER) END AS width,
CASE WHEN t > {_RATIO} THEN CAST(floor(CAST(width AS DOUBLE) / t) AS INTEGER) ELSE height END AS height, CASE format WHEN 'WEBP' THEN 'PNG' ELSE format END AS format FROM picked""")
def crop_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_to_aspect(V.images(spark, sf_dir), RATIOS).select("objectid", "original_path", "crop_target_ratio", "crop_original_width", "crop_original_height", "width", "height", "format")


def _scale_sql(test: str, w: str, h: str) -> str:
    return f"""WITH {V.IMAGES_SQL} SELECT objectid, original_path, CAST(CASE WHEN {test} THEN width ELSE {w} END AS INTEGER) AS width, CAST(CASE WHEN {test} THEN height ELSE {h} END AS INTEGER) AS height,
CASE WHEN {test} THEN format ELSE 'PNG' END AS format FROM images"""


_SIZE = ["objectid", "original_path", "width", "height", "format"]


@query(_scale_sql("greatest(width, height) <= 768", "CASE WHEN width >= height THEN 768 ELSE floor((CAST(768 AS DOUBLE) / CAST(height AS DOUBLE)) * CAST(width AS DOUBLE)) END", "CASE WHEN height >= width THEN 768 ELSE floor((CAST(768 AS DOUBLE) / CAST(width AS DOUBLE)) * CAST(height AS DOUBLE)) END"))
def downscale_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downscale(V.images(spark, sf_dir), max_edge=768).select(*_SIZE)


@query(_scale_sql("least(width, height) <= 512", "floor(CAST(width AS DOUBLE) * (CAST(512 AS DOUBLE) / CAST(least(width, height) AS DOUBLE)))", "floor(CAST(height AS DOUBLE) * (CAST(512 AS DOUBLE) / CAST(least(width, height) AS DOUBLE)))"))
def downscale_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downscale(V.images(spark, sf_dir), min_edge=512).select(*_SIZE)


@query(_scale_sql("least(width, height) >= 1024", "CASE WHEN width <= height THEN 1024 ELSE floor((CAST(1024 AS DOUBLE) / CAST(height AS DOUBLE)) * CAST(width AS DOUBLE)) END", "CASE WHEN height <= width THEN 1024 ELSE floor((CAST(1024 AS DOUBLE) / CAST(width AS DOUBLE)) * CAST(height AS DOUBLE)) END"))
def upscale_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upscale(V.images(spark, sf_dir), 1024).select(*_SIZE)


@query(f"WITH {V.IMAGES_SQL} SELECT objectid, original_path, 'JPEG' AS format, CASE WHEN format <> 'JPEG' THEN 'RGB' END AS convert_mode FROM images")
def convert_format_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_format(V.images(spark, sf_dir), "JPEG").select("objectid", "original_path", "format", "convert_mode")


from framewright import operator_queries  # noqa: E402, F401
