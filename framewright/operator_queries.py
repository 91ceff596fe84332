"""Registered queries that run operators whole: through the stores of a workspace, files and models that answer by rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from framewright import views as V
from framewright.blocks import partitions
from framewright.graph import connected_components
from framewright.models.runner import FunctionBackend
from framewright.nodes import (
    AestheticScore, Anonymize, Apply, ClipEmbed, EdgeWatermarkRemoval, ExactDedupe, Filter, FilterBySize, Florence2Caption, From, FuzzyDedupe, GeminiCaption, Gemma3Caption, GPT4oCaption, HumanCaption, HumanFilter, HumanTag,
    JoyCaptionAlphaOne, JoyCaptionAlphaTwo, LlamaCaption, LLMCaptionTransform, LLMCaptionVariations, Load, Map, MapCaption, MolmoCaption, NudeNet, QwenVLCaption, Save, Workspace, XGenMMCaption,
)
from framewright.operators.decisions import import_decisions
from framewright.queries import _IMAGE, THRESHOLD, _vectors, query
from framewright.sources.files import list_files, read_files, spread
from framewright.sources.memo import MemoStore, latest
from framewright.storage import filesystem, new_path
from framewright.streaming.ingest import ingest


def ran(spark: SparkSession, df: DataFrame, *operators: Callable[[], object], before: Callable[[Workspace], object] | None = None) -> DataFrame:
    """The operators one after the other over a DataFrame, in a workspace that ``before`` has filled."""
    with Workspace(spark) as w:
        if before:
            before(w)
        last = From(df)
        for make in operators:
            last = last >> make()
        return last.dataset()


# Files ---------------------------------------------------------------------------------------------------------------

#: A PNG file's first bytes: all that a header says.
_CONTENT = "concat(unhex('89504E470D0A1A0A0000000D49484452'), unhex(lpad(hex({w}), 8, '0')), unhex(lpad(hex({h}), 8, '0')), cast(cast({k} as string) as binary))"
_CONTENT_SQL = "unhex('89504E470D0A1A0A0000000D49484452' || lpad(to_hex({w}), 8, '0') || lpad(to_hex({h}), 8, '0')) || CAST(CAST({k} AS VARCHAR) AS BLOB)"
_W, _H = "100 + o_orderkey % 900", "100 + o_custkey % 500"
_FILES_SQL = f"files AS (SELECT o_custkey, {_CONTENT_SQL.format(w=f'CAST({_W} AS INTEGER)', h=f'CAST({_H} AS INTEGER)', k='o_custkey % 100')} AS content, {_W} AS width, {_H} AS height FROM orders JOIN (SELECT max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) USING (o_orderkey))"


def _write_files(spark: SparkSession, sf_dir: str, folder: str, part: int) -> None:
    """A file a customer with orders, in the first call of those with even ids."""
    orders = V.table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    rows = last.filter(F.col("o_custkey") % 2 == part).select("o_custkey", F.expr(_CONTENT.format(w=_W, h=_H, k="o_custkey % 100")).alias("content"))

    def write(rows_: Iterator[Row]) -> None:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        for r in rows_:
            with fs.open_output_stream(f"{at}/{r.o_custkey}.png") as out:
                out.write(bytes(r.content))

    rows.repartition(partitions(spark)).foreachPartition(write)
    fs, at = filesystem(folder)
    with fs.open_output_stream(f"{at}/no image {part}.jpg") as out:
        out.write(b"text")


@query(f"WITH {_FILES_SQL} SELECT CAST(o_custkey AS VARCHAR) || '.png' AS name, sha256(content) AS objectid, '.png' AS ext, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, 'PNG' AS format FROM files")
def load_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load runs twice in one workspace, the second time with as many new files."""
    folder = new_path(spark, "images")
    work = new_path(spark, "workspace")
    for part in (0, 1):
        _write_files(spark, sf_dir, folder, part)
        with Workspace(spark, work):
            found = Load(folder).dataset()
            if part == 0:
                found.write.format("noop").mode("overwrite").save()
    return found.select(F.substring_index("original_path", "/", -1).alias("name"), "objectid", "ext", "width", "height", "format")


@query(f"WITH {_FILES_SQL} SELECT sha256(content) AS objectid, CAST(min(width) AS INTEGER) AS width, CAST(min(height) AS INTEGER) AS height FROM files GROUP BY 1")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of a stream of files: each content once."""
    folder, table, checkpoint = (new_path(spark, x) for x in ("images", "streamed", "stream"))
    for part in (0, 1):
        _write_files(spark, sf_dir, folder, part)
        ingest(spark, folder, table, checkpoint)
    return spark.read.parquet(table).select("objectid", "width", "height")


@query(f"""WITH {V.IMAGES_SQL}, named AS (SELECT *, regexp_extract(original_path, '([^/]*)\\.png$', 1)[:80] || '_' || objectid AS stem FROM images),
counted AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY _pos) - 1 AS k FROM named)
SELECT stem || CASE WHEN k > 0 THEN '_' || CAST(k AS VARCHAR) ELSE '' END || '.txt' AS file, 'picture ' || CAST(_pos AS VARCHAR) AS caption FROM counted WHERE _pos % 5 > 0""")
def save_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Save writes, read again: captions beside their images, none for empty ones."""
    rows = V.images(spark, sf_dir).withColumn("caption", F.when(F.col("_pos") % 5 > 0, F.concat(F.lit("picture "), F.col("_pos").cast("string"))).otherwise(""))
    folder = new_path(spark, "saved")
    ran(spark, rows, lambda: Save(folder, sidecars=False, index=False))
    names = list_files(spark, folder)
    files = read_files(spread(names, names.count()), "path", content=True)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.decode("content", "UTF-8").alias("caption"))


@query("SELECT DISTINCT sha256(text) AS objectid, octet_length(encode(text)) AS size FROM documents")
def put_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two puts, of overlapping contents, and what the store then holds."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    with Workspace(spark) as w:
        w.objects.put(d.filter("doc_id % 3 < 2"))
        w.objects.put(d)
        return w.objects.objects().select("objectid", F.octet_length("content").alias("size"))


@query("SELECT doc_id, sha256(text) AS objectid, octet_length(encode(text)) AS size FROM documents")
def get_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of a data set's ids, from a store that was filled by importing another."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    with Workspace(spark) as a, Workspace(spark) as b:
        named = a.objects.put(d).select("doc_id", "objectid")
        b.objects.import_from(a.objects)
        return b.objects.get(named).select("doc_id", "objectid", F.octet_length("content").alias("size"))


# Stores ----------------------------------------------------------------------------------------------------------------


def _filled(spark: SparkSession, sf_dir: str) -> MemoStore:
    store = MemoStore(spark, new_path(spark, "memo"))
    store.put(latest(V.memo_entries(spark, sf_dir)).select("key", "domain", "value"))
    return store


@query(f"WITH {V.ENTRIES_SQL} SELECT key, domain, present, value FROM entries WHERE NOT (key GLOB 'events(*0)' AND domain = 'view')")
def cache_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.clear("events(*0)", "view")
    return store.entries().select("key", "domain", "present", "value")


@query(f"""WITH {V.ENTRIES_SQL} SELECT key, domain, CASE WHEN domain = 'click' AND key GLOB 'events(*2)' THEN 'new' ELSE value END AS value FROM entries""")
def cache_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, other = _filled(spark, sf_dir), MemoStore(spark, new_path(spark, "memo"))
    other.put(latest(V.memo_entries(spark, sf_dir)).select("key", "domain", F.lit("new").alias("value")))
    store.import_from(other, "events(*2)", "click")
    return store.entries("events").select("key", "domain", "value")


@query("SELECT 0 AS entries_left, true AS dropped, false AS again")
def cache_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    dropped, again = store.drop(), store.drop()
    return spark.createDataFrame([(store.count(), dropped, again)], "entries_left int, dropped boolean, again boolean")


_FILL_SQL = "SELECT c_custkey, 'of ' || CAST(c_nationkey AS VARCHAR) AS answer FROM customer"


@query(_FILL_SQL)
def cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missing key is worked out once, put, and scattered back to all of its rows."""
    store = MemoStore(spark, new_path(spark, "memo"))
    customers = V.table(spark, sf_dir, "customer")
    key = F.concat(F.lit("nation("), F.col("c_nationkey").cast("string"), F.lit(")"))
    store.put(customers.filter("c_nationkey % 2 = 0").select(key.alias("key"), F.lit(None).cast("string").alias("domain"), F.concat(F.lit("of "), F.col("c_nationkey").cast("string")).alias("value")).distinct())
    work = lambda misses: misses.select("_key", F.concat(F.lit("of "), F.regexp_extract("_key", "([0-9]+)", 1)).alias("value"))
    return store.fill(customers, key, work, "answer", scope="nation").select("c_custkey", "answer")


# Decisions ---------------------------------------------------------------------------------------------------------------

_DECIDED_SQL = "decided AS (SELECT objectid, bool_or({0}) AS verdict FROM reviewed WHERE ({0}) IS NOT NULL GROUP BY 1)"


@query(f"WITH {V.REVIEWED_SQL}, {_DECIDED_SQL.format('passed')} SELECT doc_id, objectid, verdict AS passed_human_filter FROM reviewed LEFT JOIN decided USING (objectid) WHERE coalesce(verdict, true)")
def human_filter_skip_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported decisions, by content; what nobody has seen passes."""
    rows = V.reviewed(spark, sf_dir)
    out = ran(spark, rows, lambda: HumanFilter(skip_ui=True), before=lambda w: import_decisions(w, "humanfilter", rows.filter("passed is not null").select("objectid", "passed")))
    return out.select("doc_id", "objectid", "passed_human_filter")


@query(f"WITH {V.REVIEWED_SQL}, {_DECIDED_SQL.format('coalesce(passed, doc_id % 3 > 0)')} SELECT doc_id, objectid FROM reviewed JOIN decided USING (objectid) WHERE verdict")
def human_filter_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All are decided, so the run doesn't stop."""
    rows = V.reviewed(spark, sf_dir)
    verdicts = rows.select("objectid", F.coalesce("passed", F.col("doc_id") % 3 > 0).alias("passed"))
    return ran(spark, rows, HumanFilter, before=lambda w: import_decisions(w, "humanfilter", verdicts)).select("doc_id", "objectid")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS objectid, lang, source FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN objectid < '8' THEN ['good', source] ELSE [source] END)), ',') AS tags FROM d WHERE NOT starts_with(objectid, 'f')""")
def human_tag_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.documents(spark, sf_dir)
    o = F.col("objectid")
    records = rows.select("objectid", F.lit(1).alias("version"), F.when(o < "8", F.array(F.lit("good"))).otherwise(F.array().cast("array<string>")).alias("tags"), o.startswith("f").alias("rejected"))
    out = ran(spark, rows, lambda: HumanTag(version=1, tags=[["good", "en"], ["fr", "de", "es"]]), before=lambda w: import_decisions(w, "humantag", records, vocabulary=["good"]))
    return out.select("doc_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS objectid, source FROM documents)
SELECT doc_id, CASE WHEN objectid < '8' AND NOT starts_with(objectid, '0') THEN 'checked ' || left(objectid, 6) ELSE source END AS caption FROM d""")
def human_caption_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.documents(spark, sf_dir).drop("caption")
    o = F.col("objectid")
    records = rows.filter(o < "8").select("objectid", F.lit(2).alias("version"), F.when(o.startswith("0"), "").otherwise(F.concat(F.lit("checked "), F.left(o, F.lit(6)))).alias("caption"))
    out = ran(spark, rows, lambda: HumanCaption("source", "caption", version=2, skip_ui=True), before=lambda w: import_decisions(w, "humancaption", records))
    return out.select("doc_id", "caption")


# Python in rows, metrics, components ------------------------------------------------------------------------------------


@query(f"WITH {V.IMAGES_SQL} SELECT objectid, original_path, width + 1 AS width, height, format || '!' AS format FROM images WHERE width > 600 AND format <> 'WEBP'")
def python_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python functions of rows: a predicate, then a mapping."""
    keep = lambda: Filter(lambda r: r.width > 600 and r.format != "WEBP")
    change = lambda: Map(lambda r: r._asdict() | {"width": r.width + 1, "format": r.format + "!"}, rows=True)
    return ran(spark, V.images(spark, sf_dir), keep, change).select(*_IMAGE)


@query("SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN reverse(text) ELSE text END AS caption, length(text) AS size FROM conversations")
def python_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "conversations").withColumnRenamed("text", "caption").withColumn("_pos", F.monotonically_increasing_id())
    return ran(spark, rows, lambda: MapCaption(lambda c: c[::-1], rows=True), lambda: Apply(size=F.length("caption").cast("long"))).select("conv_id", "turn", "caption", "size")


@query(f"""WITH {V.IMAGES_SQL}, big AS (SELECT * FROM images WHERE least(width, height) >= 512)
SELECT 'FilterBySize' AS operator, count(*) AS n FROM big UNION ALL SELECT 'ExactDedupe', count(DISTINCT objectid) FROM big""")
def operator_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each operator gave, as the run observed them."""
    with Workspace(spark, observing=True) as w:
        last = From(V.images(spark, sf_dir)) >> FilterBySize(min_edge=512) >> ExactDedupe
        last.dataset().write.format("noop").mode("overwrite").save()
        return spark.createDataFrame([(name, n) for name, n, _ in w.metrics() if name != "From"], "operator string, n long")


@query("SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root FROM supplier UNION ALL SELECT s_nationkey + 1000000000, min(s_suppkey) FROM supplier GROUP BY s_nationkey")
def component_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers joined by their nations, by the rounds that larger graphs take."""
    edges = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1_000_000_000).alias("b"))
    return connected_components(edges, few=0)


@query(f"""WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > CAST({THRESHOLD} AS DOUBLE)),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node WHERE r.root < n.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), ranked AS (SELECT r.*, row_number() OVER (PARTITION BY root ORDER BY e.label DESC, node) AS k FROM roots r JOIN embeddings e ON e.vec_id = node)
SELECT printf('%08d', node) AS objectid FROM ranked WHERE k = 1""")
def fuzzy_dedupe_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator twice in one workspace: the second run reads the clusters that the first kept."""
    with Workspace(spark):
        rows = From(_vectors(spark, sf_dir))
        first = (rows >> FuzzyDedupe(THRESHOLD)).dataset()
        again = (rows >> FuzzyDedupe(THRESHOLD)).dataset()
        return again.join(first.select("objectid"), "objectid").select("objectid")


# Models that answer by rule ----------------------------------------------------------------------------------------------

_short = FunctionBackend(lambda x: f"a {x['objectid'][:8]}")


@query(f"""WITH {V.IMAGES_SQL} SELECT _pos, CASE WHEN NOT starts_with(objectid, '0') THEN 'a ' || left(objectid, 8) END AS gpt4o, 'a ' || left(objectid, 8) AS llama, 'a ' || left(objectid, 8) AS xgen,
'a ' || left(objectid, 8) AS gemini, 'a ' || left(objectid, 8) AS gemma FROM images""")
def model_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions by models, cleaned as each needs it; a refusal is null."""
    refuses = FunctionBackend(lambda x: "I'm sorry, no." if x["objectid"][0] == "0" else f"a {x['objectid'][:8]}")
    says = FunctionBackend(lambda x: f"assistant\n\n a {x['objectid'][:8]} ")
    ends = FunctionBackend(lambda x: f" a {x['objectid'][:8]} <|end|> more")
    out = ran(
        spark, V.images(spark, sf_dir), lambda: GPT4oCaption("gpt4o", backend=refuses), lambda: LlamaCaption("llama", backend=says), lambda: XGenMMCaption("xgen", backend=ends),
        lambda: GeminiCaption("gemini", backend=_short), lambda: Gemma3Caption("gemma", backend=_short),
    )
    return out.select("_pos", "gpt4o", "llama", "xgen", "gemini", "gemma")


@query(f"WITH {V.IMAGES_SQL} SELECT _pos, {', '.join(f'left(objectid, 8) AS {c}' for c in ('qwen', 'molmo', 'florence', 'joy1', 'joy2'))} FROM images")
def more_model_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = FunctionBackend(lambda x: x["objectid"][:8])
    out = ran(
        spark, V.images(spark, sf_dir), lambda: QwenVLCaption("qwen", backend=plain), lambda: MolmoCaption("molmo", backend=plain), lambda: Florence2Caption("florence", backend=plain),
        lambda: JoyCaptionAlphaOne("joy1", backend=plain), lambda: JoyCaptionAlphaTwo("joy2", backend=plain),
    )
    return out.select("_pos", "qwen", "molmo", "florence", "joy1", "joy2")


@query(f"WITH {V.IMAGES_SQL} SELECT _pos, '<about ' || format || ' of ' || CAST(width AS VARCHAR) || '>' AS said FROM images")
def llm_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("about "), "format", F.lit(" of "), F.col("width").cast("string"))
    return ran(spark, V.images(spark, sf_dir), lambda: LLMCaptionTransform("m", prompt, "said", backend=FunctionBackend(lambda x: f"<{x['prompt']}>"))).select("_pos", "said")


@query("""SELECT doc_id, source AS caption FROM documents UNION ALL SELECT doc_id, source || ' again ' || CAST(v AS VARCHAR) FROM documents CROSS JOIN range(2) t(v)""")
def llm_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.documents(spark, sf_dir).select("_pos", "doc_id", F.col("source").alias("caption"))
    again = FunctionBackend(lambda x: f"{x['prompt'].split(chr(10))[-1]} again {x['variation']}")
    return ran(spark, rows, lambda: LLMCaptionVariations(variations=2, backend=again)).select("doc_id", "caption")


_HEX = "CAST('0x' || {} AS INTEGER)"


@query(f"""WITH {V.IMAGES_SQL} SELECT _pos, {_HEX.format('left(objectid, 2)')} / 4.0::DOUBLE AS clip_first, {_HEX.format('left(objectid, 4)')} / 64.0::DOUBLE AS score,
objectid < '8' AND substr(objectid, 3, 1) >= '8' AS has_nudity, objectid < '8' AND substr(objectid, 3, 1) >= '8' AS has_female, objectid >= '8' AND substr(objectid, 3, 1) >= '8' AS has_male FROM images""")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, scores and detections of a data set."""
    clip = FunctionBackend(lambda x: [int(x["objectid"][:2], 16) / 4, 1.0])
    score = FunctionBackend(lambda x: int(x["objectid"][:4], 16) / 64)
    seen = FunctionBackend(lambda x: [{"class": "FEMALE_BREAST_EXPOSED" if x["objectid"] < "8" else "FACE_MALE", "score": int(x["objectid"][2], 16) / 16, "box": [0, 0, 1, 1]}])
    out = ran(spark, V.images(spark, sf_dir).drop("aesthetic_score"), lambda: ClipEmbed(backend=clip), lambda: AestheticScore(backend=score), lambda: NudeNet(0.5, backend=seen))
    return out.select("_pos", F.col("clip")[0].cast("double").alias("clip_first"), F.col("aesthetic_score").alias("score"), "has_nudity", "has_female", "has_male")


@query(f"WITH {V.IMAGES_SQL} SELECT _pos, CAST(width - 1 - {_HEX.format('left(objectid, 2)')} % 39 AS INTEGER) AS width, height, 'PNG' AS format FROM images")
def watermarks_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark at the left edge of every image, of a width that follows from its content."""
    mark = FunctionBackend(lambda x: [{"x1": 0.0, "y1": 100.0, "x2": 1.0 + int(x["objectid"][:2], 16) % 39, "y2": 110.0, "label": "logo"}])
    return ran(spark, V.images(spark, sf_dir), lambda: EdgeWatermarkRemoval(backend=mark)).select("_pos", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "format")


@query(f"WITH {V.IMAGES_SQL} SELECT _pos, CASE WHEN objectid < '8' THEN 2 ELSE 1 END AS n, CASE WHEN objectid < '8' THEN 70 + {_HEX.format('left(objectid, 2)')} ELSE 30 END AS furthest FROM images")
def faces_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of which one overlaps a better one and another is unsure for half of the images."""

    def faces(x: dict) -> list[dict]:
        far = 70.0 + int(x["objectid"][:2], 16)
        found = [(10.0, 10.0, 30.0, 30.0, 0.9), (11.0, 10.0, 31.0, 30.0, 0.8), (60.0, 60.0, far, 90.0, 0.5 if x["objectid"] < "8" else 0.3)]
        return [dict(zip(("x1", "y1", "x2", "y2", "score"), b, strict=True)) for b in found]

    out = ran(spark, V.images(spark, sf_dir), lambda: Anonymize(backend=FunctionBackend(faces)))
    return out.select("_pos", F.size("faces").alias("n"), F.array_max(F.transform("faces", lambda b: b["x2"])).cast("int").alias("furthest"))

