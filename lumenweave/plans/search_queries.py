"""Vector search and the search pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import text as T
from lumenweave.functions.classify import matches_media_type
from lumenweave.functions.embed import HashingEmbedder, embed
from lumenweave.functions.pivots import Index, knn_pivots
from lumenweave.functions.transcripts import transcript_chunks_in_blocks
from lumenweave.functions.vector import knn, knn_batch, knn_null_safe
from lumenweave.operators import search as S
from lumenweave.operators.document_search import document_hits, nearest_chunks, search_documents
from lumenweave.plans.base import SQL, query
from lumenweave.sources.views import ctes, view

QUERY_TEXT = "the of and in that"
EMBEDDER = HashingEmbedder(64)
SHOWN = ["id", "file_path", "mime_type", "score"]


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks of all documents with their embeddings."""
    rows = T.token_chunks(view(spark, sf_dir, "doc_files").select("doc_id", "file_path", "text"))
    rows = rows.withColumn("id", F.concat_ws(":", F.lit("text"), F.col("file_path"), F.col("chunk_index").cast("string")))
    return rows.withColumn("embedding", embed(F.col("chunk_text"), EMBEDDER)).withColumns({"mime_type": F.lit("text/plain"), "source_type": F.lit("text_chunk"), "metadata": F.lit('{"source_type":"text_chunk"}')})


def text_vector() -> list[float]:
    return EMBEDDER.encode([QUERY_TEXT])[0].tolist()


# SQL of the parts that several queries share.
_D = "CAST(list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS DOUBLE)"
_NEAR = f"near AS (SELECT id, file_path, mime_type, source_type, metadata, round({_D}, 6) AS score FROM items ORDER BY score, id LIMIT {{k}})"
_TOKENS = r"""toks AS (SELECT doc_id, file_path, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM doc_files),
numbered AS (SELECT doc_id, file_path, w, len(w) AS n, unnest(range(CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 800 THEN 1 ELSE ceil((len(w) - 800) / 680.0) + 1 END AS BIGINT))) AS chunk_index FROM toks),
chunks AS (SELECT doc_id, file_path, chunk_index, w[chunk_index * 680 + 1 : chunk_index * 680 + 800] AS cw, concat('text:', file_path, ':', chunk_index) AS id FROM numbered)"""
_EMBEDDED = f"""occ AS (SELECT id, file_path, chunk_index, CAST(('0x' || substr(md5(t), 1, 6)) AS BIGINT) % 64 AS b FROM (SELECT id, file_path, chunk_index, unnest(cw) AS t FROM chunks)),
cnt AS (SELECT id, file_path, chunk_index, b, count(*) AS c FROM occ GROUP BY ALL),
q AS (SELECT CAST(('0x' || substr(md5(t), 1, 6)) AS BIGINT) % 64 AS b, count(*) AS c FROM (SELECT unnest(string_split('{QUERY_TEXT}', ' ')) AS t) GROUP BY 1),
qn AS (SELECT sqrt(sum(c * c)) AS n FROM q),
near_text AS (SELECT cnt.id, cnt.file_path, cnt.chunk_index, round(CAST(1 - sum(cnt.c * coalesce(q.c, 0)) / (sqrt(sum(cnt.c * cnt.c)) * any_value(qn.n)) AS DOUBLE), 6) AS score
  FROM cnt LEFT JOIN q USING (b) CROSS JOIN qn GROUP BY ALL)"""
_BEST_IMAGE = "best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score, id) AS r FROM near) WHERE r = 1)"


def _near(spark, sf_dir, k) -> DataFrame:
    items = view(spark, sf_dir, "items").select("id", "file_path", "mime_type", "source_type", "metadata", "embedding")
    return knn(items, query_vector(spark, sf_dir), k, "id")


@query(f"{ctes('items')}, {_NEAR.format(k=10)} SELECT id, file_path, mime_type, score FROM near")
def knn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 10).select(*SHOWN)


@query(f"{ctes('items')}, {_NEAR.format(k=20)} SELECT id, file_path, mime_type, score FROM near")
def visual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.visual_search(view(spark, sf_dir, "items"), query_vector(spark, sf_dir)).select(*SHOWN)


@query(f"{ctes('items')} SELECT id, file_path, round(coalesce({_D.replace('embedding AS DOUBLE[]), (SEL', 'CASE WHEN item_no % 7 <> 0 THEN embedding END AS DOUBLE[]), (SEL')}, 1.0), 6) AS score FROM items ORDER BY score, id LIMIT 450")
def knn_null_safe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "items").withColumn("embedding", F.when(F.col("item_no") % 7 != 0, F.col("embedding")))
    return knn_null_safe(rows, query_vector(spark, sf_dir), 450, "id").select("id", "file_path", "score")


@query(f"{ctes('items')} SELECT id, file_path, 0.5::DOUBLE AS score, created_s FROM items ORDER BY created_s DESC, id LIMIT 20")
def recent_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "items").select("id", "file_path", F.lit(0.5).alias("score"), "created_s").orderBy(F.desc("created_s"), "id").limit(20)


@query(f"{ctes('doc_files')}, {_TOKENS}, {_EMBEDDED} SELECT id, file_path, chunk_index, score FROM near_text ORDER BY score, id LIMIT 10")
def knn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_chunks(view(spark, sf_dir, "doc_files"), text_vector(), EMBEDDER, 10)


@query(f"{ctes('items')}, {_NEAR.format(k=240)}, {_BEST_IMAGE} SELECT id, file_path, mime_type, score FROM best")
def best_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_per_file(_near(spark, sf_dir, 240)).select(*SHOWN)


_DEDUPED = """hit AS (SELECT id, file_path, chunk_index, score FROM near_text ORDER BY score, id LIMIT 120),
text_side AS (SELECT id, file_path, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score, id) AS r FROM hit) WHERE r = 1 ORDER BY score, id LIMIT 80)"""


@query(f"""{ctes('doc_files')}, {_TOKENS}, {_EMBEDDED}, {_DEDUPED},
shown AS (SELECT s.*, array_to_string(c.cw, ' ') AS t FROM text_side s JOIN chunks c USING (id))
SELECT id, file_path, score, length(regexp_replace(CASE WHEN length(t) > 360 THEN concat(t[1:360], '...') ELSE t END, '\\s+', ' ', 'g')) > 0 AS has_snippet FROM shown""")
def dedupe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_hits(view(spark, sf_dir, "doc_files"), text_vector(), EMBEDDER, 120).select("id", "file_path", "score", (F.length("snippet") > 0).alias("has_snippet"))


@query(f"{ctes('items')}, {_NEAR.format(k=240)} SELECT id, file_path, score FROM near WHERE score <= least(0.995, (SELECT min(score) FROM near) + 0.035)")
def relevance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.relevance_threshold(_near(spark, sf_dir, 240), "image").select("id", "file_path", "score")


@query(f"""{ctes('items')} SELECT kind, count(*) AS n FROM (
SELECT unnest(CASE WHEN mime_type LIKE 'image/%' OR source_type = 'video_frame' OR file_path LIKE '%.jpg' THEN ['image'] ELSE [] END || CASE WHEN mime_type LIKE 'video/%' OR file_path LIKE '%.mp4' THEN ['video'] ELSE [] END || ['all']) AS kind FROM items) GROUP BY kind""")
def media_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "items").select("file_path", "mime_type", "source_type", "metadata")
    kinds = ("image", "video", "audio", "document", "all")
    hit = F.array_compact(F.array(*(F.when(matches_media_type(k, F.col("file_path"), F.col("mime_type"), F.col("source_type"), F.col("metadata")), F.lit(k)) for k in kinds)))
    return rows.select(F.explode(hit).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_SIDES = f"""{_DEDUPED},
texts AS (SELECT id, file_path, score FROM text_side WHERE score <= least(0.82, (SELECT min(score) FROM text_side) + 0.22)),
images0 AS (SELECT id, file_path, score FROM near WHERE score <= least(0.995, (SELECT min(score) FROM near) + 0.035)),
images1 AS (SELECT id, file_path, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score, id) AS r FROM images0) WHERE r = 1),
sizes AS (SELECT (SELECT count(*) FROM texts) AS nt, (SELECT count(*) FROM images1) AS ni),
t AS (SELECT id, file_path, score, row_number() OVER (ORDER BY score, id) - 1 AS i FROM texts),
m AS (SELECT id, file_path, score, row_number() OVER (ORDER BY score, id) - 1 AS i FROM images1),
slots AS (SELECT CASE WHEN nt = 0 THEN 120 ELSE least(ni, 40) END AS si, CASE WHEN ni = 0 THEN 120 ELSE least(nt, 120 - least(ni, 40)) END AS st FROM sizes),
merged AS (SELECT id, file_path, score, i // 2 AS turn, 0 AS kind, i FROM t, slots WHERE i < st UNION ALL SELECT id, file_path, score, i AS turn, 1 AS kind, i FROM m, slots WHERE i < si)
SELECT id, file_path, score, row_number() OVER (ORDER BY turn, kind, i) AS rank FROM merged ORDER BY rank LIMIT 120"""


@query(f"{ctes('items', 'doc_files')}, {_NEAR.format(k=120)}, {_TOKENS}, {_EMBEDDED}, {_SIDES}")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = view(spark, sf_dir, "items").select("id", "file_path", "mime_type", "source_type", "metadata", "embedding")
    found = search_documents(items, view(spark, sf_dir, "doc_files"), query_vector(spark, sf_dir), text_vector(), EMBEDDER)
    return found.select("id", "file_path", "score", "rank")


@query(f"""{ctes('items', 'doc_files')}, {_NEAR.format(k=240)}, {_TOKENS}, {_EMBEDDED},
texts AS (SELECT id, file_path, score FROM near_text ORDER BY score, id LIMIT 12),
images1 AS (SELECT id, file_path, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score, id) AS r FROM near) WHERE r = 1),
texts1 AS (SELECT id, file_path, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score, id) AS r FROM texts) WHERE r = 1),
merged AS (SELECT id, file_path, score, (row_number() OVER (ORDER BY score, id) - 1) // 2 AS turn, 0 AS kind FROM texts1
UNION ALL SELECT * FROM (SELECT id, file_path, score, row_number() OVER (ORDER BY score, id) - 1 AS turn, 1 AS kind FROM images1) WHERE turn < 10)
SELECT id, file_path, score, row_number() OVER (ORDER BY turn, kind, score, id) AS rank FROM merged ORDER BY rank LIMIT 30""")
def interleave_2to1(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = nearest_chunks(view(spark, sf_dir, "doc_files"), text_vector(), EMBEDDER, 12).select("id", "file_path", "score")
    return S.interleave(texts, _near(spark, sf_dir, 240).select("id", "file_path", "score"), 30)


@query("""WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, CAST(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE) AS d FROM embeddings e, embeddings q WHERE q.vec_id < 5),
r AS (SELECT query, neighbour, round(d, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""")
def knn_batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = knn_batch(rows.where("vec_id < 5"), rows, 5, "vec_id", "vec_id")
    return found.select("query", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, CAST(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT query, neighbour, round(d, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""")
def knn_batch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query set, every row whose id is divisible by 20 (knn_batch_items: five queries)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = knn_batch(rows.where("vec_id % 20 = 0"), rows, 5, "vec_id", "vec_id")
    return found.select("query", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(SQL["knn_batch_all"])
def knn_batch_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours through pivots and rings, in two passes whatever the number of queries."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = knn_pivots(rows.where("vec_id % 20 = 0"), Index(rows, "vec_id"), 5, "vec_id")
    return found.select("query", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"""WITH a AS (SELECT e.vec_id, CAST(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS DOUBLE) AS sq, len(e.embedding) AS width FROM embeddings e)
SELECT vec_id, round(sqrt(sq), 6) AS norm, CAST(width AS BIGINT) AS width FROM a""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenweave.functions.vector import dot

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.size("embedding").cast("long").alias("width"))


@query(rf"""{ctes('doc_files')}, {_TOKENS},
lens AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM doc_files),
offs AS (SELECT c.file_path, c.chunk_index, c.cw, p, c.chunk_index * 680 AS s FROM chunks c JOIN lens USING (doc_id))
SELECT file_path, chunk_index, CAST(len(cw) AS BIGINT) AS token_estimate, cw[1] AS first_token, cw[len(cw)] AS last_token,
CAST(coalesce(list_sum(list_transform(p[1:s], lambda x: strlen(x))), 0) + strlen(p[s + 1]) - strlen(ltrim(p[s + 1], ' ' || chr(10) || chr(9) || chr(13))) AS BIGINT) AS char_start,
CAST(list_sum(list_transform(p[1:s + 800], lambda x: strlen(x))) AS BIGINT) AS char_end FROM offs""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.token_chunks(view(spark, sf_dir, "doc_files").select("file_path", "text"))
    words = F.regexp_extract_all("chunk_text", F.lit(r"((?U)\S+)"), 1)
    return rows.select("file_path", "chunk_index", "token_estimate", words[0].alias("first_token"), F.element_at(words, -1).alias("last_token"), "char_start", "char_end")


@query(rf"""{ctes('doc_files')}, {_TOKENS}, s AS (SELECT d.text, c.* FROM chunks c JOIN doc_files d USING (doc_id) WHERE len(c.cw) < 800 AND c.chunk_index = 0)
SELECT concat('text:', file_path, ':', md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))), ':', chunk_index) AS chunk_id FROM s""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.token_chunks(view(spark, sf_dir, "doc_files").select("file_path", "text")).where("token_estimate < 800 AND chunk_index = 0")
    return rows.select(T.chunk_id("text", F.col("file_path"), F.col("chunk_text"), F.col("chunk_index")).alias("chunk_id"))


@query(rf"""{ctes('doc_files')}, {_TOKENS}, pieces AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM doc_files)
SELECT concat('text:', file_path, ':', md5(ltrim(array_to_string(p[chunk_index * 680 + 1:chunk_index * 680 + 800], ''), ' ' || chr(10) || chr(9) || chr(13))), ':', chunk_index) AS chunk_id FROM chunks JOIN pieces USING (doc_id)""")
def chunk_ids_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every chunk of every document (chunk_ids: of documents of one short chunk)."""
    rows = T.token_chunks(view(spark, sf_dir, "doc_files").select("file_path", "text"))
    return rows.select(T.chunk_id("text", F.col("file_path"), F.col("chunk_text"), F.col("chunk_index")).alias("chunk_id"))


_PACK = """ord AS (SELECT conv_id, file_path, start_s, end_s, trim(text) AS t, row_number() OVER (PARTITION BY conv_id, file_path ORDER BY seg_no, start_s, end_s, text) AS rn FROM segments WHERE trim(text) <> ''),
walk AS (SELECT conv_id, file_path, rn, t, start_s, end_s, 0 AS chunk_index, strlen(t) AS bytes, 1 AS segs FROM ord WHERE rn = 1
UNION ALL SELECT o.conv_id, o.file_path, o.rn, o.t, o.start_s, o.end_s, CASE WHEN w.bytes + strlen(o.t) + 1 > 420 OR w.segs >= 6 THEN w.chunk_index + 1 ELSE w.chunk_index END,
CASE WHEN w.bytes + strlen(o.t) + 1 > 420 OR w.segs >= 6 THEN strlen(o.t) ELSE w.bytes + strlen(o.t) + 1 END, CASE WHEN w.bytes + strlen(o.t) + 1 > 420 OR w.segs >= 6 THEN 1 ELSE w.segs + 1 END
FROM walk w JOIN ord o ON o.conv_id = w.conv_id AND o.file_path = w.file_path AND o.rn = w.rn + 1)"""


@query(ctes("segments").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _PACK + r"""
SELECT conv_id, CAST(chunk_index AS BIGINT) AS chunk_index, string_agg(t, ' ' ORDER BY rn) AS chunk_text, greatest(arg_min(start_s, rn), 0) AS time_start,
greatest(arg_max(end_s, rn), arg_min(start_s, rn)) AS time_end, CAST(len(list_filter(string_split_regex(string_agg(t, ' ' ORDER BY rn), '\s+'), lambda x: x <> '')) AS BIGINT) AS token_estimate FROM walk GROUP BY conv_id, file_path, chunk_index""")
def transcript_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transcript_chunks(view(spark, sf_dir, "segments"), ["conv_id", "file_path"]).drop("file_path")

@query(SQL["transcript_chunks"])
def transcript_chunks_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks, with every transcript dealt over blocks of 16 segments (transcript_chunks: one task a transcript)."""
    return transcript_chunks_in_blocks(view(spark, sf_dir, "segments"), ["conv_id", "file_path"], block=16).drop("file_path")



@query(f"""{ctes('items')}, {_NEAR.format(k=15)}, newest AS (SELECT id, file_path, 0.5::DOUBLE AS score FROM items ORDER BY created_s DESC, id LIMIT 15)
SELECT 'near' AS source, id, file_path, score, 0 AS tier FROM near
UNION ALL SELECT 'zero', * FROM (SELECT id, file_path, 1.0::DOUBLE AS score, 1 AS tier FROM items ORDER BY id LIMIT 15) UNION ALL SELECT 'none', *, 2 AS tier FROM newest""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of fallbacks over all items: with their embeddings, with vectors of no length, and without embeddings."""
    items, vector = view(spark, sf_dir, "items").select("id", "file_path", "embedding", "created_s"), query_vector(spark, sf_dir)
    zero = items.withColumn("embedding", F.transform("embedding", lambda _: F.lit(0.0)))
    none = items.withColumn("embedding", F.lit(None).cast("array<double>"))
    out = [S.search_with_fallback(rows, vector, 15).select(F.lit(name).alias("source"), "id", "file_path", "score", "tier") for name, rows in (("near", items), ("zero", zero), ("none", none))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""{ctes('items', 'doc_files')}, {_TOKENS}, a AS (SELECT count(*) AS items, count(*) FILTER (WHERE source_type = 'video_frame') AS frames FROM items), b AS (SELECT count(*) AS chunks FROM chunks),
c AS (SELECT count(*) AS indexed_count FROM (SELECT file_path FROM items UNION SELECT file_path FROM chunks))
SELECT true AS model_loaded, indexed_count, items, frames, items - frames AS regular, chunks, 'ready' AS status FROM a, b, c""")
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.token_chunks(view(spark, sf_dir, "doc_files").select("file_path", "text"))
    return S.search_status(view(spark, sf_dir, "items"), pieces, EMBEDDER)


@query(rf"""{ctes('doc_files')}, {_TOKENS}, pieces AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM doc_files)
SELECT file_path, chunk_index, ltrim(array_to_string(p[chunk_index * 680 + 1:chunk_index * 680 + 800], ''), ' ' || chr(10) || chr(9) || chr(13)) AS chunk_text, CAST(len(cw) AS BIGINT) AS token_estimate FROM chunks JOIN pieces USING (doc_id)""")
def text_chunks_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its whole text (text_chunks: its first and last word)."""
    return T.token_chunks(view(spark, sf_dir, "doc_files").select("file_path", "text")).drop("char_start", "char_end")


@query(rf"""{ctes('doc_files')}, {_TOKENS}, {_EMBEDDED}, {_DEDUPED}, pieces AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM doc_files),
shown AS (SELECT s.*, ltrim(array_to_string(p[c.chunk_index * 680 + 1:c.chunk_index * 680 + 800], ''), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM text_side s JOIN chunks c USING (id) JOIN pieces USING (doc_id))
SELECT id, file_path, score, CASE WHEN length(t) > 360 THEN concat(t[1:360], '...') ELSE t END AS snippet FROM shown""")
def dedupe_chunks_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks with their snippets (dedupe_chunks: whether there is one)."""
    rows = chunks(spark, sf_dir).select("id", "file_path", "chunk_index", "chunk_text", "embedding")
    return S.dedupe_chunks(knn(rows, text_vector(), 120, "id")).select("id", "file_path", "score", "snippet")


@query("SELECT doc_id, concat('search_document: ', trim(text[1:40])) AS document_prompt, concat('search_query: ', trim(text[1:20])) AS query_prompt FROM documents")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.as_document(F.substring(text, 1, 40)).alias("document_prompt"), T.as_query(F.substring(text, 1, 20)).alias("query_prompt"))


@query("SELECT doc_id, concat('search_document: ', trim(text)) AS document_prompt, concat('search_query: ', trim(text)) AS query_prompt FROM documents")
def prompt_template_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both templates over whole texts (prompt_template: over their first characters)."""
    text = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.as_document(text).alias("document_prompt"), T.as_query(text).alias("query_prompt"))


@query(f"""{ctes('segments')} SELECT conv_id, seg_no, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS shown
FROM (SELECT conv_id, seg_no, CAST(floor(start_s * 100) AS BIGINT) AS s FROM segments)""")
def format_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "segments").select("conv_id", "seg_no", T.clock(F.col("start_s") * 100).alias("shown"))


@query("""WITH b AS (SELECT doc_id, CAST(n_chars AS DOUBLE) * 1000 AS x FROM documents)
SELECT doc_id, CASE WHEN x <= 0 THEN '0 B' WHEN x >= 1073741824 THEN printf('%.1f GB', floor(x / 1073741824 * 10 + 0.5) / 10) WHEN x >= 1048576 THEN printf('%.1f MB', floor(x / 1048576 * 10 + 0.5) / 10) WHEN x >= 1024 THEN printf('%.1f KB', floor(x / 1024 * 10 + 0.5) / 10) ELSE printf('%.0f B', x) END AS shown FROM b""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.bytes_text(F.col("n_chars") * 1000).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(c) > 220 THEN concat(c[1:220], '...') ELSE c END AS shown FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.one_line(F.col("text")).alias("shown"))
