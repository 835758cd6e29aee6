"""The driver's tables seen as this engine's domain tables.

Each view is one SELECT that Spark and an ANSI engine both read; queries and their SQL begin
from the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The clock of every query that depends on time.
AS_OF = "2024-01-30 12:00:00"

VIEWS = {
    "items": """SELECT vec_id AS item_no, CONCAT('item-', CAST(vec_id AS STRING)) AS id,
  CASE WHEN vec_id % 3 = 0 THEN CONCAT('/Volumes/V', CAST(label AS STRING), '/clip_', CAST(CAST(FLOOR(vec_id / 30.0) AS BIGINT) AS STRING), '.mp4')
       ELSE CONCAT('/Volumes/V', CAST(label AS STRING), '/img_', CAST(vec_id AS STRING), '.jpg') END AS file_path,
  CASE WHEN vec_id % 3 = 0 THEN 'video/frame' ELSE 'image/jpeg' END AS mime_type,
  CASE WHEN vec_id % 3 = 0 THEN 'video_frame' END AS source_type,
  CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 30 AS DOUBLE) END AS timestamp_s,
  CASE WHEN vec_id % 3 = 0 THEN CONCAT('{"source_type":"video_frame","width":512,"height":288,"frame_number":', CAST(vec_id % 30 AS STRING), '}')
       ELSE '{"dimensions":{"width":640,"height":480},"aspect_ratio":1.3333}' END AS metadata,
  CONCAT('vol-', CAST(label AS STRING)) AS drive_uuid,
  1704067200 + vec_id * 60 AS created_s, 1704067200 + (vec_id % 97) * 3600 AS updated_s, embedding
FROM embeddings""",
    "shown_items": """SELECT vec_id AS item_no, CONCAT('item-', CAST(vec_id AS STRING)) AS id, CASE WHEN vec_id % 17 = 0 THEN 'reference_image' END AS type,
  CASE WHEN vec_id % 29 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN CONCAT('/Volumes/V', CAST(label AS STRING), '/my%20clip_', CAST(CAST(FLOOR(vec_id / 30.0) AS BIGINT) AS STRING), '.mp4')
       WHEN vec_id % 7 = 0 THEN CONCAT('/Volumes/V', CAST(label AS STRING), '/a+b_', CAST(vec_id AS STRING), '.mp3')
       WHEN vec_id % 7 = 1 THEN CONCAT('/Volumes/V', CAST(label AS STRING), '/note_', CAST(vec_id AS STRING), '.txt')
       WHEN vec_id % 7 = 2 THEN CONCAT('/100%/img_', CAST(vec_id AS STRING), '.jpg')
       ELSE CONCAT('/Volumes/V', CAST(label AS STRING), '/img_', CAST(vec_id AS STRING), '.jpg') END AS file_path,
  CASE WHEN vec_id % 3 = 0 THEN 'video/frame' WHEN vec_id % 5 = 0 THEN 'image/jpeg' END AS mime_type,
  CASE WHEN vec_id % 3 = 0 THEN 'video_frame' WHEN vec_id % 23 = 0 THEN 'transcript_chunk' END AS source_type,
  CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 30 AS DOUBLE) END AS timestamp,
  CASE WHEN vec_id % 3 = 0 THEN CONCAT('00:', LPAD(CAST(vec_id % 30 AS STRING), 2, '0')) END AS timestamp_formatted,
  CASE WHEN vec_id % 31 = 0 THEN '{"frame_count":3}' WHEN vec_id % 37 = 0 THEN '{"isReferenceImage":true}' WHEN vec_id % 23 = 0 THEN '{"time_start_seconds":2.5,"video_path":"/films/one.mp4"}' ELSE '{}' END AS metadata
FROM embeddings""",
    "volumes": """SELECT CONCAT('vol-', CAST(n_nationkey AS STRING)) AS uuid, n_name AS name,
  CONCAT('/Volumes/V', CAST(n_nationkey AS STRING)) AS mount_path,
  CASE WHEN n_regionkey = 0 THEN 'disconnected' ELSE 'connected' END AS status
FROM nation""",
    "jobs": """SELECT event_id AS job_no, CASE WHEN event_id % 5 = 0 THEN 'transcription' ELSE 'file' END AS job_type,
  CONCAT('/Volumes/V', CAST(user_id % 25 AS STRING), '/f_', CAST(event_id % 700 AS STRING),
    CASE WHEN event_id % 4 = 0 THEN '.pdf' WHEN event_id % 4 = 1 THEN '.jpg' WHEN event_id % 4 = 2 THEN '.mp4' ELSE '.xyz' END) AS target_path,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
  CASE WHEN event_id % 10 = 0 THEN CONCAT('worker_', CAST(event_id % 2 + 1 AS STRING)) END AS current_file,
  event_id % 4 AS retry_count, 3 AS max_retries, ts AS created_at,
  CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS completed_at, ts AS updated_at,
  CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL '8' MINUTE END AS next_retry_at
FROM events""",
    "doc_files": """SELECT doc_id, CONCAT('/Volumes/V', CAST(doc_id % 25 AS STRING), '/', source, '/doc_', CAST(doc_id AS STRING), '.txt') AS file_path, text, lang, n_chars
FROM documents""",
    "segments": """SELECT conv_id, CONCAT('/Volumes/V', CAST(conv_id % 25 AS STRING), '/talk_', CAST(conv_id AS STRING), '.mp4') AS file_path, turn AS seg_no,
  CAST(turn AS DOUBLE) * CAST(5 AS DOUBLE) AS start_s, CAST(turn AS DOUBLE) * CAST(5 AS DOUBLE) + CAST(4.5 AS DOUBLE) AS end_s, text
FROM conversations""",
    "snap_old": """SELECT CONCAT('wf_', CAST(page_id % 3 AS STRING)) AS folder_id, url AS file_path, page_id,
  CONCAT(CAST(LENGTH(html) AS STRING), ':', CAST(page_id AS STRING)) AS content_sig, CAST(page_id AS STRING) AS last_index_job_id
FROM pages WHERE page_id % 10 <> 0""",
    "snap_new": """SELECT CONCAT('wf_', CAST(page_id % 3 AS STRING)) AS folder_id, url AS file_path, page_id,
  CONCAT(CAST(LENGTH(html) AS STRING), ':', CAST(CASE WHEN page_id % 5 = 1 THEN page_id + 1 ELSE page_id END AS STRING)) AS content_sig
FROM pages WHERE page_id % 7 <> 0""",
    "generations": "SELECT o_orderkey AS gen_no, o_orderpriority AS source, o_orderdate AS created_at FROM orders",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table; only the columns that a query reads are scanned."""
    found = re.fullmatch(r"(.*\bFROM )(\w+)(\b.*)", VIEWS[name], re.S)
    table = spark.read.parquet(f"{sf_dir}/{found[2]}.parquet")
    plain = [part.replace("{", "{{").replace("}", "}}") for part in (found[1], found[3])]
    return spark.sql(f"{plain[0]}{{source}}{plain[1]}", source=table)


def ctes(*names: str) -> str:
    """WITH and the views' texts, for SQL over the raw tables."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
