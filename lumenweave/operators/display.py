"""What a listing shows of each row: kind, name, parent folder, place in a video; and how a listing is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.classify import IMAGE, VIDEO, base_name
from lumenweave.operators.ranks import numbered

# Audio by extension where no media type is known; columns that a row may have.
AUDIO = ["mp3", "wav", "ogg"]
OPTIONAL = {
    "id": "string", "type": "string", "mime_type": "string", "metadata": "string", "source_type": "string", "chunk_index": "long", "timestamp": "double", "timestamp_formatted": "string",
    "snippet": "string", "frame_number": "long", "video_duration": "double", "parent_file_path": "string",
}
SORTS = ("name", "type", "size", "modified")


def decoded(path: Column) -> Column:
    """Percent escapes as characters; a path that is no valid escape, or no UTF-8, stays as it is."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    broken = plain.isNull() | (F.contains(plain, F.lit("�")) & ~F.contains(path, F.lit("�")))
    return F.when(F.contains(path, F.lit("%")) & ~broken, plain).otherwise(path)


def parent(path: Column) -> Column:
    """The folder above; null for none or for the root."""
    found = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(?s)^(.+)/[^/]*$", 1)
    return F.when(found != "", found)


def display_rows(rows: DataFrame) -> DataFrame:
    """Adds shown_path, shown_name, shown_type, shown_parent, shown_source, shown_at, shown_clock and shown_snippet.

    Rows without a path and reference images are left out. Columns of OPTIONAL that rows lack
    count as null; metadata that is no JSON counts as empty. A word or number in the metadata
    that says no (false, 0) is no mark of a reference image.
    """
    row = {c: (F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)) for c, t in OPTIONAL.items()}
    meta = lambda name: F.get_json_object(row["metadata"], f"$.{name}")
    some = lambda c: F.when(c != "", c)
    path = decoded(F.col("file_path"))
    mime, mark = F.coalesce(row["mime_type"], F.lit("")), meta("isReferenceImage")
    source = F.lower(F.coalesce(row["source_type"], meta("source_type")))
    is_ = lambda *names: F.coalesce(source.isin(*names), F.lit(False))
    transcript, text = is_("transcript_chunk"), is_("text_chunk", "text_document") | row["chunk_index"].isNotNull()
    many = F.coalesce(meta("frame_count").try_cast("double") > 0, F.lit(False))
    grouped = ~transcript & ((mime.startswith("video/") & (mime != "video/frame") & ~text) | is_("video") | many)
    in_video = is_("video_frame") | row["frame_number"].isNotNull() | row["video_duration"].isNotNull() | (mime == "video/frame") | F.coalesce(F.contains(row["id"], F.lit(":frame:")), F.lit(False))
    frame = ~grouped & ~transcript & in_video
    name = base_name(path)
    ext = F.lower(F.substring_index(name, ".", -1))
    kind = (
        F.when(grouped, "video").when(frame, "image").when(transcript, "video").when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio")
        .when(ext.isin(AUDIO), "audio").when(ext.isin(VIDEO), "video").when(ext.isin(IMAGE), "image").otherwise("document")
    )
    clock = F.coalesce(some(row["timestamp_formatted"]), some(meta("timestamp_formatted")), some(meta("time_start_formatted")))
    timed = frame | transcript
    video = F.coalesce(*(some(meta(n)) for n in ("video_path", "source_path", "original_path")))
    reference = (row["type"] == "reference_image") | (~mark.rlike(r"^(false|-?0+(\.0+)?)?$"))
    return rows.where((F.col("file_path") != "") & ~F.coalesce(reference, F.lit(False))).withColumns({
        "shown_path": path, "shown_name": F.when(frame & clock.isNotNull(), F.concat_ws(" @ ", name, clock)).otherwise(name), "shown_type": kind,
        "shown_parent": F.coalesce(some(decoded(row["parent_file_path"])), parent(video), parent(path)),
        "shown_source": F.when(grouped, "grouped_video").when(frame, "video_frame").when(transcript, "transcript_chunk").when(text, F.coalesce(some(source), F.lit("text_chunk"))).otherwise(source),
        "shown_at": F.when(timed, F.coalesce(row["timestamp"], meta("time_start_seconds").try_cast("double"))), "shown_clock": F.when(timed, clock),
        "shown_snippet": F.coalesce(some(row["snippet"]), meta("snippet")),
    })


def one_per_video(shown: DataFrame, order: str) -> DataFrame:
    """shown: display_rows. Frames whose name tells their time become one row a video, that of the least order, named and shown as the video.

    The least row is found by a partial aggregate, so a video with very many frames is no task's load.
    """
    frame = F.coalesce((F.col("shown_source") == "video_frame") & F.contains("shown_name", F.lit(" @ ")), F.lit(False))
    video = F.concat_ws("/", F.coalesce("shown_parent", F.lit("")), F.substring_index("shown_name", " @ ", 1))
    first = shown.where(frame).groupBy(video.alias("__video")).agg(F.min_by(F.struct(*shown.columns), order).alias("__row")).select("__row.*")
    named = first.withColumns({"shown_name": F.substring_index("shown_name", " @ ", 1), "shown_type": F.lit("video")})
    return shown.where(~frame).unionByName(named)


def sort_listing(shown: DataFrame, field: str, ascending: bool = True, key: str = "id") -> DataFrame:
    """Sorted by name, type (shown_*), size or modified, ties by key; other fields leave the rows as they are. Names order by lower case, then as they are written."""
    if field not in SORTS:
        return shown
    by = {
        "name": [F.lower("shown_name"), F.col("shown_name")], "type": [F.col("shown_type")],
        "size": [F.coalesce("size", F.lit(0))], "modified": [F.col("modified")],
    }[field]
    return shown.orderBy(*(c.asc_nulls_first() if ascending else c.desc_nulls_last() for c in by), key)


def collated(name: Column, collation: str = "UNICODE") -> Column:
    """A name as it sorts for readers: by base letters first, then accents, then case, lower before upper ("de", "sv", ...: by the rules of that language)."""
    return F.collate(name, collation)


def ranked_listing(shown: DataFrame, field: str = "name", ascending: bool = True, key: str = "id", collation: str = "UNICODE") -> DataFrame:
    """shown with rank (from 0) in the order of name (collated), type, size or modified, ties by name, then by key.

    Rows are numbered by ranges, so a listing of any size has its ranks without a task that sorts all of it.
    """
    if field not in SORTS:
        raise ValueError(f"a listing is sorted by one of {SORTS}")
    name = collated(F.col("shown_name"), collation)
    first = {"name": name, "type": F.col("shown_type"), "size": F.coalesce("size", F.lit(0)) if "size" in shown.columns else None, "modified": F.col("modified") if "modified" in shown.columns else None}[field]
    if first is None:
        raise ValueError(f"the listing has no {field}")
    by = [first.asc_nulls_first() if ascending else first.desc_nulls_last()]
    if field != "name":
        by.append(name.asc_nulls_first())
    return numbered(shown, [], [*by, F.col("shown_name"), key]).withColumnRenamed("pos", "rank")


def newest(rows: DataFrame, at: str, key: str) -> DataFrame:
    """Listing order of volumes (last_seen), generations and watched folders (created_at): newest first, ties by key."""
    return rows.orderBy(F.desc_nulls_last(at), key)


def usage_left(uses: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """limits: key, most (text such as '600s'); uses: key, duration (text). key, used_seconds and left_seconds, by the whole numbers that the texts begin with; one without any makes the sum null."""
    number = lambda c: F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")
    n = uses.withColumn("__n", number("duration")).groupBy(key).agg(F.when(F.count_if(F.col("__n").isNull()) == 0, F.sum("__n")).alias("__used"), F.lit(True).alias("__any"))
    used = F.when(F.col("__any"), F.col("__used")).otherwise(F.lit(0).cast("long"))
    return limits.join(n, key, "left").select(key, used.alias("used_seconds"), (number("most") - used).alias("left_seconds"))
