"""What a row is: media types, names, errors, routes. All of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by kind.
IMAGE = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif"]
VIDEO = ["mp4", "mov", "avi", "webm", "mkv", "flv", "wmv", "m4v"]
TEXT = ["txt", "md", "markdown", "json", "csv", "log", "xml", "yml", "yaml", "toml", "ini", "conf", "rtf", "pdf"]
AUDIO_JOB = ["wav", "mp3", "m4a", "flac", "ogg", "aac", "wma"]
FILTER_IMAGE = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "avif", "svg"]
FILTER_AUDIO = ["mp3", "wav", "ogg", "flac", "aac", "m4a", "aiff"]
FILTER_DOCUMENT = ["txt", "md", "markdown", "pdf", "doc", "docx", "rtf", "json", "csv", "html", "htm", "xml", "yaml", "yml", "toml", "ini", "log"]
PREVIEW_AUDIO = ["mp3", "wav", "ogg", "m4a", "aac", "flac"]
NOT_USER = ["dylib", "so", "o", "a", "nib", "storyboardc", "car", "plist", "strings", "lproj", "metallib", "dsym"]
# Names that are never indexed.
BUNDLES = [".app", ".framework", ".xpc", ".bundle", ".plugin", ".kext", ".dSYM"]
SYSTEM_NAMES = ["DS_Store", "Thumbs.db", "desktop.ini"]
EXCLUDED_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "bower_components", "jspm_packages", ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".sass-cache", ".nyc_output", "target", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache",
    ".gradle", ".m2", "Pods", "DerivedData", "dist", "build", ".cache", "vendor", "coverage", "tmp", ".tmp", "discovery_cache", "Library", "Applications", "System", "Caches", "Logs", "WebKit", "GPUCache", "ShaderCache", "Code Cache", "CachedData", "CachedExtensions",
]
# Parts of messages that tell whether a retry may help.
TEMPORARY = ["timeout", "connection", "network", "busy", "locked", "memory", "temporary", "ffmpeg not available", "temporarily", "resource temporarily", "try again", "out of memory", "lock timeout", "file creation failed", "server temporarily", "unreachable", "unavailable", "process crashed", "disk full", "refused"]
PERMANENT = ["not found", "permission denied", "corrupted", "invalid format", "unsupported", "decode", "format", "access denied", "could not be found", "file not found", "invalid image", "invalid video", "malformed", "does not exist"]
# Kinds of failure to open an image, and what they are called.
OPEN_ERRORS = {"permission_denied": "PERMISSION_DENIED", "not_found": "FILE_NOT_FOUND", "would_block": "FILE_LOCKED", "io": "IO_ERROR", "unsupported": "UNSUPPORTED_FORMAT", "decoding": "CORRUPTED_FILE"}
SOURCE_LABELS = {"text_chunk": "text", "transcript_chunk": "transcript", "video_frame": "video frame"}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case, without the dot; '' for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def _json(meta: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.get_json_object(meta, f"$.{name}")), F.lit(""))


def is_hidden_or_system(name: Column) -> Column:
    ends = F.lit(False)
    for b in BUNDLES:
        ends = ends | name.endswith(b)
    return name.startswith(".") | ends | name.isin(SYSTEM_NAMES + EXCLUDED_DIRS)


def extension_class(path: Column) -> Column:
    """image, video, text, system (never indexed) or other."""
    e = extension(path)
    return F.when(e.isin(IMAGE), "image").when(e.isin(VIDEO), "video").when(e.isin(TEXT), "text").when(e.isin(NOT_USER), "system").otherwise("other")


def matches_media_type(kind: str | None, path: Column, mime: Column, source_type: Column, metadata: Column, chunk_index: Column | None = None) -> Column:
    """Whether a row is of the kind asked for (image, video, audio, document); all, blank and unknown kinds take every row."""
    kind = (kind or "").strip().lower()
    if kind not in ("image", "video", "audio", "document"):
        return F.lit(True)
    mime, source = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(source_type, F.lit("")))
    meta, ext = _json(metadata, "source_type"), extension(path)
    any_of = lambda *names: source.isin(*names) | meta.isin(*names)
    image = mime.startswith("image/") | any_of("video_frame") | ext.isin(FILTER_IMAGE)
    video = mime.startswith("video/") | any_of("video") | (any_of("transcript_chunk") & (_json(metadata, "source_media_type") == "video")) | ext.isin(VIDEO)
    audio = mime.startswith("audio/") | ext.isin(FILTER_AUDIO)
    text = any_of("text_chunk", "text_document", "transcript_chunk") | (chunk_index.isNotNull() if chunk_index is not None else F.lit(False))
    document = ~(image | video | audio) & (text | (mime != "") | ext.isin(FILTER_DOCUMENT))
    return {"image": image, "video": video, "audio": audio, "document": document}[kind]


def is_frame(row_id: Column, mime: Column, metadata: Column, timestamp: Column, duration: Column) -> Column:
    rules = [timestamp.isNotNull() & duration.isNotNull(), mime == "video/frame", F.contains(row_id, F.lit(":frame:")), F.get_json_object(metadata, "$.source_type") == "video_frame"]
    found = F.lit(False)
    for r in rules:
        found = found | F.coalesce(r, F.lit(False))
    return found


def categorize_error(message: Column) -> Column:
    """temporary before permanent before unknown, by parts of the message in any case."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: text.rlike("|".join(words))  # noqa: E731  the words hold no pattern characters
    return F.when(has(TEMPORARY), "temporary").when(has(PERMANENT), "permanent").otherwise("unknown")


def categorize_open_error(kind: Column) -> Column:
    found = F.lit("UNKNOWN_ERROR")
    for k, name in OPEN_ERRORS.items():
        found = F.when(kind == k, name).otherwise(found)
    return found


def display_type(path: Column, mime: Column, source_type: Column, metadata: Column) -> Column:
    """How a row is shown: video, transcript, document, image, audio or file."""
    source = F.lower(F.coalesce(source_type, F.get_json_object(metadata, "$.source_type"), F.lit("")))
    m, e = F.lower(F.coalesce(mime, F.lit(""))), extension(path)
    return (
        F.when(source == "video_frame", "video").when(source == "transcript_chunk", "transcript").when(source.isin("text_chunk", "text_document"), "document")
        .when(m.startswith("image/") | e.isin(IMAGE), "image").when(m.startswith("video/") | e.isin(VIDEO), "video").when(m.startswith("audio/") | e.isin(PREVIEW_AUDIO), "audio")
        .when(m.startswith("text/") | e.isin(TEXT), "document").otherwise("file")
    )


def preview_kind(path: Column, mime: Column, metadata: Column) -> Column:
    m, e = F.lower(F.coalesce(mime, F.lit(""))), extension(path)
    return (
        F.when(_json(metadata, "source_type").isin("video_frame", "transcript_chunk"), "video").when(m.startswith("image/") | e.isin(IMAGE), "image")
        .when(m.startswith("video/") | e.isin(VIDEO), "video").when(m.startswith("audio/") | e.isin(PREVIEW_AUDIO), "audio").otherwise("document")
    )


def source_label(source_type: Column) -> Column:
    named = F.replace(source_type, F.lit("_"), F.lit(" "))
    for s, label in SOURCE_LABELS.items():
        named = F.when(source_type == s, label).otherwise(named)
    return F.when(source_type.isNull() | (source_type == ""), "indexed").otherwise(named)


def ui_type_matches(kind: str, shown_type: Column, frame: Column) -> Column:
    """Images leave frames out, videos take them in."""
    if kind == "image":
        return (shown_type == "image") & ~frame
    if kind == "video":
        return (shown_type == "video") | frame
    return shown_type == kind if kind in ("audio", "document") else F.lit(True)


def route_job(job_type: Column, path: Column) -> Column:
    """By type first, then extension. skip: completed without work; unsupported: failed."""
    e = extension(path)
    return (
        F.when(job_type == "transcription", "audio").when(e.isin(VIDEO), "video").when(e.isin(AUDIO_JOB), "skip").when(e.isin(TEXT), "text").when(e.isin(IMAGE), "image").otherwise("unsupported")
    )
