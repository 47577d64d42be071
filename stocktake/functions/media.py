"""Reading what media tools print, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocktake.functions.scalars import rotation_swaps

# Formats by the name that the tools give them.
IMAGE_TYPES = {"JPEG": "image/jpeg", "PNG": "image/png", "GIF": "image/gif", "BMP": "image/bmp", "TIFF": "image/tiff", "WEBP": "image/webp", "HEIC": "image/heic", "CR2": "image/x-canon-cr2"}
VIDEO_TYPES = {"mov": "video/mp4", "matroska": "video/webm", "avi": "video/x-msvideo", "ogg": "video/ogg", "asf": "video/x-ms-wmv", "mpeg": "video/mpeg", "mpegvideo": "video/mpeg", "mpegts": "video/mp2t"}

_PROBE = "streams array<struct<width: long, height: long, duration: string, side_data_list: array<struct<rotation: double>>, tags: struct<rotate: string>>>, format struct<format_name: string, duration: string>"


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, mime in table.items():
        out = F.when(value == name, mime).otherwise(out)
    return out


def image_probe(printed: Column | str) -> Column:
    """``(mime_type, width, height)`` from ``FORMAT|width|height``; null for other formats or numbers."""
    text = F.col(printed) if isinstance(printed, str) else printed
    parts = F.split(F.split(F.trim(text), "\n")[0], r"\|")
    mime, width, height = _lookup(parts[0], IMAGE_TYPES), F.get(parts, F.lit(1)).try_cast("long"), F.get(parts, F.lit(2)).try_cast("long")
    return F.when(mime.isNotNull() & width.isNotNull() & height.isNotNull(), F.struct(mime.alias("mime_type"), width.alias("width"), height.alias("height")))


def video_probe(printed: Column | str) -> Column:
    """``(mime_type, width, height, duration_seconds)`` from a JSON answer.

    The video stream's own duration goes before the container's; a rotation by
    90 or 270 degrees (of the side data before that of the tags) swaps the sides.
    """
    answer = F.from_json(F.col(printed) if isinstance(printed, str) else printed, _PROBE)
    stream = F.get(answer["streams"], F.lit(0))
    mime = _lookup(F.split(answer["format"]["format_name"], ",")[0], VIDEO_TYPES)
    duration = F.coalesce(stream["duration"].try_cast("double"), answer["format"]["duration"].try_cast("double"))
    side = F.get(F.filter(F.transform(stream["side_data_list"], lambda s: s["rotation"]), lambda r: r.isNotNull()), F.lit(0))
    swapped = F.coalesce(rotation_swaps(F.coalesce(side, stream["tags"]["rotate"].try_cast("double"), F.lit(0.0)).cast("long")), F.lit(False))
    width, height = F.when(swapped, stream["height"]).otherwise(stream["width"]), F.when(swapped, stream["width"]).otherwise(stream["height"])
    found = mime.isNotNull() & width.isNotNull() & height.isNotNull() & duration.isNotNull()
    return F.when(found, F.struct(mime.alias("mime_type"), width.alias("width"), height.alias("height"), duration.alias("duration_seconds")))


def probed(image: Column | str, video: Column | str) -> Column:
    """``(kind, mime_type, width, height, duration_seconds)``: an image, else a video, else unreadable."""
    i, v = image_probe(image), video_probe(video)
    kind = F.when(i.isNotNull(), "image").when(v.isNotNull(), "video").otherwise("unreadable")
    return F.struct(kind.alias("kind"), F.coalesce(i["mime_type"], v["mime_type"]).alias("mime_type"), F.coalesce(i["width"], v["width"]).alias("width"), F.coalesce(i["height"], v["height"]).alias("height"), F.when(i.isNull(), v["duration_seconds"]).alias("duration_seconds"))
