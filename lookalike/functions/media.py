"""Column expressions over sizes, resolutions, scores and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WATERMARK_FREE, WATERMARK_SLOPE, WATERMARK_MOST = 0.012, 12.0, 0.30
BUCKET_STEP = 1.12


def sides(resolution: str = "resolution") -> Column:
    """struct(w, h) of "WxH" in either case, null unless both are positive whole numbers."""
    parts = F.split(F.lower(F.trim(F.col(resolution))), "x")
    w, h = (F.trim(F.get(parts, F.lit(i))).try_cast("bigint") for i in (0, 1))
    return F.when((F.size(parts) == 2) & (w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))


def area(resolution: str = "resolution") -> Column:
    s = sides(resolution)
    return F.coalesce(s["w"] * s["h"], F.lit(0).cast("bigint"))


def finite(column: str) -> Column:
    """Null and NaN read as 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def penalty(watermark: str = "watermark") -> Column:
    score = finite(watermark)
    return F.when(score <= WATERMARK_FREE, 0.0).otherwise(F.least(F.lit(WATERMARK_MOST), (score - WATERMARK_FREE) * WATERMARK_SLOPE))


def effective_area(resolution: str = "resolution", watermark: str = "watermark", content_ratio: Column | None = None) -> Column:
    """Pixels that show something: without dark bars, where their share is known, and less for a watermark."""
    ratio = F.lit(1.0) if content_ratio is None else F.coalesce(content_ratio, F.lit(1.0))
    return area(resolution) * ratio * (1.0 - penalty(watermark))


def bucket(of: Column) -> Column:
    """Area on a logarithmic scale, rounded half to even; 0 up to one pixel."""
    return F.when(of <= 1, F.lit(0.0)).otherwise(F.bround(F.log(of) / F.log(F.lit(BUCKET_STEP))))


def smart_score() -> Column:
    sharp = finite("sharpness")
    pixels = area() / F.lit(1_000_000.0)
    return finite("size") / F.lit(1_048_576.0) + 50.0 * pixels + 10.0 * finite("duration") + F.when(sharp > 0, 20.0 * F.log1p(sharp)).otherwise(0.0)


def quality_score(content_ratio: Column | None = None) -> Column:
    return effective_area(content_ratio=content_ratio) + finite("sharpness")


def size_mb(size: str = "size") -> Column:
    return F.when(F.col(size).isNotNull(), F.format_string("%.1f MB", F.col(size) / F.lit(1_048_576.0)))


def minutes_seconds(seconds: str = "duration") -> Column:
    whole = finite(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def hours_minutes_seconds(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole).cast("int")).otherwise(0)


def similarity_percent(similarity: str = "similarity") -> Column:
    """With one decimal, as a number."""
    return F.round(F.round(F.col(similarity) * 1000, 6)) / 10


def aspect(resolution: str = "resolution") -> Column:
    s = sides(resolution)
    return s["w"] / s["h"]


def stacking(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "TopToBottom").otherwise("LeftToRight")


def thumbnail_key() -> Column:
    """Name of a file's thumbnail: changes with path, size and mtime."""
    return F.md5(F.concat_ws("|", "path", F.col("size").cast("string"), F.round(F.col("mtime") * 1000).cast("bigint").cast("string")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def bars(slider: float, mode: str = "visual", centred: bool = True) -> tuple[float, float]:
    """(bar, prefilter) of a slider position from 0 to 1."""
    if mode == "faces":
        return 0.42 + 0.30 * slider, 0.42 + 0.30 * slider
    bar = 0.30 + 0.45 * slider if centred else slider
    return bar, max(0.0, bar - 0.18)
