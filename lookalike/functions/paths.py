"""Column expressions over file paths, and kinds of media."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "heic"]
VIDEOS = ["mp4", "mov", "mkv", "webm", "avi", "m4v"]
DOCUMENTS = ["pdf", "cbz", "gif"]


def basename(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: str = "path") -> Column:
    return F.regexp_replace(F.col(path), "/[^/]*$", "")


def suffix(path: str = "path") -> Column:
    """Lower-cased last suffix without its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def kind(path: str = "path") -> Column:
    """image, video or document; in statistics all other files count as documents."""
    s = suffix(path)
    return F.when(s.isin(IMAGES), "image").when(s.isin(VIDEOS), "video").otherwise("document")


def shown_as(path: str, wanted: str) -> Column:
    """Whether a view of one kind shows the file: a document must be pdf, cbz or gif here."""
    return suffix(path).isin({"image": IMAGES, "video": VIDEOS, "document": DOCUMENTS}[wanted])


def under(path: str, root: str) -> Column:
    """Whether the path is the root or below it, by whole components."""
    root = root.rstrip("/")
    return (F.col(path) == root) | F.col(path).startswith(root + "/")


def holds_segment(path: str, segments: list[str]) -> Column:
    """Whether any of the segments is part of the lower-cased path, whole components only."""
    slashed = F.concat(F.lit("/"), F.lower(F.translate(F.col(path), "\\", "/")), F.lit("/"))
    return reduce(lambda a, b: a | b, (slashed.contains("/" + s.strip("/").lower() + "/") for s in segments), F.lit(False))


def normal(path: str = "path") -> Column:
    """An absolute path with doubled slashes, `.`, `..` and trailing slashes resolved; null and empty give null."""
    up = lambda done: F.regexp_replace(done, "/[^/]*$", "")
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", up(done)).otherwise(F.concat(done, F.lit("/"), part))
    found = F.aggregate(F.split(F.col(path), "/"), F.lit(""), step)
    return F.when(F.col(path) != "", F.when(found == "", "/").otherwise(found))


def matches_text(path: str, query: str) -> Column:
    return F.lower(basename(path)).contains(query.lower())
