"""Carrying out a plan on files: deleting them, or moving them away. Each file is an action of its own, and its
outcome a row; nothing here is done unless it is called."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried_out(paths: DataFrame, act: Callable[[str], None], done: str) -> DataFrame:
    """(path, status): `done`, or failed where `act` raised an error. Staged, so that no action is repeated by reading
    the result; a file that a repeated task finds gone counts as done."""
    from lookalike.session import stage_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    act(path)
                    found.append(done)
                except OSError:
                    found.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "status"])

    once = paths.select("path").where(F.col("path").isNotNull()).distinct()
    return stage_table(once.mapInArrow(run, "path string, status string"), "actions")


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def delete(paths: DataFrame) -> DataFrame:
    """Files, links (not what they point at) and whole folders."""

    def act(path: str) -> None:
        at = local(path)
        shutil.rmtree(at) if os.path.isdir(at) and not os.path.islink(at) else os.remove(at)

    return carried_out(paths, act, "deleted")


def trash(paths: DataFrame, folder: str) -> DataFrame:
    """Moves files into a folder under names that keep their whole path, so that none meet and all can be put back."""

    def act(path: str) -> None:
        at = local(path)
        os.makedirs(folder, exist_ok=True)
        os.replace(at, os.path.join(folder, at.strip("/").replace("%", "%25").replace("/", "%2F")))

    return carried_out(paths, act, "deleted")


def move(plan: DataFrame) -> DataFrame:
    """(path, status) of a plan (src, dst, status) as views.move_plan makes it: rows it fails are left alone, and no file is
    ever put over another."""

    def act(pair: str) -> None:
        src, dst = pair.split("\0")
        if os.path.lexists(local(dst)):
            raise FileExistsError(dst)
        os.makedirs(os.path.dirname(local(dst)), exist_ok=True)
        os.rename(local(src), local(dst))

    pairs = plan.where(F.col("status") == "moved").select(F.concat("src", F.lit("\0"), "dst").alias("path"))
    done = carried_out(pairs, act, "moved").select(F.split("path", "\0")[0].alias("path"), "status")
    return done.union(plan.where(F.col("status") != "moved").select("src", "status"))
