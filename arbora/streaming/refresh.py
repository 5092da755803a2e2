"""Incremental refresh of a workspace from a stream of file versions.

An extension: each micro-batch holds new versions of files (rel_path, version,
source; a null source removes the file).  The last version of each file in the
batch replaces the known one, and the batch's id makes a replay harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.plans.workspace import Workspace


def latest(versions: DataFrame) -> DataFrame:
    """rel_path, source of each file's last version."""
    return versions.groupBy("rel_path").agg(F.max_by(F.struct("source"), "version").alias("x")).select("rel_path", F.col("x.source").alias("source"))


def apply_batch(workspace: Workspace, versions: DataFrame) -> dict[str, bool]:
    """Merge a batch into the workspace; which layers that dropped."""
    new = latest(versions)
    kept = workspace.files.join(new.select("rel_path"), "rel_path", "left_anti")
    return workspace.invalidate(kept.unionByName(new.where("source is not null")))


def follow(workspace: Workspace, stream: DataFrame, checkpoint: str, after: Callable[[int, dict[str, bool]], None] | None = None) -> StreamingQuery:
    """Keep a workspace up to date with a stream; ``after`` hears of every batch."""
    done: set[int] = set()

    def one(batch: DataFrame, number: int) -> None:
        if number not in done:
            dropped = apply_batch(workspace, batch)
            done.add(number)
            if after is not None:
                after(number, dropped)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
