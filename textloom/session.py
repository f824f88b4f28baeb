"""A SparkSession with the settings the operators expect; existing sessions are used as they are."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow transfer and UTC, unless overridden by ``conf``; the package goes to the workers.

    On one machine checkpoints go to a temporary folder unless ``spark.checkpoint.dir`` is set; a cluster has to name a
    shared one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, wherever it was imported from."""
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)


@contextmanager
def progress(spark: SparkSession, say=print, every: float = 10.0):
    """Says how many tasks of the running stages are done, every so many seconds, while its block runs."""
    done, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def watch():
        while not done.wait(every):
            infos = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
            if infos:
                say(", ".join(f"stage {i.stageId}: {i.numCompletedTasks} of {i.numTasks} tasks" + (f", {i.numFailedTasks} failed" if i.numFailedTasks else "") for i in infos))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
