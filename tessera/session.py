"""Session factory and the one semantic profile every query runs under."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOG = logging.getLogger("tessera")

#: Null on error instead of exceptions, zone-less timestamps, runtime re-planning.
PROFILE = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def profile(spark: SparkSession) -> SparkSession:
    """Set PROFILE on a session that someone else made; returns that session."""
    for key, value in PROFILE.items():
        spark.conf.set(key, value)
    return spark


def session(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """Get or create a session with PROFILE and ``conf`` on top."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**PROFILE, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return profile(builder.getOrCreate())


@contextmanager
def described(spark: SparkSession, action: str) -> Iterator[list[str]]:
    """Around an action: as many of its callers' frames as ``tessera.call_stack_depth`` says (none by default) are logged and describe its jobs."""
    depth = int(spark.conf.get("tessera.call_stack_depth", "0"))
    frames = [f"{f.filename}:{f.lineno} - {f.function}" for f in inspect.stack()[2 : 2 + depth]]  # without this one and contextlib's
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    if frames:
        LOG.info("%s called at:\n%s", action, "\n".join(frames))
        context.setJobDescription(f"{action} at {frames[0]}")
    try:
        yield frames
    finally:
        context.setLocalProperty("spark.job.description", before)
