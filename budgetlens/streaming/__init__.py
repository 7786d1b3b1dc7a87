"""Structured Streaming form of the unit build.

The study is a batch analysis of one survey cross-section and has no streaming
operator. Because every build step is a pure projection and filter, the same
``build_units`` plan runs unchanged on a streaming source: new raw rows arriving
as files are rolled up, filtered and written incrementally, with the progress
kept in a checkpoint under ``spark.checkpoint.dir``.
"""

from .incremental import stream_units  # noqa: F401
