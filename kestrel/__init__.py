"""kestrel: audit-log analytics as Spark DataFrame operators.

Layout:
  functions/  Column -> Column scalars (parsing, predicates, formatting)
  sources/    readers and writers (raw line folders, staged files, sinks)
  operators/  DataFrame -> DataFrame operators (parse, sessions, load, reports, ...)
  plans/      composed jobs and the query registry used by ``__spark_entry__``
  streaming/  Structured Streaming ingest and live sessions
"""

from kestrel.session import build_session, shared_dir, scratch_dir  # noqa: F401

__all__ = ["build_session", "shared_dir", "scratch_dir"]
