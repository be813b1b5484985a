"""Document collections on Spark: sync, indexing, hybrid retrieval, entity graph, log reports."""

from leafmill.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
