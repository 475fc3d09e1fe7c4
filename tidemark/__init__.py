"""tidemark: point-in-time analytics on event, quote and trade tables, written for PySpark."""

from tidemark.session import build_session, configure, workspace_dir

__all__ = ["build_session", "configure", "workspace_dir"]
