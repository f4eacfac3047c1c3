"""quire: document corpora as DataFrames (packages, blocks, notes, metadata, diagnostics)."""

from quire.session import session

__all__ = ["session"]
