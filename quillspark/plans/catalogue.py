"""Every query of the archive engine by name, with its DuckDB SQL."""

from __future__ import annotations

from . import clients, completion, exports, fields, governance, identity, messages, operations, polling, resolution, rules, stores, streams, transcripts, transfers  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
