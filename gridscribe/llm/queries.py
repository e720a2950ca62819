"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}
for _name in ("chat", "langid", "minhash", "suffixlm", "quality", "decontam", "pii", "tokencounts", "media", "mixing"):
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(getattr(_module, "ORACLE", {}))
