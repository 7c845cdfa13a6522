"""Every registered query of the engine and, where SQL can express it, its DuckDB equivalent."""

from __future__ import annotations

from . import archive, assembly, contract, disputes, grammars, lifecycle, omissions, reads, records, serving, texts, views

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (lifecycle, reads, texts, grammars, records, contract, views, serving, disputes, omissions, archive, assembly):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
