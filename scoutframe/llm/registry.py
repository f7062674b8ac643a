"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from scoutframe.llm import ann, bpe, chat, exact, jaccard, lloyd, pack, passages, quality, shard, spelling, suffixes, toxicity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (ann, bpe, chat, exact, jaccard, lloyd, quality, pack, passages, shard, spelling, suffixes, toxicity):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
