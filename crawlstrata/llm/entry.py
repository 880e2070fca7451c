"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from crawlstrata.llm import bpe, contextmix, decontaminate, hardnegatives, linecrf, quality, secretscan, sharding, simhash, suffixdedup, tokenalign, toxicity, urltree

MODULES = (sharding, linecrf, toxicity, urltree, quality, suffixdedup, contextmix, decontaminate, bpe, simhash, secretscan, tokenalign, hardnegatives)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
