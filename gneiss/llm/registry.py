"""The queries of this package and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

import corpus_pipeline

from gneiss.llm import q_chat, q_decontaminate, q_jaccard, q_langid, q_mixing, q_pii, q_quality_model, q_quality_rules, q_repair, q_sharding, q_urls, q_warc, q_whitening

_MODULES = [q_quality_model, q_mixing, q_jaccard, q_quality_rules, q_repair, q_sharding, q_chat, q_pii, q_warc, q_langid, q_decontaminate, q_whitening, q_urls, q_repair]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
