"""All queries of this subpackage and their SQL."""

from eventlens.llm import bpe, collocations, decontaminate, hmm, html, jaccard, licences, neighbours, quality, repair, token_counts, tool_calls, topk  # noqa: F401  (fills the registry)
from eventlens.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
