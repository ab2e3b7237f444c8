"""All queries of this package; importing it registers them."""

from quirework.llm import arrow_tokens, bin_config, blob_ledger, divergence, kneser_ney, license_join, mixture_language, periodic_runs, qgram_bands, simhash_tree, token_alignment, token_spans, tool_calls  # noqa: F401
from quirework.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
