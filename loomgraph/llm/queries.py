"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from loomgraph.llm import corpus_encoding, eval_leakage, format_duplicates, look_alikes, name_variants, residue, sentences, splitting, term_frequency

_MODULES = (format_duplicates, term_frequency, look_alikes, sentences, splitting, name_variants, corpus_encoding, eval_leakage, residue)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
