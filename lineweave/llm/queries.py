"""Registered queries of the corpus operators."""

from __future__ import annotations

from ..plans import table as t
from . import contamination, packing, pii, secrets, toxicity

QUERIES: dict = {}
SQL: dict = {}

QUERIES["p7_found"] = lambda s, d: contamination.find_leaks(t(s, d, "documents"), t(s, d, "eval_items"))
QUERIES["p8_found"] = lambda s, d: toxicity.find_toxic(t(s, d, "documents"), t(s, d, "doc_labels"))
QUERIES["p8_rates"] = lambda s, d: toxicity.rates_per_source(t(s, d, "documents"), t(s, d, "doc_labels"))
QUERIES["p5_found"] = lambda s, d: secrets.find_secrets(t(s, d, "line_matches"), t(s, d, "file_results"))
QUERIES["p5_redacted"] = lambda s, d: secrets.redact_lines(t(s, d, "line_matches"), t(s, d, "file_results"))
QUERIES["p6_packed"] = lambda s, d: packing.pack_documents(t(s, d, "documents"))
QUERIES["p2_found"] = lambda s, d: pii.find_pii(t(s, d, "line_matches"), t(s, d, "mapping_entries"), t(s, d, "samples"))
QUERIES["p2_redacted"] = lambda s, d: pii.redact_pii(t(s, d, "line_matches"), t(s, d, "mapping_entries"), t(s, d, "samples"))
