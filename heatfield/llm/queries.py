"""All queries of this subpackage and the SQL of those that SQL can express."""

from heatfield.llm import exact_dedup, html_text, jaccard_join, langid, licenses, media, mixing, pii, sentencepiece_lattice, spelling, tokens, vector_codes, warc

MODULES = (exact_dedup, sentencepiece_lattice, media, mixing, tokens, licenses, langid, html_text, jaccard_join, pii, spelling, warc, vector_codes)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
