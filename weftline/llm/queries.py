"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from . import collocations, divergence, exact_dedup, html_text, langid, licenses, mixing, near_dedup, neighbours, pieces, pitman_yor, suffix_dedup, warc

_MODULES = (neighbours, pieces, mixing, suffix_dedup, licenses, html_text, exact_dedup, near_dedup, pitman_yor, langid, collocations, warc, divergence)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
