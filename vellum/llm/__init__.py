"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from . import decontamination, importance, license_scan, near_dups, ngram_join, packing, quality_rules, substring_dedup, token_counts, toxicity, url_filter, warc, whitening

_MODULES = (substring_dedup, ngram_join, decontamination, license_scan, toxicity, url_filter, warc, token_counts, quality_rules, packing, importance, near_dups, whitening)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
