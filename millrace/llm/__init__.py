"""Operators for preparing text corpora: dedup, decontamination, tokenising, language, search, secrets."""
