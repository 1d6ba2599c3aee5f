"""Operators for training-data pipelines: quality, decontamination, toxicity, sharding, near-duplicates,
licences, URL filters, page extraction, language and sub-word encoding.

Nothing outside this package imports it.
"""
