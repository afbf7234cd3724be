"""Training-data operators (mixing, dedup, quality, PII, HTML, language model, ...).

Nothing outside this subpackage imports it.
"""
