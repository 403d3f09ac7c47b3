"""Training-data operators: dedup, decontamination, language ID, PII, packing, storage.

Nothing outside this subpackage imports it.
"""
