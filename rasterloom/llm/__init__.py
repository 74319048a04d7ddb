"""Training-data operators: quality, toxicity, URL filters, secrets, WARC,
decontamination, byte-level BPE, language ID, near-dedup, repeated passages,
spelling variants, fill-in-middle, token id files.

Nothing outside this subpackage imports it.
"""
