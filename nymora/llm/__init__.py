"""Training-data operators: near-dedup, search, decontamination, language ID, line dedup, packing, secrets, toxicity, token files, URL rules.

Nothing outside this subpackage imports it.
"""
