"""Training-data operators: licences, token files, packing, quality, toxicity, secrets, decontamination, near-duplicates.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
