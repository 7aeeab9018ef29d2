"""Training-data operators: mixing, tokenising, extraction, fingerprints,
sanitising, near-duplicates, URL and toxicity filters, binary token output.

Nothing else in the library imports this subpackage.
"""
