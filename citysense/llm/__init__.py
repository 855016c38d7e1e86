"""Training-data operators: chat formatting, language-model scoring, quality
rules, secret scans, packing, site quality, sharding, token counts, near
duplicates and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
