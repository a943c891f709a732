"""Training-data operators: media, packing, deduplication, secrets, archives, mixing, quality, token files.

Nothing else in the library imports this subpackage.  Every module keeps the same layout: a general
operator on DataFrames first, then the thin ``opN_*`` query that binds it to the sample tables.
"""
