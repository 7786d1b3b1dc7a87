"""Training-data operators: dedup, tokenisation, search, archives, filters and classifiers over text tables.

Nothing outside this folder (but for the guarded hook in ``__spark_entry__``) imports it.
"""
