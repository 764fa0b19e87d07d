"""Training-data operators: tokenising, archives, fingerprints, sharding, extraction, search, mixing, filtering.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it can be imported.
"""
