"""Operators for training-data pipelines: near-duplicate joins, archives,
passage dedup, scoring, packing, mixing, quality rules, fingerprints, license
scans and sharding.  Nothing else in the library imports this subpackage."""
