"""Training-data operators: near-duplicate search, scoring, scans, archives and packing."""
