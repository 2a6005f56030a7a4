"""Operators for preparing training text: scans, classifiers, near-duplicate search, mixing and packing."""
