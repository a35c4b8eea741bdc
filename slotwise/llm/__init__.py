"""Operators for building training corpora: cleaning, deduplication, scoring, mixing and packing."""
