"""Operators for large text corpora: quality, near duplicates, packing, scans, token counts, archives."""
