"""Operators for preparing training text: tokens, packing, decontamination, near duplicates, quality, pages, shards."""
