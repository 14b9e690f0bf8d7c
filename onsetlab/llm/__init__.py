"""Operators for training-data pipelines: token counts, quality, language,
secrets, media columns, chat formatting, BPE, near-duplicates and packing."""
