"""Training-data operators: scoring, PII, dedup, quality, mixing and materialisation of text corpora."""
