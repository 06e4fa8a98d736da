"""Training-data operators: toxicity, nearest neighbours, language, archives, cleaning, URL rules,
token counts, near-duplicates, source mixing and byte-pair encoding."""
