"""Training-data operators: dedup, language, quality, decontamination, mixing, tokens, scores."""
