"""Training-data operators: decontamination, tokenisation, dedup, quality, URLs, secrets."""
