"""Training-data operators: packing, rules, language, tokens, toxicity, secrets, WARC, near-dedup, quality, media."""
