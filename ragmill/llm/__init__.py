"""Training-data operators: mixing, quality, chat, fingerprints, dedup, language, WARC, tokens, neighbours."""
