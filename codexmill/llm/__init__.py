"""Training-data operators: quality, licences, toxicity, decontamination, dedup, tokens, HTML."""
