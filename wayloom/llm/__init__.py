"""Training-data operators: dedup, PII, URL and HTML filters, decontamination, tokenizing, sharding, language ID."""
