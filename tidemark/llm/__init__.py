"""Training-data operators: language, quality, duplicates, mixing, tokens, licences, models, pages, fingerprints."""
