"""Training-data operators: archives, licences, near-duplicates, quality, extraction, search and tokens."""
