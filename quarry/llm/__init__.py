"""Training-data operators for very large corpora: de-duplication, filtering, extraction, tokenising, mixing."""
