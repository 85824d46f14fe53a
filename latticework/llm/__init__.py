"""Training-data operators: text scanning, models, near-duplicate search, archives and mixing."""
