"""Training-data operators: quality, privacy, fingerprints, token counts, duplicates, toxicity, archives,
decontamination and mixing. Nothing else in the library imports this subpackage."""
