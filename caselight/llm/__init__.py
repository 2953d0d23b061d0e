"""Training-data operators: dedup, filtering, decontamination, classification and mixing."""
