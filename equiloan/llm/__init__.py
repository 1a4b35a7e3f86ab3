"""Training-data operators: language id, exact search, dedup, toxicity,
quality, mixing and packing. Nothing else in the library imports this
subpackage; ``queries`` registers one query per operator."""
