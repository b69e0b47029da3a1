"""Training-data operators: decontamination, quality, near-dedup, packing, sharding, filters, toxicity, lines, chat, language."""
