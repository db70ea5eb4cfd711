"""Training-data operators: language, toxicity, packing, archives, secrets, quality, privacy, chat, leakage, near copies."""
