"""Operators for preparing training text: duplicates, shards, packing, secrets, personal data, neighbours, toxicity, mixing."""
