"""Operators for training data: vectors, quality, near duplicates, packing, tokens and url filters. Nothing else imports this package."""
