"""Operators of a training-data pipeline: mixing, tokens, URL and quality filters, secrets, language, duplicates."""
