"""Operators for training corpora: language, quality, privacy, duplicates, tokens and pages."""
