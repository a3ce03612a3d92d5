"""Operators for preparing training text: formatting, tokens, near copies, repeats, quality, extraction."""
