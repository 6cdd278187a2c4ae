"""Operators for preparing training corpora: language, quality, duplicates, mixing and placement."""
