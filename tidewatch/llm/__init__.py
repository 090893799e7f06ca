"""Operators for text that is to train language models; nothing else in the library imports this package."""
