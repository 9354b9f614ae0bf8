"""Operators for building training corpora: language, duplicates, quality, leaks, secrets, chat, archives, tokens."""
