"""Operators for preparing language-model training data; nothing else in lodestone imports them."""
