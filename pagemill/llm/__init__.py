"""Operators that clean and prepare text for language-model training."""
