"""Scriptorium: DataFrame operators for large collections of long texts and their annotations."""
