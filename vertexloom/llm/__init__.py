"""Operators for text corpora: token sizes, packing, mixing, language identification. Nothing else in the library imports this package."""
