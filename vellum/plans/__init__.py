"""Whole plans: the snapshot store, indexing, search and the verbs built from them."""
