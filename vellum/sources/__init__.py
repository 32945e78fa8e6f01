"""Landed feeds and note files as DataFrames. What a network has to bring is landed first; these read the landing."""
