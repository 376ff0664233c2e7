"""Operators for preparing large text corpora: deduplication, decontamination, scoring, mixing, archives, tokens.

Nothing else in the library imports this package. Every operator is a function of DataFrames; intermediate results
that must outlive a job go to the session's checkpoint folder, which all executors share.
"""
