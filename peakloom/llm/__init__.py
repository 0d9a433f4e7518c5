"""Training-data operators: quality, decontamination, secrets, mixing, search, joins, LM scores, licences, tokens, dedup.

Nothing else in the library imports this subpackage.
"""
