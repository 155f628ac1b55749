"""Review analytics on Spark: audit, clean, split, check, fit, score and evaluate.

Every operator is a plain function from DataFrame to DataFrame (or Column to
Column).  Nothing here keeps hidden state or runs at import time.
"""
