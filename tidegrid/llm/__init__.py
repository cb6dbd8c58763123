"""Training-data operators: tokenizers, de-duplication, cleaning, scoring.

Nothing else in the library imports this subpackage; it stands on PySpark,
numpy and pyarrow alone.
"""
