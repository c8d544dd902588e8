"""Corpus-scale text analytics and rating regression on PySpark.

Sub-packages
------------
``functions``  Column -> Column expressions (coercion, text, rating scales)
``sources``    readers and writers (metadata tables, text corpora, manifests, models)
``operators``  DataFrame -> DataFrame building blocks
``plans``      the end-to-end jobs: load, train, evaluate, score
``streaming``  the scoring job as a Structured Streaming query
``catalog``    the registered queries and their SQL equivalents
"""

__version__ = "0.1.0"
