"""bitext: a Spark-native engine for parallel text corpora.

Everything is a plain function ``DataFrame -> DataFrame`` built from
DataFrame / SQL expressions, so Catalyst sees whole plans. Subpackages:

* ``functions``  column expressions (whitespace, pre-tokenizer, 13a, arrays)
* ``sources``    scans and sinks (corpus, parallel text, metric logs)
* ``operators``  corpus prep, vocabulary / BPE, sequences, metrics, runs,
                 count-based models and beam decoding
* ``plans``      fixture views over the driver tables and the query registry
* ``streaming``  Structured Streaming forms of the incremental operators
"""

__version__ = "0.1.0"
