"""tracekit: curation and measurement of model-written reasoning traces on Spark.

Column builders live in ``tracekit.functions``, DataFrame operators in
``tracekit.operators``, readers/writers and fixture views in
``tracekit.sources``, composed plans and the query catalog in
``tracekit.plans``, and incremental (Structured Streaming) curation in
``tracekit.streaming``.
"""

__version__ = "0.1.0"
