"""Operators of a training-data pipeline over documents, vectors and pages."""

import sys

from pyspark import cloudpickle

from tablewright.llm.base import REGISTRY

# Functions of this package travel to the executors by value: they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tablewright.llm import alignment, decontaminate, embedding_graph, language, line_chunks, minhash, quality, secrets, sentencepiece_sampling, substring, suffix_array, warc, whitening  # noqa: E402

__all__ = ["REGISTRY", "alignment", "decontaminate", "embedding_graph", "language", "line_chunks", "minhash", "quality", "secrets", "sentencepiece_sampling", "substring", "suffix_array", "warc", "whitening"]
