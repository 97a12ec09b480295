"""Document retrieval datasets on Spark: chunk, store, search, filter, evaluate."""

import sys

from pyspark import cloudpickle

from contextmill.operators.chunking import CHUNKERS, chunk_documents
from contextmill.operators.evaluation import build_dataset, metric_table
from contextmill.operators.ingest import ingest
from contextmill.operators.relevance import filter_by_relevance
from contextmill.operators.retrieval import retrieve
from contextmill.operators.runs import evaluation_dataset, run_metrics, write_run

__all__ = [
    "CHUNKERS",
    "build_dataset",
    "chunk_documents",
    "evaluation_dataset",
    "filter_by_relevance",
    "ingest",
    "metric_table",
    "retrieve",
    "run_metrics",
    "write_run",
]

# Tasks get this package's functions with the job, wherever it is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
