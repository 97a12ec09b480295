"""From documents to vector collections in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.operators.chunking import CHUNKERS, chunk_documents
from contextmill.operators.models import Model, with_reply
from contextmill.operators.replies import ReplyStore
from contextmill.session import bounded_batches, materialise
from contextmill.sources import collections

DEFAULT_CHUNKERS = {name: CHUNKERS[name] for name in ("recursive", "semantic")}


def embed_chunks(chunks: DataFrame, embedder: Model | ReplyStore) -> DataFrame:
    """One vector per chunk, made where the chunk is; by a reply store, one call per distinct text."""
    bounded_batches(chunks.sparkSession)
    return with_reply(chunks, embedder, F.col("text"), "embedding")


def ingest(
    docs: DataFrame,
    path: str,
    embedder: Model | ReplyStore,
    dim: int,
    chunkers: dict[str, Callable[[DataFrame], DataFrame]] = DEFAULT_CHUNKERS,
) -> DataFrame:
    """Chunk every document by every chunker, embed, and recreate the collections."""
    points = embed_chunks(chunk_documents(docs, chunkers), embedder)
    collections.recreate(points, path, dim, chunkers)
    return collections.read_collection(docs.sparkSession, path)


def ingest_missing(
    docs: DataFrame,
    path: str,
    embedder: Model | ReplyStore,
    dim: int,
    chunkers: dict[str, Callable[[DataFrame], DataFrame]] = DEFAULT_CHUNKERS,
) -> DataFrame:
    """Chunk the documents and add those chunks that the collections do not have.

    Chunks are compared before they are embedded, so that a run that is repeated, or resumed after a part of it,
    calls the model for missing chunks alone. Present ids stay as they are.
    """
    chunks = materialise(chunk_documents(docs, chunkers), "chunks")
    missing = collections.missing(chunks, path)
    collections.upload(embed_chunks(missing, embedder), path, dim)
    return collections.read_collection(docs.sparkSession, path)
