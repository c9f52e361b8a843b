"""An offline embedder for chunks and queries, pluggable by name, and vectors joined back by key.

The default has no model to load: every term adds its weight to each dimension with a sign that its hash gives, and the sum is made
one long. Texts that share terms point in near directions; reruns agree everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Texts embedded at once, as a hosted embedder would be sent them.
BATCH = 100
Embedder = Callable[[pa.Array], np.ndarray]


def hashed_terms(dimensions: int = DIMENSIONS, most_terms: int = 200_000) -> Embedder:
    """Signed hashing of ASCII terms; at most 128 dimensions, a bit of the term's md5 each. A text without terms is all zeros."""
    if not 0 < dimensions <= 128:
        raise ValueError("1 to 128 dimensions")
    signs: dict[str, np.ndarray] = {}

    def sign(term: str) -> np.ndarray:
        if term not in signs:
            if len(signs) >= most_terms:
                signs.clear()
            bits = np.unpackbits(np.frombuffer(hashlib.md5(term.encode()).digest(), np.uint8))[:dimensions]
            signs[term] = bits.astype(np.float64) * 2 - 1
        return signs[term]

    def embed(texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^a-z0-9]+", " "))
        out, coded = np.zeros((len(texts), dimensions)), words.flatten().dictionary_encode()
        codes, sizes = coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(words).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        # each term of the batch once; signs times counts are whole numbers, so their order doesn't matter
        own = np.array([sign(w) if w else np.zeros(dimensions) for w in coded.dictionary.to_pylist()]).reshape(-1, dimensions)
        for i, (start, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            if end > start:
                at, n = np.unique(codes[start:end], return_counts=True)
                out[i] = n @ own[at]
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


#: Makers of embedders by name; a worker makes its own once.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed-terms": hashed_terms}


def embedded(rows: DataFrame, key: str, text: str = "text", name: str = "hashed-terms", make: Callable[[], Embedder] | None = None, batch: int = BATCH) -> DataFrame:
    """key and vector (array<float>) of every row. Vectors carry their key, so no order is relied on; an embedder that gives another
    number of vectors than it got texts is an error. Another embedder comes by name or as its maker.
    """
    if make is None and name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}: one of {', '.join(EMBEDDERS)}")
    maker = make or EMBEDDERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = maker()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = embed(part.column(1)).astype(np.float32)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                offsets = pa.array(np.arange(part.num_rows + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=[key, "vector"])

    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks with their vectors by key; a chunk without one keeps a null, so that it is seen as failed."""
    return chunks.join(vectors, key, "left")
