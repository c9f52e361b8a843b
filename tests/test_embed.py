from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from docspark.operators import embed
from docspark.plans import nested


def test_vectors_equal_sums_over_terms():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ant", "bee-7", "cat", "über", "x"]) for _ in range(rng.randrange(50))) for _ in range(40)] + [None, "", "--", "a" * 10]
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for w in re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            want[i] += np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest(), np.uint8))[:64].astype(float) * 2 - 1
    size = np.sqrt((want * want).sum(1, keepdims=True))
    want = np.divide(want, size, out=want, where=size > 0)
    got = embed.hashed_terms()
    assert (got(pa.array(texts)) == want).all() and got(pa.array([], pa.string())).shape == (0, 64)


def test_documents_are_embedded_at_the_session_s_width(spark, data):
    """Seven tasks, however many cores and documents, were the query's time."""
    assert ", 7)" not in nested.embed_documents(spark, data)._jdf.queryExecution().toString()
