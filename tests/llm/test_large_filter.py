from __future__ import annotations

from docspark.llm import bloomlm


def test_chunks_of_a_large_filter_are_plain_rows(spark, monkeypatch):
    """A row a document: a chunk in one row of arrays makes readers, which take rows by the thousand, hold whole files."""
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} word{i}") for i in range(300)] + [(1000, None)], "doc_id long, text string")
    want, seen, write = sorted(map(tuple, bloomlm.scores(docs).collect())), {}, bloomlm.materialize

    def watched(rows, name):
        seen[name] = write(rows, name)
        return seen[name]

    monkeypatch.setattr(bloomlm, "MAPPED_BITS", 100)
    monkeypatch.setattr(bloomlm, "materialize", watched)
    got = sorted(map(tuple, bloomlm.scores(docs).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert max(abs(a - b) for x, y in zip(got, want, strict=True) for a, b in zip(x[5:], y[5:], strict=True)) < 1e-9
    chunks = seen["lm-chunks"]
    assert chunks.count() == 301 and chunks.schema["text"].dataType.simpleString() == "string"
