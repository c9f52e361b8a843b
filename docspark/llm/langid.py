"""Language identification with language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: a table of slots, each a mask with one bit a language (several words of 64 bits beyond
64 languages). An n-gram sets its language's bit in HASHES slots; the AND of an n-gram's slots gives all languages that hold
it at once. A text's popcounts by language, corrected for each language's false-positive rate, decide.

The slots are sized from the n-grams counted, without a cap, and the masks are made on the cluster; their files in the shared
folder are mapped by the workers, so neither the driver nor a broadcast carries them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import filesystem, materialize, shared_array, shared_path, text_slices

#: Code points of an n-gram.
GRAM = 3
#: An n-gram belongs to a language whose share of it is at least this part of the largest share: others have it as a loan word or noise.
KEEP_SHARE = 0.25
#: Slots for each n-gram of the language with the most, the fewest slots, and the slots of one file (each has a mask).
SLOTS_EACH, FEWEST_SLOTS, FILE_SLOTS = 16, 1 << 16, 1 << 20
HASHES = 3
#: Bits of a mask word.
WORD_BITS = 64
#: Bytes of text handled at once, and code points of one piece of a longer text.
SLICE_BYTES, PIECE = 512 << 10, 1 << 18
#: Documents below this score are rejected by the filtering stage.
MIN_SCORE = 0.2

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _letters() -> np.ndarray:
    """Lower-case form of every code point of the basic plane that is a letter, else 0."""
    out = np.zeros(1 << 16, dtype=np.int32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def _pieces(texts: pa.Array) -> Iterator[list[tuple[int, str, bool, bool]]]:
    """row, text, and whether its first and last code points are only neighbours of the piece; about PIECE code points at a time."""
    held: list[tuple[int, str, bool, bool]] = []
    size = 0
    for row, text in enumerate(texts.to_pylist()):
        text = text or ""
        for s in range(0, max(1, len(text)), PIECE):
            e = min(len(text), s + PIECE)
            held.append((row, text[max(0, s - 1) : e + 1], s > 0, e < len(text)))
            size += e - s + 1
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed n-grams of the letters of all texts, words set apart by a 0, and the row each n-gram is of; piece by piece.

    Letters beyond the basic plane count as themselves; everything else parts words. A word of one letter gives one n-gram.
    A text longer than a piece is cut, each part with its neighbours, so every n-gram comes once.
    """
    if not _table:
        _table.append(_letters())
    low = _table[0]
    for part in _pieces(texts):
        code = np.frombuffer(" ".join(["", *[t for _, t, _, _ in part], ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lens = np.fromiter((len(t) for _, t, _, _ in part), np.int64, len(part)) + 1
        row = np.append(np.repeat(np.fromiter((r for r, *_ in part), np.int32, len(part)), lens), np.int32(0))[: len(code)]
        if (code >> 16).any():
            x = low[np.where(code >= 1 << 16, 0, code)]
            far = np.flatnonzero(code >= 1 << 16)
            x[far] = [c if chr(c).isalpha() else 0 for c in code[far].tolist()]
        else:
            x = low[code]
        keep = x[1:-1] != 0
        ends = np.cumsum(lens)  # where each text's last code point stands
        for k, (_, _, lead, tail) in enumerate(part):
            if lead:
                keep[ends[k] - lens[k]] = False
            if tail:
                keep[ends[k] - 2] = False
        at = np.flatnonzero(keep)
        yield (x[at].astype(np.int64) << 42) | (x[at + 1].astype(np.int64) << 21) | x[at + 2], row[at + 1]


def _slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    k = keys.astype(np.uint64)
    out = []
    for m in _MULTIPLIERS[:HASHES]:
        h = k * np.uint64(m)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - int(size).bit_length() + 1)).astype(np.int64))
    return out


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: int
    per_file: int
    files: dict[int, str | np.ndarray]  # masks of per_file slots each, as words (slot, word), or the file that holds them; absent: no bits
    false_rates: np.ndarray

    def masks(self, slot: np.ndarray) -> np.ndarray:
        """The masks of some slots, one row each."""
        words = -(-len(self.languages) // WORD_BITS)
        out = np.zeros((len(slot), words), np.uint64)
        for number, file in self.files.items():
            at = np.flatnonzero(slot // self.per_file == number) if self.slots > self.per_file else slice(None)
            held = (shared_array(file, "<u8") if isinstance(file, str) else file).reshape(-1, words)
            out[at] = held[slot[at] % self.per_file]
        return out

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each n-gram."""
        mask = None
        for slot in _slots(keys, self.slots):
            mask = self.masks(slot) if mask is None else mask & self.masks(slot)
        return mask

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        total, hits = np.zeros(n), np.zeros((len(self.languages), n))
        for keys, row in grams(texts):
            total += np.bincount(row, minlength=n)
            # equal n-grams of the piece are looked up once
            distinct, at = np.unique(keys, return_inverse=True)
            mask = self.languages_of(distinct)
            for k in range(len(self.languages)):
                has = (mask[:, k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(1)
                if has.any():
                    hits[k] += np.bincount(row, weights=has.astype(np.float64)[at], minlength=n)
        f = self.false_rates[:, None]
        hits = np.clip((hits - f * total) / np.maximum(1e-9, 1 - f), 0, None)
        best = hits.argmax(axis=0)
        top = hits[best, np.arange(n)]
        second = np.partition(hits, -2, axis=0)[-2] if len(hits) > 1 else np.zeros(n)
        score = np.where(total > 0, np.clip(0.5 * top / np.maximum(total, 1) + 0.5 * (top - second) / np.maximum(top, 1e-9), 0, 1), 0.0)
        return ["und" if t == 0 else self.languages[b] for t, b in zip(total.tolist(), best.tolist(), strict=True)], score


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all labelled rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            code = np.asarray(langs.indices, dtype=np.int64)
            for i, j in text_slices(b.column(1), SLICE_BYTES):
                for keys, row in grams(b.column(1).slice(i, j - i)):
                    lang = code[i:j][row]
                    for l in np.unique(lang).tolist():
                        k, n = np.unique(keys[lang == l], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[l].as_py()] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kept_grams(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, gram of the n-grams that a language has by KEEP_SHARE."""
    shares = counts.join(totals.select("lang", "all"), "lang").withColumn("share", F.col("n") / F.col("all"))
    top = shares.groupBy("gram").agg(F.max("share").alias("most"))
    return shares.join(top, "gram").where(F.col("share") >= KEEP_SHARE * F.col("most")).select("lang", "gram")


def fit(spark: SparkSession, labelled: DataFrame) -> LanguageFilter:
    """Learn from all labelled rows. The driver gets one row a language and one a file of masks, never n-grams."""
    counts = materialize(count_grams(labelled), "langid-grams")
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("all")), "langid-totals")
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    if not languages:
        return LanguageFilter([], FEWEST_SLOTS, FILE_SLOTS, {}, np.zeros(0))
    kept = materialize(kept_grams(counts, totals), "langid-kept")
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0]
    slots = max(FEWEST_SLOTS, 1 << (SLOTS_EACH * int(most) - 1).bit_length())
    bits = {lang: k for k, lang in enumerate(languages)}
    words = -(-len(languages) // WORD_BITS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.fromiter(map(bits.__getitem__, b.column(0).to_pylist()), np.int32, b.num_rows)
            for slot in _slots(np.asarray(b.column(1)), slots):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit)], names=["slot", "bit"])

    folder, size = shared_path(spark, "langid-masks"), min(slots, FILE_SLOTS)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, words), "<u8")
        at, word = frame["slot"].to_numpy() % FILE_SLOTS, frame["word"].to_numpy()
        out[at, word] = frame["mask"].to_numpy().view(np.uint64)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(out.tobytes())
        return pd.DataFrame({"number": [int(frame["number"].iat[0])], "file": [f"{folder}/{name}"]})

    placed = materialize(kept.mapInArrow(place, "slot long, bit int").distinct(), "langid-bits")
    full = {r["bit"]: r["n"] for r in placed.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).collect()}
    one = F.expr(f"shiftleft(1L, bit % {WORD_BITS})")
    masks = placed.groupBy("slot", F.expr(f"CAST(bit DIV {WORD_BITS} AS INT)").alias("word")).agg(F.bit_or(one).alias("mask"))
    files = masks.withColumn("number", F.expr(f"slot DIV {FILE_SLOTS}")).groupBy("number").applyInPandas(write, "number long, file string").collect()
    return LanguageFilter(languages, slots, FILE_SLOTS, {r["number"]: r["file"] for r in files}, np.array([(full.get(k, 0) / slots) ** HASHES for k in range(len(languages))]))


def identify(docs: DataFrame, model: LanguageFilter, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns, then the language and score of every whole text; texts that are null or without letters get `und` and 0."""
    schema = docs.select(*[docs[c] for c in keep]).schema.add(names[0], "string").add(names[1], "double")
    whole = "whole_text"
    while whole in keep:
        whole += "_"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for i, j in text_slices(texts, SLICE_BYTES):
                langs, score = shared.value.predict(texts.slice(i, j - i))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias(whole)).mapInArrow(predict, schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learnt from the text and lang of those not held out.

    Null texts get `und`; a null lang or doc_id is never learnt from; repeated rows are predicted each; an empty table gives
    an empty result, and without labelled rows all are `und`; columns other than doc_id, text and lang are not read.
    """
    model = fit(docs.sparkSession, docs.where(~F.coalesce(held_out(), F.lit(True))))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is found with at least min_score, with their own columns."""
    model = fit(docs.sparkSession, docs.where(~F.coalesce(held_out(), F.lit(True))))
    keep = list(docs.columns)
    found, sure = "found_language", "language_score"
    while found in keep or sure in keep:  # a column of the documents may have the name
        found, sure = f"{found}_", f"{sure}_"
    return identify(docs, model, keep, (found, sure)).where((F.col(found) != "und") & (F.col(sure) >= min_score)).drop(found, sure)
