"""Batch tokenisation with the tokenizers library: every distinct part of a text is encoded once and gathered by index."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of distinct parts and their ids that a worker keeps, with about 200 for each part's objects.
CACHE_BYTES = 96 << 20
#: Fixed value: the public byte-level BPE scheme's pre-token pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space next to any other white space; texts with one are encoded by the library as they are.
SPACES = r" [\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}] |\x00"
#: A letter and a sign after it, between which a pre-token always ends.
SIGN = r"(\p{L})([^\s\x0b\x{85}\p{Z}\p{L}\p{N}'])"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_level(path: str) -> None:
    """Refuse files whose pre-tokens are not those of PRE_TOKENS: only for these are a text's parts its pre-tokens."""
    with open(path, encoding="utf-8") as f:
        scheme = json.load(f)
    pre = scheme.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or scheme.get("normalizer"):
        raise ValueError(f"{path} is not a byte-level file with the public pre-token pattern, no prefix space and no normaliser")


class BatchTokenizer:
    """Ids as `Tokenizer.encode(text, add_special_tokens=False)` gives them, for a byte-level BPE file.

    A space between two characters that are no white space always starts a new pre-token of the byte-level scheme, and a
    sign after a letter does, so the ids of a text are those of these parts in turn. They repeat far more often than texts do.
    Texts that hold an added token's content are encoded by the library as they are; with `plain`, such content is text as any
    other (the library's encode_special_tokens).
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        _byte_level(path)
        self.model, self.split = self.whole.model, regex.compile(PRE_TOKENS).findall
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in printable]
        self.shown = {b: 256 + i for i, b in enumerate(rest)}  # byte-level vocabularies show other bytes as these code points
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.split(part):
            shown = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
            ids += [t.id for t in self.model.tokenize(shown)]
        out = self.parts[part] = array("I", ids).tobytes()
        self.held += 200 + len(part) + len(out)
        return out

    def _gather(self, parts: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        get, learn = self.parts.get, self._learn
        coded = [learn(w) if (b := get(w)) is None else b for w in parts]
        if self.held > CACHE_BYTES:
            self.parts, self.held = {}, 0
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        flat = np.frombuffer(b"".join(coded), "<u4")
        starts = np.cumsum(lens) - lens
        n = lens[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(starts[index] - (ends - n), n) + np.arange(total)], n

    def _safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, SIGN, "\\1\x00\\2"), " ", "\x00 "), "\x00")
        offsets = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        ids, n = self._gather(coded.dictionary.to_pylist(), np.asarray(coded.indices))
        bounds = np.concatenate(([0], np.cumsum(n)))[offsets]
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the number of ids of each. A null text counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        odd = np.asarray(pc.match_substring_regex(texts, SPACES))
        for content in self.added:
            odd = odd | np.asarray(pc.match_substring(texts, content))
        if not odd.any():
            return self._safe(texts)
        at, safe_at = np.flatnonzero(odd), np.flatnonzero(~odd)
        parts: list = [None] * len(texts)
        if len(safe_at):
            ids, n = self._safe(texts.take(pa.array(safe_at)))
            for i, one in zip(safe_at.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = one
        for i, e in zip(at.tolist(), self.whole.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, dtype="<u4")
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_kept: dict[tuple[str, bool], BatchTokenizer] = {}


def batch_tokenizer(path: str, plain: bool = True) -> BatchTokenizer:
    """One tokenizer a worker process; its word cache lasts over tasks."""
    if (path, plain) not in _kept:
        _kept[path, plain] = BatchTokenizer(path, plain)
    return _kept[path, plain]
