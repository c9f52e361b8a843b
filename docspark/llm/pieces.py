"""SentencePiece encoding and decoding for merge-type (BPE) models, without the library.

A piece model merges the neighbours whose joined piece has the best score, the leftmost of equals, until none is left. Its result
for a prefix ends in one token, which the table of all prefixes holds: of the pieces that an automaton finds to end at a place,
it is the only one that is compatible with the last token of the prefix before it, two tokens being compatible if their joined
text is merged into just these two. Tokens whose neighbours are all compatible are the merge result, since the first merge over
one of their borders would also have been made in that pair's own text. The ids of a text are then read from its end backwards.

No piece has a space after another character, so a text is cut before such spaces, and a worker fills the table once for every
word that it meets. A character outside the vocabulary merges with nothing and stands for its UTF-8 bytes.

Defined cases: a null text is an empty one, with no ids; an empty id list decodes to an empty text; the sign that stands for a
space comes back as a space, as the library has it; texts are handled whole, of any length. Other columns take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import text_slices

SPACE = "▁"
#: Kinds of pieces in a model file, and the sign that an unknown id decodes to.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_SIGN = " ⁇ "
#: Pairs of tokens and bytes of words that a worker keeps; bits of a pair's slot in the table for many at once.
PAIRS = 1 << 18
PAIR_BITS = 20
WORD_BYTES = 96 << 20
#: Ids decoded at once.
SLICE_IDS = 1 << 18
#: Longer words fill their table alone.
LONG = 200
NEVER = float("-inf")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    i, n = 0, len(data)

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i, out, shift = i + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out

    while i < n:
        tag = number()
        kind = tag & 7
        size = {1: 8, 5: 4}.get(kind)
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if size is None else size
        yield tag >> 3, data[i : i + size]
        i += size


class PieceModel:
    """Vocabulary and rules of a merge-type model file with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for _, own in (p for p in parts if p[0] == 1):
            fields = dict(_fields(own))
            self.pieces.append(fields[1].decode())
            scores.append(struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0)
            self.kinds.append(fields.get(3, NORMAL))
        trainer = dict(_fields(b"".join(v for k, v in parts if k == 2)))
        rules = dict(_fields(b"".join(v for k, v in parts if k == 3)))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is not a merge-type model with byte fallback and plain pieces")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError(f"{path} changes texts in ways other than spaces to signs")
        self.prefix = bool(rules.get(3, 1))
        self.scores = {p: s for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path} has pieces with a space after another character")
        surface = [b"" if k == CONTROL else UNKNOWN_SIGN.encode() if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.surface = Cells(surface, "u1")


class Cells:
    """Lists of numbers of one kind, as byte strings by number, gathered many at a time."""

    def __init__(self, cells: list[bytes], kind: str):
        self.flat = np.frombuffer(b"".join(cells), kind)
        self.n = np.fromiter(map(len, cells), np.int64, len(cells)) // self.flat.itemsize
        self.starts = np.cumsum(self.n) - self.n

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the cells in turn, and how many each has."""
        n = self.n[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)], n


class Automaton:
    """Finds all pieces that end at each character, for many words at once: states in arrays, edges by a search over their keys."""

    def __init__(self, pieces: dict[str, int]):
        self.letters = np.zeros(0x110000, np.int64)  # 0: in no piece
        known = sorted({c for p in pieces for c in p})
        self.letters[[ord(c) for c in known]] = range(1, len(known) + 1)
        edges: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for p, token in pieces.items():
            state = 0
            for c in p:
                state = edges.setdefault((state, c), len(edges) + 1)
            ends[state] = token
        n = len(edges) + 1
        children: list[list[tuple[str, int]]] = [[] for _ in range(n)]
        for (state, c), to in edges.items():
            children[state].append((c, to))
        back, found, wave = [0] * n, [()] * n, [0]
        while wave:  # breadth first: a state's fall-back is nearer to the start, and so is done
            after = []
            for state in wave:
                found[state] = ((ends[state],) if state in ends else ()) + (found[back[state]] if state else ())
                for c, to in children[state]:
                    at = back[state]
                    while state and at and (at, c) not in edges:
                        at = back[at]
                    back[to] = edges.get((at, c), 0) if state else 0
                    after.append(to)
            wave = after
        self.outputs, self.back = found, np.array(back)
        keys = np.array([state << 16 | int(self.letters[ord(c)]) for state, c in edges])
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(edges.values()))[order], 0)
        self.n = np.array([*map(len, found)])
        self.first = np.cumsum(self.n) - self.n
        self.tokens = np.array([t for some in found for t in some])

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        keys = states << 16 | letters
        at = np.searchsorted(self.keys, keys)
        out = np.where(self.keys[at] == keys, self.to[at], -1)
        while len(lost := np.flatnonzero(out < 0)):  # no edge: on from the fall-back, or the start
            out[lost] = 0
            lost = lost[(states[lost] > 0) & (letters[lost] > 0)]
            states = states.copy()
            states[lost] = self.back[states[lost]]
            keys = states[lost] << 16 | letters[lost]
            at = np.searchsorted(self.keys, keys)
            out[lost] = np.where(self.keys[at] == keys, self.to[at], -1)
        return out

    def walk(self, letters: list[int]) -> Iterator[tuple[int, ...]]:
        """The pieces that end at each letter of one text."""
        edges, back, state = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.back.tolist(), 0
        for c in letters:
            while (to := edges.get(state << 16 | c)) is None and state:
                state = back[state]
            state = to or 0
            yield self.outputs[state]

    def matches(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that end in each state, and how many."""
        n = self.n[states]
        ends = np.cumsum(n)
        return self.tokens[np.repeat(self.first[states] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


class PrefixTable:
    """Ids of words by the last token of each of their prefixes."""

    def __init__(self, model: PieceModel):
        self.model, self.scores = model, model.scores
        #: The number past the vocabulary: the last token where a word starts or behind a character outside the vocabulary.
        self.none = len(model.pieces)
        self.length = np.array([*map(len, model.pieces), 1])
        self.found = Automaton(model.ids)
        if any(c not in model.ids for p in model.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.pairs: dict[int, bool] = {}
        self.near = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves, by the rule itself: for texts of a few characters."""
        parts, score = list(text), self.scores.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def compatible(self, before: int, token: int) -> bool:
        """Does the text of two tokens merge into them?"""
        own = [self.model.pieces[token]]
        if before < self.none:
            own.insert(0, self.model.pieces[before])
        return self.merged("".join(own)) == own

    def _pair(self, key: int) -> bool:
        good = self.pairs.get(key)
        if good is None:
            good = self.pairs[key] = self.compatible(*divmod(key, self.none))
        return good

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of many pairs: from a table with a slot a hash where it has the pair, else from all pairs met."""
        held, good = self.near
        slot = (keys * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - PAIR_BITS)
        missing = np.flatnonzero(held[slot] != keys)
        out = good[slot]
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            answers = np.fromiter(map(self._pair, new.tolist()), bool, len(new))
            out[missing] = answers[back]
            held[slot[missing]], good[slot[missing]] = keys[missing], out[missing]
        return out

    def last_tokens(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of each prefix of words, by the place before which it ends; a place stands free before each word.

        All words go on together, character by character, the longer ones first so that those still going are in front.
        """
        last = np.full(len(letters) + 1, -1, np.int64)
        last[1:][letters == 0] = self.none
        last[starts] = self.none
        order = np.argsort(-sizes, kind="stable")
        starts, going = starts[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left")
        states = np.zeros(len(starts), np.int64)
        for depth, n in enumerate(going.tolist()):
            at = starts[:n] + depth
            states = self.found.step(states[:n], letters[at])
            tokens, each = self.found.matches(states)
            ends = np.repeat(at + 1, each)
            good = self._pairs(last[ends - self.length[tokens]] * self.none + tokens)
            last[ends[good]] = tokens[good]
        return last

    def long_last_tokens(self, letters: np.ndarray) -> list[int]:
        """As last_tokens, for one word of any length."""
        last, lengths = [self.none] + [-1] * len(letters), self.length.tolist()
        for i, (letter, tokens) in enumerate(zip(letters.tolist(), self.found.walk(letters.tolist()), strict=True), 1):
            last[i] = next((t for t in tokens if self._pair(last[i - lengths[t]] * self.none + t)), -1) if letter else self.none
        return last

    def _letters(self, text: str) -> np.ndarray:
        return self.found.letters[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def _bytes(self, ids: list[int], word: str) -> list[int]:
        """Unknown characters to the ids of their bytes."""
        out, at = [], 0
        for i in ids:
            out += [i] if i < self.none else [self.model.bytes[b] for b in word[at].encode()]
            at += int(self.length[i])
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers, read from the words' ends backwards."""
        if len(self.pairs) > PAIRS:
            self.pairs = {}
        out: list[bytes] = [b""] * len(words)
        for i in (i for i, w in enumerate(words) if len(w) > LONG):
            last, at, ids = self.long_last_tokens(self._letters(words[i])), len(words[i]), []
            while at:
                ids.append(last[at])
                at -= int(self.length[ids[-1]])
            out[i] = np.array(self._bytes(ids[::-1], words[i]), "<u4").tobytes()
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        starts = np.cumsum(sizes + 1) - sizes - 1
        last = self.last_tokens(self._letters(" ".join([words[i] for i in short])), starts, sizes)
        at, live, rounds = starts + sizes, np.arange(len(short)), []
        n = np.zeros(len(short), np.int64)
        while len(live):
            tokens = last[at[live]]
            rounds.append((live, tokens))
            n[live] += 1
            at[live] -= self.length[tokens]
            live = live[at[live] > starts[live]]
        ends = np.cumsum(n)
        flat = np.zeros(int(ends[-1]), "<u4")
        for k, (which, tokens) in enumerate(rounds):
            flat[ends[which] - 1 - k] = tokens
        data = flat.tobytes()
        for i, a, b in zip(short, (4 * (ends - n)).tolist(), (4 * ends).tolist(), strict=True):
            out[i] = data[a:b]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat == self.none), side="right")).tolist():
            out[short[k]] = np.array(self._bytes(flat[ends[k] - n[k] : ends[k]].tolist(), words[short[k]]), "<u4").tobytes()
        return out


class PieceCodec:
    """Batches of texts to ids and back, as the library's encode (no begin, no end) and decode give them."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.table = PrefixTable(self.model)
        self.control = np.array([k == CONTROL for k in self.model.kinds])
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.segment = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _learn(self, words: list[str]) -> None:
        cells = self.table.ids(words)
        self.words.update(zip(words, cells, strict=True))
        self.held += sum(map(len, cells)) + 2 * sum(map(len, words)) + 200 * len(words)

    def _gather(self, words: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given by number in a list of different ones, in turn; and how many each has."""
        if self.held > WORD_BYTES:
            self.words, self.held = {}, 0
        if new := [w for w in words if w not in self.words]:
            self._learn(new)
        return Cells([self.words[w] for w in words], "<u4").take(index)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the number of ids of each. A null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # where words are parted by single spaces, an Arrow split finds them; else each text is cut by itself
        plain = pc.and_(pc.invert(pc.match_substring_regex(texts, f"^ |  |{SPACE}")), pc.greater(pc.binary_length(texts), 0))
        even = np.asarray(plain) & self.model.prefix
        parts = pc.split_pattern(texts.filter(pa.array(even)), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        coded = parts.flatten().dictionary_encode()
        ids, n = self._gather([SPACE + w for w in coded.dictionary.to_pylist()], np.asarray(coded.indices))
        bounds = np.concatenate(([0], np.cumsum(n)))[offsets - offsets[0]]
        if even.all():
            return ids, np.diff(bounds)
        every: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for i, a, b in zip(np.flatnonzero(even).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            every[i] = ids[a:b]
        for i in np.flatnonzero(~even).tolist():
            text = texts[i].as_py()
            found = self.segment(SPACE * (self.model.prefix and text != "") + text.replace(" ", SPACE))
            different = list(dict.fromkeys(found))
            number = {w: k for k, w in enumerate(different)}
            every[i] = self._gather(different, np.fromiter((number[w] for w in found), np.int64, len(found)))[0]
        return np.concatenate(every), np.fromiter(map(len, every), np.int64, len(every))

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of id lists: spaces for signs, the first one dropped where the model puts it there, bytes as UTF-8."""
        flat, sizes = self.model.surface.take(ids.astype(np.int64))
        data, bounds, ends = flat.tobytes(), np.concatenate(([0], np.cumsum(sizes))), np.cumsum(n)
        ends_run = np.concatenate(([0], np.cumsum(self.control[ids])))  # such a piece ends a run of bytes
        out = []
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            own, at = data[bounds[a] : bounds[b]], a
            while at < b and self.model.kinds[ids[at]] == CONTROL:
                at += 1
            drop = int(self.model.prefix and at < b and self.model.kinds[ids[at]] == NORMAL and own.startswith(b" "))
            if ends_run[a] == ends_run[b] and (text := _text(own[drop:])) is not None:
                out.append(text)
            else:
                out.append(self._repaired(ids[a:b].tolist())[drop:])
        return out

    def _repaired(self, ids: list[int]) -> str:
        """Where bytes are no UTF-8: whole characters of a run of byte pieces as they are, each other byte as the replacement character."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.model.kinds[i] == BYTE:
                run += bytes([int(self.model.pieces[i][1:-1], 16)])
                continue
            while run:
                size = next((k for k in range(1, 5) if _text(run[:k]) is not None), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            if i is not None:
                kind = self.model.kinds[i]
                out.append("" if kind == CONTROL else UNKNOWN_SIGN if kind == UNKNOWN else self.model.pieces[i].replace(SPACE, " "))
        return "".join(out)


def _text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


_kept: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One a worker process; its words last over tasks."""
    if path not in _kept:
        _kept[path] = PieceCodec(path)
    return _kept[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                b = batch.slice(i, j - i)
                ids, n = own.encode(b.column(1))
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Adds the text of every id list; a null list has none. rows: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            n = np.asarray(pc.fill_null(pc.list_value_length(b.column(1)), 0), dtype=np.int64)
            ends, i = np.cumsum(n), 0
            while i < len(n):  # rows of at most so many ids together, or a single row
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + SLICE_IDS, side="right")))
                some = b.slice(i, j - i)
                texts = own.decode(np.asarray(some.column(1).flatten()), n[i:j])
                texts = [t if v else None for t, v in zip(texts, some.column(1).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                i = j

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
