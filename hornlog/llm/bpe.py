"""Byte-pair encoding and decoding by a traversal of the prefix trie of distinct words.

The last token of a prefix's encoding is fixed by the prefix alone: it is the
only token that ends the prefix and may follow the last token of what precedes
it.  Which tokens end a prefix, longest first, an automaton over the vocabulary
tells in one step a byte.  Two tokens may stand side by side if encoding their joined bytes gives the
same two tokens again, which the two merge trees tell without encoding.  So the
distinct words of a batch are walked in order, depth first, with one state (the
last token) for each byte of the current word: a prefix that many words share is
computed once.  A word's encoding is read off backwards from its last state.

Defined cases: a null text is empty and has no tokens; strings of the file's
added tokens become those tokens, as in the tokenizers library; texts may be of
any length; each input row has its own row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded, pick, tidy

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept at most in a worker's caches, which a task leaves empty.
CACHED_WORDS, CACHED_PAIRS, CACHED_STEPS = 300_000, 400_000, 400_000
ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairModel:
    """A byte-level BPE model from a tokenizers JSON file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space and normalizer is supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        letters = byte_letters()
        self.pattern = regex.compile(PATTERN)
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            left, right = (self.ids[bytes(letters[c] for c in x)] for x in (a, b))
            self.rank.setdefault((left, right), k)
            self.parts.setdefault(self.ids[self.bytes[left] + self.bytes[right]], (left, right))
        for text_of in self.added:  # an added token is never the outcome of a merge
            self.ids.pop(text_of.encode(), None)
        self.lengths = {i: len(b) for i, b in self.bytes.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes}
        self._build_automaton()
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._spines: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the caches, so that an idle worker holds the vocabulary only."""
        self._fits.clear()
        self._words.clear()
        self._steps.clear()
        for known in self._spines:
            known.clear()

    def _build_automaton(self) -> None:
        """A trie of all tokens' bytes; each node has its longest proper suffix in the trie and the tokens that end it, longest first.
        Edges are kept by node and byte in one table."""
        edges: dict[int, int] = {}
        token, depth_of = [-1], [0]
        for word, i in self.ids.items():
            at = 0
            for depth, b in enumerate(word, 1):
                nxt = edges.get(at << 8 | b)
                if nxt is None:
                    nxt = edges[at << 8 | b] = len(token)
                    token.append(-1)
                    depth_of.append(depth)
                at = nxt
            token[at] = i
        self._edges, self._suffix, self._steps = edges, [0] * len(token), {}
        ending: list[tuple] = [()] * len(token)
        for key, nxt in sorted(edges.items(), key=lambda e: depth_of[e[1]]):
            at, b = key >> 8, key & 255
            up = self._suffix[nxt] = self._move(self._suffix[at], b) if at else 0
            ending[nxt] = ((self.lengths[token[nxt]], token[nxt]), *ending[up]) if token[nxt] >= 0 else ending[up]
        self._ending = ending

    def _move(self, at: int, b: int) -> int:
        """The automaton's node after one more byte."""
        edges, suffix = self._edges, self._suffix
        while (got := edges.get(at << 8 | b)) is None and at:
            at = suffix[at]
        return got or 0

    def _step(self, at: int, b: int) -> int:
        got = self._steps[at << 8 | b] = self._move(at, b)
        return got

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """A token's pieces at its right (side 1) or left (0) edge, smallest first, and the rank at which each is merged away."""
        known = self._spines[side]
        if token not in known:
            out, at, over = [], token, _NEVER
            while True:
                out.append((at, over))
                if at not in self.parts:
                    break
                over = self.rank[self.parts[at]]
                at = self.parts[at][side]
            known[token] = out[::-1]
        return known[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded."""
        got = self._fits.get(left << 32 | right)
        if got is None:
            a, b, i, j, rank = self._spine(left, 1), self._spine(right, 0), 0, 0, self.rank
            while True:
                (x, over_x), (y, over_y) = a[i], b[j]
                cross = rank.get((x, y), _NEVER)
                if cross < over_x and cross <= over_y:
                    got = False
                    break
                if over_x == over_y == _NEVER:
                    got = True
                    break
                if over_x <= over_y:
                    i += 1
                else:
                    j += 1
            self._fits[left << 32 | right] = got
        return got

    def encode_words(self, found: list[bytes]) -> Iterator[bytes]:
        """Token ids, as little-endian 32-bit integers, of sorted distinct words: a depth-first walk of their trie."""
        fits, known, lengths, packed, ending = self.fits, self._fits.get, self.lengths, self.packed, self._ending
        step, move = self._steps.get, self._step
        last, nodes = [-1], [0]  # the state at each depth: last token, automaton node
        before = b""
        for word in found:
            n, shared = min(len(word), len(before)), 0
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for end in range(shared, len(word)):
                b = word[end]
                there = step(node << 8 | b)
                node = move(node, b) if there is None else there
                nodes.append(node)
                for length, token in ending[node]:
                    prior = last[-length]  # the state before the token: end + 1 - length, counted from the top
                    if prior < 0:
                        last.append(token)
                        break
                    apart = known(prior << 32 | token)
                    if apart or (apart is None and fits(prior, token)):
                        last.append(token)
                        break
                else:
                    raise ValueError("a byte is missing in the vocabulary")
            before, out, end = word, [], len(word)
            while end:
                token = last[end]
                out.append(packed[token])
                end -= lengths[token]
            out.reverse()
            yield b"".join(out)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text, as little-endian 32-bit integers."""
        pieces = [self._pieces(t) for t in texts]
        cache = self._words
        if len(cache) > CACHED_WORDS:
            cache.clear()
        if len(self._fits) > CACHED_PAIRS:
            self._fits.clear()
        if len(self._steps) > CACHED_STEPS:
            self._steps.clear()
        fresh = {w for parts in pieces for p in parts if isinstance(p, list) for w in p if w not in cache}
        raw = {w.encode("utf-8", "surrogatepass"): w for w in fresh}
        order = sorted(raw)
        for word, ids in zip(order, self.encode_words(order), strict=True):
            cache[raw[word]] = ids
        get = cache.__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else p for p in parts]) for parts in pieces]

    def _pieces(self, text: str | None) -> list[list[str] | bytes]:
        """Lists of words, and between them the ids of added tokens."""
        if not text:
            return []
        if self.added_pattern is None or not self.added_pattern.search(text):
            return [self.pattern.findall(text)]
        parts = self.added_pattern.split(text)
        return [np.array([self.added[p]], "<u4").tobytes() if k % 2 else self.pattern.findall(p) for k, p in enumerate(parts)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_models: dict[str, BytePairModel] = {}


def _model(text: str) -> BytePairModel:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _models:
        _models[key] = BytePairModel(text)
    return _models[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _held(df: DataFrame, path: str | None):
    """The tokenizer file (a few MB, whatever the data) for the workers."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian 32-bit integers) of every text."""
    held = _held(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in bounded(batches, most=1 << 19):
            ids = model.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        model.forget()

    return pick(documents, "doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids."""
    held = _held(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, text string")


def digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode, and return one row of digests per document."""
    held = _held(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in bounded(batches, most=1 << 19):
            ids = model.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(model.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        model.forget()

    return pick(documents, "doc_id", "text").mapInArrow(tidy(run), ENCODED)


def with_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """All columns and n_tokens and token_ids; the text is what decoding the ids gives, null where it was null."""
    held = _held(documents, path)
    place = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in bounded(batches, place, 1 << 19):
            ids = model.encode_batch(batch.column(place).to_pylist())
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            columns = list(batch.columns)
            columns[place] = pa.array([model.decode(x) if known else None for x, known in zip(ids, batch.column(place).is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), lists], schema.names)
        _models.clear()  # workers go on to other stages; reading the file again takes less than a second a task

    return documents.mapInArrow(tidy(run), schema)
