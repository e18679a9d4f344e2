"""Operator 7: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is built from the encodings of its prefixes: every prefix ends with exactly one token of its own
encoding, its *last token*, and the rest of that encoding is the encoding of the shorter prefix before it. The distinct
words of a slice form a trie, held as the sorted word list with common-prefix lengths; a depth-first walk propagates last
tokens from parent to child, so that a shared prefix is worked out once for all words below it.

A candidate last token must be a suffix of the prefix and must *join* the last token before it: merging the bytes of both
together must not create a token across the seam.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, tidied
from .net import text_bytes

#: Distinct words kept between slices; the memo is emptied beyond it, which costs time and no results.
WORD_MEMO = 150_000

# The pattern of byte-level BPE that splits text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Unicode white space, as the word pattern means it.
SPACE = r"\t-\r \x85\xa0  -     　"

#: A run of other characters with one blank before it, or white space that no word takes. Words never cross these.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")

# ASCII white space, and the first bytes of all other white space in UTF-8 with the bytes that follow.
ASCII_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
WIDE_SPACE = {0xC2: 1, 0xE1: 2, 0xE2: 2, 0xE3: 2}


def chunk_edges(data: np.ndarray) -> np.ndarray:
    """Where a blank stands alone between two characters that are no white space; words never cross these places.

    Places next to a character that starts like wide white space don't count, which makes longer chunks and nothing else.
    """
    space = ASCII_SPACE[data]
    before, after = space.copy(), space.copy()
    for first, more in WIDE_SPACE.items():
        at = np.flatnonzero(data == first)
        after[at] = True
        before[np.minimum(at + more, len(data) - 1)] = True
    edge = np.zeros(len(data), bool)
    edge[1:-1] = (data[1:-1] == 0x20) & ~before[:-2] & ~after[2:]
    return edge


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary with encoding by last tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.rank, parents = {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if a in vocab and b in vocab and a + b in vocab:
                self.rank[vocab[a] << 32 | vocab[b]] = r
                parents.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.parents = parents
        #: Spines: the tokens at the right (left) end of a token while it is built, each with the rank of the merge that uses it up.
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.joined: dict[int, bool] = {}
        self.vocab = {t: i for t, i in vocab.items() if i not in parents or self._seam(parents[i][0], parents[i][1], parents[i][2])}
        #: Lengths of the tokens that end in three given bytes, longest first.
        tails: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) > 2:
                tails.setdefault(t[-3:], {1, 2}).add(len(t))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        self.split = regex.compile(WORD_PATTERN).findall
        self.memo: dict[bytes, bytes] = {}
        self.right, self.left = {}, {}  # most aren't needed again

    def spine(self, known: dict[int, list], side: int, token: int) -> list:
        found = known.get(token)
        if found is None:
            if token in self.parents:
                below = self.spine(known, side, self.parents[token][side])
                found = [*below[:-1], (below[-1][0], self.parents[token][2]), (token, math.inf)]
            else:
                found = [(token, math.inf)]
            known[token] = found
        return found

    def _seam(self, s: int, t: int, until: float = math.inf) -> bool:
        """Whether no merge of a rank under `until` spans the seam between tokens s and t while both are built from bytes."""
        a, b, i, j = self.spine(self.right, 1, s), self.spine(self.left, 0, t), 0, 0
        while True:
            (x, used_x), (y, used_y) = a[i], b[j]
            r = self.rank.get(x << 32 | y)
            if r is not None and r < used_x and r <= used_y and r < until:
                return False
            if used_x == used_y == math.inf:
                return True
            if used_x <= used_y:  # of equal merges the left one comes first
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of sorted distinct words, by one depth-first walk over their trie."""
        get, joined, lengths, table = self.vocab.get, self.joined, self.tails.get, self.table
        last: list[int] = [-1]
        before, out = b"", []
        for word in words:
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                for length in lengths(word[end - 3 : end] if end > 2 else b"", (2, 1)):
                    start = end - length
                    if start < 0:
                        continue
                    token = get(word[start:end])
                    if token is None:
                        continue
                    if start == 0:
                        break
                    key = last[start] << 32 | token
                    fits = joined.get(key)
                    if fits is None:
                        fits = joined[key] = self._seam(last[start], token)
                    if fits:
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= len(table[last[end]])
            out.append(ids[::-1])
            before = word
        return out

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """The encodings of distinct chunks, which stay in the memo."""
        if len(self.memo) > WORD_MEMO:
            self.memo.clear()
        if len(self.joined) > 2 * WORD_MEMO:
            self.joined.clear()
        parts = {c: [w.encode() for w in self.split(c.decode())] for c in chunks if c not in self.memo}
        words = sorted({w for ws in parts.values() for w in ws})
        packed = {w: b"".join(i.to_bytes(4, "little") for i in ids) for w, ids in zip(words, self.encode_words(words), strict=True)}
        for c, ws in parts.items():
            self.memo[c] = packed[ws[0]] if len(ws) == 1 else b"".join(map(packed.__getitem__, ws))
        return [*map(self.memo.__getitem__, chunks)]

    def pieces(self, text: str) -> list[str]:
        """Chunks of a text; added tokens are chunks of their own."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return CHUNK.findall(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [*CHUNK.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + CHUNK.findall(text[at:])

    def encode_text(self, text: str) -> bytes:
        """Ids of a text that may hold added tokens."""
        pieces = self.pieces(text)
        plain = sorted({p for p in pieces if p not in self.added})
        ids = dict(zip(plain, self.learn([p.encode() for p in plain]), strict=True)) | {c: i.to_bytes(4, "little") for c, i in self.added.items()}
        return b"".join(map(ids.__getitem__, pieces))

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers; nulls are empty.

        Chunks are views on one buffer and only the distinct ones become Python objects; their ids are gathered by number.
        """
        texts = texts.fill_null("")
        data, offsets = text_bytes(texts)
        edge = np.zeros(len(data) + 1, bool)
        edge[:-1] = chunk_edges(data) if len(data) > 2 else False
        edge[offsets] = True
        edges = np.flatnonzero(edge).astype(np.int32)
        views = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids = gathered(pa.array(self.learn(views.dictionary.to_pylist()), pa.binary()), views.indices, np.searchsorted(edges, offsets))
        special = pc.match_substring_regex(texts, self.added_pattern.pattern) if self.added_pattern else pa.array([False] * len(texts), pa.bool_())
        if special.true_count:
            ids = pc.replace_with_mask(ids, special, pa.array([self.encode_text(t) for t in texts.filter(special).to_pylist()], pa.binary()))
        return ids


def gathered(values: pa.Array, indices: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Binaries of several values each, those that indices[bounds[i]:bounds[i + 1]] name, one after another."""
    if not len(indices):
        return pa.array([b""] * (len(bounds) - 1), pa.binary())
    taken = values.take(indices)
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[bounds])), taken.buffers()[2]])


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBPE:
    """One vocabulary for each Python worker."""
    return ByteBPE(path)


@lru_cache(maxsize=1)
def token_table(path: str) -> pa.Array:
    """The bytes of each id, added tokens included, all that decoding needs; null for ids in between that stand for nothing."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = byte_alphabet()
    known = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.binary())


def decode_array(table: pa.Array, packed: pa.Array) -> pa.Array:
    """The texts of ids; invalid UTF-8 becomes U+FFFD, null ids an empty text."""
    packed = pa.concat_arrays([packed.fill_null(b"")])  # offsets from 0
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    ids = np.frombuffer(data, "<u4")[bounds[0] // 4 : bounds[-1] // 4] if data is not None and data.size else np.zeros(0, "<u4")
    raw = gathered(table, pa.array(ids), (bounds - bounds[0]) // 4)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): the token ids of whole texts as little-endian unsigned 32-bit integers in one binary.

    A null text counts as empty, an empty text has no ids; repeated rows are encoded each; other columns are left out.
    A map without shuffle: each task holds one slice of text and a bounded memo of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), byte_bpe(tokenizer_path).encode_array(part.column("text"))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded): adds the text of ids, special tokens included; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "ids"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decode_array(token_table(tokenizer_path), part.column("ids"))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: encode_documents() and decode_documents() in one worker, which halves the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                ids = byte_bpe(tokenizer_path).encode_array(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, decode_array(token_table(tokenizer_path), ids)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary, decoded string")
