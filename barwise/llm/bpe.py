"""Byte-level BPE encoding by a pair occurrence index, and decoding.

The vocabulary file (tokenizers JSON: ranks of merges, ids, added tokens) is a parameter;
it is read by the driver and broadcast (a vocabulary has a fixed size, a few MB).

Encoding works on a piece of a partition at a time: its texts are split into words by the
byte-level pattern, and the distinct words not encoded before form one symbol array. An
index maps every mergeable pair to all its positions in that array. The active ranks, those
with positions, are taken in ascending order from a heap: all occurrences of the pair are
merged at once (leftmost first where they overlap), and the lists of the pairs that thereby vanish or appear are updated. That
is the same result as merging each word by itself, since merges never cross words and a
pair of a lower rank can't appear from merging one of a higher rank without being found in
its turn. Token ids of words are kept by the task up to a fixed number of words.

Added tokens are matched in the text first (leftmost, longest), as the tokenizers library
does, and split it. Decoding concatenates the bytes of the tokens and decodes UTF-8 with
replacement characters.

Rules: a null text counts as empty; an empty text has no tokens. Texts are used whole; a
very long one is worked through by itself. Rows keep their id, null or not, and repeated
rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import lists, runs

#: The split pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: printable
    Latin-1 bytes for themselves, the others by the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        byte_of = {ch: b for b, ch in byte_characters().items()}
        ids = model["vocab"]
        self.bytes = {i: bytes(byte_of[ch] for ch in piece) for piece, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: content.encode() for content, i in self.added.items()}
        self.byte_id = np.array([ids[ch] for _, ch in sorted(byte_characters().items())], np.int64)
        self.width = max(ids.values()) + 1
        #: left id * width + right id -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left] * self.width + ids[right], (rank, ids[left + right]))
        self.split_added = regex.compile("|".join(
            regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None


def encode_words(pieces: list[bytes], vocabulary: Vocabulary, bulk: int = 24) -> list[list[int]]:
    """Token ids of distinct words, by merging all their pairs together in order of rank.

    Symbols of all words stand in one array, linked to their neighbours in the word. The index
    maps a mergeable pair to its places; lists of ``bulk`` places or more are merged by array
    operations, shorter ones one by one."""
    if not pieces:
        return []
    sizes = np.array([len(x) for x in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    symbol = np.append(vocabulary.byte_id[data], -2)  # -2: beyond the end of a word, -1: merged away
    stop = np.cumsum(sizes)
    after = np.arange(1, n + 2)
    after[stop[sizes > 0] - 1] = n
    ahead = np.arange(-1, n)
    ahead[(stop - sizes)[sizes > 0]] = -1
    width, merges = vocabulary.width, vocabulary.merges
    index: dict[int, list] = {}
    heap: list[tuple[int, int, int]] = []

    def add(codes: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        begin = runs(codes)
        for code, x, y in zip(codes[begin].tolist(), begin.tolist(), np.append(begin[1:], len(codes)).tolist()):
            if code in merges:
                if code not in index:
                    index[code] = []
                    heapq.heappush(heap, (*merges[code], code))
                index[code].append(places[x:y])

    def add_one(code: int, place: int) -> None:
        if code in merges:
            if code not in index:
                index[code] = []
                heapq.heappush(heap, (*merges[code], code))
            index[code].append(place)

    first = np.flatnonzero(after[:n] < n)
    add(symbol[first].astype(np.int64) * width + symbol[after[first]], first)
    while heap:
        _, new, code = heapq.heappop(heap)
        found = index.pop(code, None)
        if not found:
            continue
        left, right = divmod(code, width)
        places = np.unique(np.concatenate([np.atleast_1d(x) for x in found])) if len(found) > 1 \
            else np.atleast_1d(found[0])
        if len(places) < bulk:
            for i in places.tolist():
                j = int(after[i])
                if symbol[i] != left or symbol[j] != right:
                    continue  # merged away meanwhile
                k, h = int(after[j]), int(ahead[i])
                symbol[i], symbol[j] = new, -1
                after[i] = k
                if k < n:
                    ahead[k] = i
                    add_one(new * width + int(symbol[k]), i)
                if h >= 0:
                    add_one(int(symbol[h]) * width + new, h)
            continue
        j = after[places]
        ok = (symbol[places] == left) & (symbol[j] == right)
        places, j = places[ok], j[ok]
        if left == right and len(places):
            # overlapping occurrences: every other one of a run, from its left end
            chain = np.append(True, places[1:] != j[:-1])
            start = np.flatnonzero(chain)
            ok = (np.arange(len(places)) - start[np.cumsum(chain) - 1]) % 2 == 0
            places, j = places[ok], j[ok]
        if not len(places):
            continue
        k = after[j]
        symbol[places], symbol[j] = new, -1
        after[places] = k
        inner = k < n
        ahead[k[inner]] = places[inner]
        h = ahead[places]
        back = h >= 0
        add(np.concatenate([new * width + symbol[k[inner]].astype(np.int64),
                            symbol[h[back]].astype(np.int64) * width + new]),
            np.concatenate([places[inner], h[back]]))
    alive = np.flatnonzero(symbol[:n] >= 0)
    cut = np.searchsorted(alive, stop)
    ids = symbol[alive].tolist()
    return [ids[x:y] for x, y in zip([0, *cut[:-1].tolist()], cut.tolist())]


class Codec:
    """Encodes texts piece by piece and remembers words, at most ``keep`` of them."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 400_000):
        self.vocabulary, self.keep = vocabulary, keep
        self.words = regex.compile(PATTERN)
        self.ids: dict[str, tuple[int, ...]] = {}
        #: of each word: number of ids, "," + its ids in decimal, its decoded bytes
        self.parts: dict[str, tuple[int, str, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of the text; an added token is a piece by itself."""
        added = self.vocabulary.split_added
        if added is None or not added.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in added.finditer(text):
            out += self.words.findall(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words.findall(text[at:])

    def learn(self, found: set[str]) -> None:
        """Encode the words not known yet, all together."""
        new = [x for x in found if x not in self.parts]
        vocabulary = self.vocabulary
        encoded = encode_words([x.encode() for x in new], vocabulary)
        for word, ids in zip(new, encoded):
            if word in vocabulary.added:
                ids = [vocabulary.added[word]]
            self.parts[word] = (len(ids), "," + ",".join(map(str, ids)),
                                b"".join(vocabulary.bytes[i] for i in ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, str, bytes]]]]:
        split = [self.pieces(t) for t in texts]
        if len(self.parts) > self.keep:
            self.parts.clear()
        found = set()
        for pieces in split:
            found.update(pieces)
        self.learn(found)
        parts = self.parts
        for pieces in split:
            yield pieces, [parts[x] for x in pieces]


def _groups(column: pa.Array, limit: int) -> Iterator[list[str]]:
    """The texts, nulls as empty, in lists of about ``limit`` characters."""
    out, size = [], 0
    for x in column:
        text = x.as_py() or ""
        out.append(text)
        size += len(text)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def _digests(vocabulary, limit: int, with_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1), limit):
                counts, ids, decoded, arrays = [], [], [], []
                for _, parts in codec.encode(texts):
                    counts.append(sum([p[0] for p in parts]))
                    joined = "".join([p[1] for p in parts])[1:]
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    if with_ids:
                        arrays.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                    back = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                columns = {"id": batch.column(0).slice(at, len(texts)), "n_tokens": pa.array(counts, pa.int64()),
                           "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(decoded)}
                if with_ids:
                    columns["ids"] = lists(np.concatenate(arrays), np.array(counts), pa.int32())
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
                at += len(texts)
    return task


def _tokens(vocabulary, limit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1), limit):
                ids, decoded = [], []
                for _, parts in codec.encode(texts):
                    ids.append([int(x) for x in "".join([p[1] for p in parts])[1:].split(",") if x])
                    decoded.append(b"".join([p[2] for p in parts]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)],
                    names=["id", "ids", "decoded"])
                at += len(texts)
    return task


def _load(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                     limit: int = 4_000_000) -> DataFrame:
    """id_col, ids (array of int), decoded (the text that the ids stand for)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_tokens(_load(docs, vocabulary_path), limit),
                            f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                     limit: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 (and ids): digests of what
    ``encode_documents`` returns, made in the same pass so that decoded texts, and ids
    unless asked for, needn't leave the task."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return texts.mapInArrow(_digests(_load(docs, vocabulary_path), limit, with_ids),
                            f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}") \
        .withColumnRenamed("id", id_col)
