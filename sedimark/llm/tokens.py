"""Problem 6: encoding a corpus with a public byte-level BPE, each distinct word once.

Texts are cut into pre-tokens and grouped into blocks. A block keeps its documents as numbers of its distinct words, in
order of position, and sends each distinct word once to the task that owns the word; there it is encoded and its ids
go back to the block, where they are put at the words' positions. What crosses the network is the blocks' word numbers
and one row per block and distinct word, so frequent words cost no more than rare ones.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sedimark.runtime import staged

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of a block, about; a longer text is a block of its own.
BLOCK = 8 << 20
#: fixed value: the pre-token pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of a vocabulary file, at most.
LARGEST = 64 << 20

_loaded: dict[object, object] = {}


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The ranks of a public vocabulary; the folder is a parameter, SEDIMARK_TOKENIZERS or the usual place."""
    return f"{folder or os.environ.get('SEDIMARK_TOKENIZERS', TOKENIZERS)}/{name}.tiktoken"


def vocabulary_bytes(path: str) -> bytes:
    """The vocabulary file, read on the driver; tasks get it by broadcast, so executors need no copy of it. Its size is checked."""
    size = os.path.getsize(path)
    if size > LARGEST:
        raise ValueError(f"{path} has {size} bytes, {LARGEST} at most are sent to the tasks")
    with open(path, "rb") as f:
        return f.read()


def token_bytes(content: bytes) -> dict[int, bytes]:
    """The token-byte table: id to bytes."""
    return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, content.splitlines())}


def word_encoder(content: bytes):
    """bytes of one pre-token -> its ids. One encoder per process and vocabulary."""
    key = hashlib.blake2b(content, digest_size=16).digest()
    if key not in _loaded:
        import tiktoken

        ranks = {token: rank for rank, token in token_bytes(content).items()}
        # the pattern takes the whole of what is given: it is one pre-token already
        whole = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        _loaded[key] = lambda word: whole.encode_ordinary(word.decode())
    return _loaded[key]


def pre_tokens(text: str) -> list[str]:
    """The words of a text; together they are the text."""
    if "pattern" not in _loaded:
        import regex

        _loaded["pattern"] = regex.compile(PATTERN).findall
    return _loaded["pattern"](text)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, ids and lengths of documents, word numbers) and words (block, number, word) of one partition's texts."""
    names, kinds = ["block", "number", "word", "docs", "lengths", "numbers"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    part, made = TaskContext.get().partitionId(), 0
    pack = zstandard.ZstdCompressor(1)
    docs: list[int] = []
    lengths: list[int] = []
    numbers: list[np.ndarray] = []
    words: defaultdict[str, int] = defaultdict(count().__next__)

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal made, docs, lengths, numbers, words
        key, n = (part << 32) | made, len(words)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((key, None, None, pack.compress(np.array([d or 0 for d in docs], np.int64).tobytes() + bytes(d is None for d in docs)), pack.compress(np.array(lengths, np.int32).tobytes()), pack.compress(flat.tobytes())), kinds)], names=names)
        nothing = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), pa.array([w.encode() for w in words], pa.binary()), nothing, nothing, nothing], names=names)
        made += 1
        docs, lengths, numbers, words = [], [], [], defaultdict(count().__next__)

    size = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = pre_tokens(text or "")
            docs.append(doc)
            lengths.append(len(found))
            numbers.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            size += len(text or "")
            if size >= BLOCK:
                yield from block()
                size = 0
    if docs:
        yield from block()


def _encode(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = word_encoder(content.value), {}
        for b in batches:
            out = []
            for word in b.column(2).to_pylist():
                ids = known.get(word)
                if ids is None:
                    if len(known) > 1 << 20:
                        known.clear()
                    ids = known[word] = np.array(encode(word), np.int32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["block", "number", "ids"])

    return run


def _place(lengths_only: bool):
    """Of one block's documents and encoded words: each document's ids, or their number."""
    unpack = lambda x, t: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), t)

    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(words.column("number").to_numpy())
        ids = words.column("ids").combine_chunks().take(pa.array(order)).to_pylist()
        size = np.array([len(x) // 4 for x in ids], np.int64)
        table, starts = np.frombuffer(b"".join(ids), np.int32), np.concatenate([[0], np.cumsum(size)])
        for d, n, w in zip(*(blocks.column(c).to_pylist() for c in ("docs", "lengths", "numbers"))):
            lengths, numbers = unpack(n, np.int32), unpack(w, np.int32)
            known, none = np.split(unpack(d, np.uint8), [8 * len(lengths)])
            docs = pa.array(known.view(np.int64), mask=none.astype(bool))
            each = size[numbers]
            done = np.concatenate([[0], np.cumsum(each)])
            cuts = done[np.concatenate([[0], np.cumsum(lengths)])]
            if lengths_only:
                out.append(pa.table({"doc_id": docs, "n_tokens": np.diff(cuts)}))
                continue
            at = np.arange(done[-1]) + np.repeat(starts[numbers] - done[:-1], each)
            flat = table[at] if len(at) else np.zeros(0, np.int32)
            out.append(pa.table({"doc_id": docs, "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))}))
        return pa.concat_tables(out)

    return run


def encode_corpus(documents: DataFrame, path: str | None = None, lengths_only: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of documents(doc_id, text), or (doc_id, n_tokens) with lengths_only.

    Null and empty texts give an empty list; a null doc_id stays null. Without special tokens: their strings are ordinary text. Blocks are staged
    once, so texts are cut once; a block is at most about BLOCK characters or one text.
    """
    content = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(path or vocabulary_path()))
    cut = staged(documents.select("doc_id", "text").mapInArrow(_cut, "block long, number int, word binary, docs binary, lengths binary, numbers binary"), "blocks")
    blocks = cut.where("docs is not null").select("block", "docs", "lengths", "numbers")
    words = cut.where("word is not null").select("block", "number", "word").repartition("word")
    encoded = words.mapInArrow(_encode(content), "block long, number int, ids binary")
    schema = "doc_id long, n_tokens long" if lengths_only else "doc_id long, ids array<int>"
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_place(lengths_only), schema)


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): each id joined with its row of the token-byte table.

    The table has a fixed size (one row per id of the vocabulary), so every task holds it and nothing is shuffled.
    Empty and null lists give empty texts; bytes that aren't UTF-8 become the replacement character, unknown ids nothing.
    """
    table = token_bytes(vocabulary_bytes(path or vocabulary_path()))
    size = np.zeros(max(table) + 1, np.int64)
    for i, b in table.items():
        size[i] = len(b)
    flat, starts = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(size))), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for ids in b.column(1):
                i = np.asarray(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], np.int64)
                i = i[(i >= 0) & (i < len(size))]
                n = size[i]
                at = np.arange(n.sum()) + np.repeat(starts[i] - (np.cumsum(n) - n), n)
                texts.append(flat[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
