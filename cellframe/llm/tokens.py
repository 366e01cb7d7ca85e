"""Encoding and decoding of a corpus with a public byte-level tokenizer.

Texts are cut into pre-tokens. A block of documents keeps, for every position,
the number of the pre-token in the block's own word list. The word lists of all
blocks meet in one shuffle, where each distinct word of the corpus is encoded
once; the ids are joined back to the blocks and put in place by position. A word
has one row a block however often it occurs; words that stand in very many
blocks are spread over tasks in that join. Decoding goes the same way with ids in
place of words, joined with the token-byte table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators.skew import heavy_keys, salted_join
from cellframe.runtime import Scratch

#: Where the vocabulary files lie; every function takes another folder.
FOLDER = "/opt/tokenizers"
#: A block is closed when it has this many characters; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Fixed value: the published pre-token pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS = "block long, doc_ids array<long>, lengths array<int>, codes binary, words array<string>"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN).findall


def _ints(n: int):
    return np.uint16 if n <= 1 << 16 else np.uint32


def _block(number: int, ids: list[int], pieces: list[list[str]]) -> pa.RecordBatch:
    """One block: its word list, commonest words first, and the number of the word at each position."""
    where: dict[str, int] = {}
    number_of = where.setdefault
    lengths = [len(p) for p in pieces]
    raw = np.fromiter((number_of(w, len(where)) for p in pieces for w in p), np.int64, sum(lengths))
    counts = np.bincount(raw, minlength=len(where))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = list(where)
    codes = place[raw].astype(_ints(len(words))).tobytes()
    columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([codes], pa.binary()), pa.array([[words[i] for i in order]], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "lengths", "codes", "words"])


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, number = _splitter(), TaskContext.get().partitionId() << 32
        ids: list[int] = []
        pieces: list[list[str]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if ids and size + len(text) > limit:
                    yield _block(number, ids, pieces)
                    number, ids, pieces, size = number + 1, [], [], 0
                ids.append(doc)
                pieces.append(split(text))
                size += len(text)
        if ids:
            yield _block(number, ids, pieces)

    return run


def ship(spark, vocabulary: str) -> str:
    """Sends the vocabulary file to every executor; the name by which tasks find it."""
    spark.sparkContext.addFile(vocabulary)
    return Path(vocabulary).name


def shipped(name: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shipped(name)).encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _expand(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at all positions, one after the other, and how many each position has."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    each = lengths[codes]
    if not len(codes):
        return values[:0], each
    ends = np.cumsum(each)
    at = np.arange(ends[-1]) - np.repeat(ends - each, each) + np.repeat(starts[codes], each)
    return values[at], each


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, counts = (batch.column(i)[row].as_py() for i in (0, 1))
            held = batch.column(3)[row].values  # ids of the block's words, by number
            if held is None:
                flat, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
            else:
                lists = held.field(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
            codes = np.frombuffer(batch.column(2)[row].as_py(), _ints(len(sizes))).astype(np.int64)
            ids, each = _expand(flat, sizes, codes)
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            step = 1024
            for s in range(0, len(doc_ids), step):
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[s : s + step], pa.int64()), lists[s : s + step]], ["doc_id", "ids"])


def encode_corpus(documents: DataFrame, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) for every row of documents (doc_id, text): the token ids of the whole, unchanged text.

    Null and empty texts have an empty list. No special tokens are made: their
    strings are ordinary text. Rows that repeat a doc_id come out once each;
    other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "tokens")
    cut = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks(block_chars), BLOCKS)
    blocks = scratch.save(cut, "blocks")
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    counts = scratch.save(words.groupBy("word").count(), "words")
    encoded = counts.select("word").mapInArrow(_encode(ship(documents.sparkSession, vocabulary)), "word string, ids array<int>")
    hot = heavy_keys(counts, "word", "count", counts.agg(F.sum("count")).first()[0] or 0)
    lists = salted_join(words, encoded, "word", hot).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "ids"))).alias("held"))
    whole = blocks.select("block", "doc_ids", "lengths", "codes").join(lists, "block", "left")
    return whole.select("doc_ids", "lengths", "codes", "held").mapInArrow(_reassemble, "doc_id long, ids array<int>")


def token_bytes(spark, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The token-byte table: id, bytes. Its size is the vocabulary's."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(vocabulary).items()], "id int, bytes binary")


CODED = "block long, doc_ids array<long>, lengths array<int>, codes binary, ids array<int>"
#: A block of token ids is closed when it has this many.
BLOCK_IDS = 1 << 18


def _id_blocks(limit: int):
    """(doc_id, ids) batches to blocks: the distinct ids of each, and the place of the id at every position."""

    def block(number: int, docs: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids, codes = np.unique(flat, return_inverse=True)
        columns = [pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([codes.astype(_ints(len(ids))).tobytes()], pa.binary()), pa.array([ids.tolist()], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "lengths", "codes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, docs, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = row.values.to_numpy(zero_copy_only=False).astype(np.int64) if row.is_valid and len(row) else np.zeros(0, np.int64)
                if docs and size + len(ids) > limit:
                    yield block(number, docs, parts)
                    number, docs, parts, size = number + 1, [], [], 0
                docs.append(doc)
                parts.append(ids)
                size += len(ids)
        if docs:
            yield block(number, docs, parts)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs, counts = (batch.column(i)[row].as_py() for i in (0, 1))
            held = batch.column(3)[row].as_py() or []  # bytes of the block's ids, by place
            lengths = np.array([len(h["bytes"]) for h in held], np.int64)
            values = np.frombuffer(b"".join(h["bytes"] for h in held), np.uint8)
            codes = np.frombuffer(batch.column(2)[row].as_py(), _ints(len(held))).astype(np.int64)
            ends, texts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), []
            for i in range(len(docs)):
                found, _ = _expand(values, lengths, codes[ends[i] : ends[i + 1]])
                texts.append(found.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_corpus(tokens: DataFrame, vocabulary: str = f"{FOLDER}/byte_bpe_50k.tiktoken", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the distinct ids of blocks joined with the token-byte table, put in place by position.

    The table has the vocabulary's size, so it is broadcast. An empty or null list
    gives an empty text; an id the vocabulary lacks raises; bytes that aren't
    UTF-8 become the replacement character. Rows that repeat a doc_id come out
    once each; an empty table gives no rows.
    """
    scratch = Scratch(tokens.sparkSession, "texts")
    cut = tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_id_blocks(block_ids), CODED)
    blocks = scratch.save(cut, "blocks")
    used = blocks.select("block", F.posexplode("ids").alias("code", "id")).join(F.broadcast(token_bytes(tokens.sparkSession, vocabulary)), "id", "left")
    known = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("unknown token id "), F.col("id"))).cast("binary")).otherwise(F.col("bytes"))
    lists = used.select("block", "code", known.alias("bytes")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "bytes"))).alias("held"))
    whole = blocks.select("block", "doc_ids", "lengths", "codes").join(lists, "block", "left")
    return whole.select("doc_ids", "lengths", "codes", "held").mapInArrow(_texts, "doc_id long, text string")
