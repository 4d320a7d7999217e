"""Packing by concatenate and cut: all token ids on one line, cut into windows of a fixed length.

Pass one tokenises every document once and stores its ids with the partition it was written by and its start
there. The partitions' totals (one number each) add up to every partition's start on the line of all
tokens. Pass two reads the stored ids, adds that start and cuts where a window ends: a document gives one boundary
record for each window it reaches. Only the last window of all is not full, so padding is below one window.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from cadastre.llm.text import table
from cadastre.session import arrow_rows, materialize

SLICE = 4 << 20  # bytes of text encoded at a time; a longer text is encoded by itself
TEXTS = 1_000  # texts, or the ids of so many, in one batch
LONG = 200  # characters from which on a chunk goes through the whole tokenizer
ODD = r"[^\x21-\x7e\x{c0}-\x{ff}]|<[|]"  # what a chunk must not hold to go to the merges directly


class ChunkEncoder:
    """Ids of texts by a word-end BPE tokenizer, whose pre-tokens never span a blank: each distinct chunk between blanks of a slice is encoded once.

    Short chunks of ASCII and Latin-1 letters are lower-cased, cut by the tokenizer's own pattern and merged as bytes, the
    end of a word being a blank; any other chunk goes through the whole tokenizer. Nothing is kept from slice to slice.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self.pattern = regex.compile(given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}  # the byte-level alphabet
        suffix, vocab = given["model"]["end_of_word_suffix"], given["model"]["vocab"]
        ranks = {}
        for token, rank in vocab.items():  # ids stand in the order of the merges
            body = token.removesuffix(suffix) or token
            ranks[bytes(byte_of[c] for c in body) + (b" " if body != token else b"")] = rank
        self.merges = Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.line_break = ranks[b"\n "]

    def _merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain chunks, and how many each has."""
        words = self.pattern.findall("\n".join([*chunks, ""]).lower())
        ids = self.merges.encode_to_numpy(" ".join([*words, ""])).astype(np.int32)
        breaks = np.flatnonzero(ids == self.line_break)  # one behind each chunk
        return np.delete(ids, breaks), np.diff(breaks, prepend=-1) - 1

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in some order, where each chunk's begin and how many it has."""
        odd = pc.or_(pc.match_substring_regex(chunks, ODD), pc.or_(pc.equal(chunks, ""), pc.greater(pc.utf8_length(chunks), LONG)))
        ids, plain_sizes = self._merged(chunks.filter(pc.invert(odd)).to_pylist())
        others = [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(chunks.filter(odd).to_pylist(), add_special_tokens=False)]
        at = odd.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)])
        lengths = np.concatenate([plain_sizes, np.array([len(o) for o in others], np.int64)])
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[order], sizes[order] = np.cumsum(lengths) - lengths, lengths
        return np.concatenate([ids, *others]), starts, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end_id` behind those of each text, and where each text's end."""
        parts = pc.ascii_split_whitespace(texts)
        chunks = parts.flatten().dictionary_encode()
        found, starts, sizes = self._encode_chunks(chunks.dictionary)
        slots = chunks.indices.to_numpy()
        sizes = sizes[slots]
        ends = np.cumsum(sizes)
        ids = found[np.repeat(starts[slots] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[parts.offsets.to_numpy()[1:]]
        return np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ChunkEncoder:
    """One for each worker process, whichever tasks it runs."""
    return ChunkEncoder(path)


def tokenize(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(key, ids, part, first): the ids of each text and `end_id`, the writing partition and the tokens before it there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).fill_null("")
            volume = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE
            for group in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(volume)) + 1):
                if not len(group):
                    continue
                ids, ends = encoder.encode(texts.slice(group[0], len(group)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                keys = batch.column(0).slice(group[0], len(group))
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array(np.full(len(ends), part, np.int32)), pa.array(first + np.concatenate([[0], ends[:-1]]))], names=["key", "ids", "part", "first"])
                first += int(ends[-1])

    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField("key", picked.schema["key"].dataType), *T._parse_datatype_string("ids array<int>, part int, first bigint").fields])
    return picked.mapInArrow(encode, kind)


def concatenate_and_cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, digest: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset; with `digest`, ids_crc32 in place of ids.

    A NULL or empty text is a document of the one id `end_id`. Repeated rows and NULL ids are documents of their own;
    texts longer than a window are cut as often as needed; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, TEXTS):
        stored = materialize(tokenize(docs, tokenizer, id_col, text_col, end_id), "tokens")
    totals = stored.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).orderBy("part").collect()  # one row per partition
    starts, run = {}, 0
    for row in totals:
        starts[row["part"]] = run
        run += row["n"]
    base = spark.sparkContext.broadcast(starts)
    content = "ids_crc32 bigint" if digest else "ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            lists = batch.column(1)
            limits = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            rows, pieces = [], []
            for i, (part, first) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                ids = values[limits[i] : limits[i + 1]]
                at, begin = base.value[part] + first, 0
                while begin < len(ids):
                    size = min(length - at % length, len(ids) - begin)
                    rows.append((i, begin, size, len(ids), at // length, at % length))
                    pieces.append(ids[begin : begin + size])
                    begin, at = begin + size, at + size
            if not rows:
                continue
            table = np.array(rows, np.int64)
            ends = np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int32)
            numbers = {n: pa.array(table[:, k]) for k, n in enumerate(("row", "start", "length", "doc_tokens", "sequence_id", "offset"))}
            ids = crc32_of(pieces) if digest else pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(numbers["row"]), numbers["start"], numbers["length"], ids, numbers["doc_tokens"], numbers["sequence_id"], numbers["offset"]],
                names=[id_col, "start", "length", content.split()[0], "doc_tokens", "sequence_id", "offset"],
            )

    kind = T.StructType([T.StructField(id_col, stored.schema["key"].dataType), *T._parse_datatype_string(f"start bigint, length bigint, {content}, doc_tokens bigint, sequence_id bigint, offset bigint").fields])
    return stored.mapInArrow(cut, kind)


def crc32_of(pieces: list[np.ndarray]) -> pa.Array:
    """crc32 of each piece's ids as little-endian unsigned 32-bit numbers."""
    return pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in pieces], pa.int64())


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_concatenate_and_cut(spark, sf_dir: str) -> DataFrame:
    pieces = concatenate_and_cut(table(spark, sf_dir, "documents"), vocabulary(), digest=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
