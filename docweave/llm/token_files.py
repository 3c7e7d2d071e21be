"""Token-ID output in patched frame-of-reference blocks.

File format: a Parquet dataset, so that any store Spark writes to will do and a lost task is simply written again. A
row is a chunk of whole documents:

    shard int, chunk long, n_ids long, doc_id array, n_tokens array<long>, payload_at array<long>, payload binary

Shards are ranges of ascending document ids; chunks count up inside a shard. ``payload_at`` gives each document's place
in the payload. A document's bytes are: number of blocks (u32), byte offset of each block start (u32 each), blocks.
A block holds BLOCK ids (the last one of a document fewer): minimum (u32), width (u8), number of exceptions (u8), the
low ``width`` bits of every id minus the minimum, positions of the exceptions (u8 each), their full differences (u32
each). ``width`` fits the PERCENTILE-th percentile of the block's differences; larger ones are the exceptions.

Equal pieces of text between white space are encoded once per worker, and their ids kept.

Result by case: a null or empty text has the end id alone; null ids come first in the order; rows with equal ids follow
each other by the hash of their text, equal rows in either order; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docweave.session import shared_folder

from .common import keeping, slices, table

BLOCK, PERCENTILE, HEAD = 128, 90, 6
#: A chunk is closed when it holds so many ids; one document is never split.
CHUNK_IDS = 1 << 18
#: Bytes of text that are split and looked up at once.
SLICE_BYTES = 4 << 20
#: Bytes of pieces and words kept in a worker's cache, and what one takes besides its letters (and 40 for each id of a word):
#: objects, dictionary entries at their emptiest, and the ids' places.
CACHE_BYTES, PIECE_BYTES, WORD_BYTES = 128 << 20, 240, 280

#: Letters whose lower case and composed form hold no surprise, then ASCII signs but the apostrophe.
_PLAIN = re.compile(r"([a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)")
#: The sign that byte-level vocabularies show for each byte: itself where it prints, else the next one from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_coders: dict[str, "PieceCoder"] = {}


class PieceCoder(dict):
    """Piece of text -> its number; the ids of all pieces lie in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.words: dict[str, list[int]] = {}
        self.size = self.used = 0
        self.stops = {sign.encode(): self.word_ids(sign) for sign in ".,"}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.at = np.zeros(1, dtype=np.int64)

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self.size += len(piece) + PIECE_BYTES
        self[piece] = number = len(self)
        return number

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer, in lower case."""
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
            ids = self.words[word] = [t.id for t in self.model.tokenize(shown)]
            self.size += len(word) + WORD_BYTES + 40 * len(ids)
        return ids

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        other = []
        words, stops = self.words, self.stops
        for piece in pieces:
            if piece.isalpha():
                word, tail = piece, None
            elif piece[:-1].isalpha() and piece[-1:] in stops:
                word, tail = piece[:-1], stops[piece[-1:]]
            else:
                plain = _PLAIN.fullmatch(text := piece.decode())
                if plain and "<|" not in text:  # letters, then signs: the two words the pre-tokenizer makes of it
                    word, signs = plain.groups()
                    out.append((self.word_ids(word.lower()) if word else []) + (self.word_ids(signs) if signs else []))
                else:
                    other.append(len(out))
                    out.append(None)
                continue
            ids = words.get(word := word.decode().lower())
            if ids is None:
                ids = self.word_ids(word)
            out.append(ids if tail is None else ids + tail)
        found = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in other], add_special_tokens=False)
        for i, e in zip(other, found):
            out[i] = e.ids
        return out

    def learn(self) -> None:
        collecting = gc.isenabled()
        gc.disable()  # only lists of numbers are made here, which hold no cycles
        try:
            got = self.ids_of(self.new)
        finally:
            if collecting:
                gc.enable()
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        more = int(sizes.sum())
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(more, self.used) + more, dtype=np.uint32)])
        self.flat[self.used: self.used + more] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=more)
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes)])
        self.used += more
        self.new = []

    def numbers(self, texts: pa.Array | list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts (binary, nulls are empty) and how many each text has; distinct ones are looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        shown = pc.fill_null(texts, b"").view(pa.string())  # as bytes, nothing is decoded
        lower = pc.if_else(pc.match_substring(shown, "<|"), shown, pc.ascii_lower(shown))
        split = pc.ascii_split_whitespace(lower)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        found = split.flatten().dictionary_encode()
        if not len(found):
            return np.zeros(0, dtype=np.int64), counts
        # No piece holds a line break, so joining and splitting gives them as bytes; it is the fastest way out of Arrow.
        whole = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary.view(pa.binary()))
        pieces = pc.binary_join(whole, b"\n")[0].as_py().split(b"\n")
        distinct = np.fromiter(map(self.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return distinct[found.indices.to_numpy()], counts

    def encode(self, texts: pa.Array | list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and the number of ids of each text."""
        if self.size > CACHE_BYTES:
            self.forget()
        piece, counts = self.numbers(texts)
        if self.new:
            self.learn()
        start, size = self.at[piece], self.at[piece + 1] - self.at[piece]
        ends = np.concatenate([[0], np.cumsum(size)])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]) + 1
        source = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        out = np.full(int(lengths.sum()), end_id, dtype=np.uint32)
        last = np.cumsum(lengths) - 1
        inside = np.ones(len(out), dtype=bool)
        inside[last] = False
        out[inside] = self.flat[source]
        return out, lengths


def _block_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block: its document, its first id's place, its number of ids."""
    blocks = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = (np.cumsum(lengths) - lengths)[doc] + nth * BLOCK
    return doc, first, np.minimum(BLOCK, lengths[doc] - nth * BLOCK)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _packed_words(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values, one after another, as bytes."""
    if width > 16:
        bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
        return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")
    # Eight values make ``width`` bytes; four of them fit in a 64-bit word.
    w, low = np.uint64(width), (values & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(len(values), -1, 2, 4)
    fours = low[..., 0] | low[..., 1] << w | low[..., 2] << w * np.uint64(2) | low[..., 3] << w * np.uint64(3)
    words = np.zeros((*fours.shape[:2], 2), dtype="<u8")
    if width == 16:
        words[:] = fours
    else:
        words[..., 0] = fours[..., 0] | fours[..., 1] << w * np.uint64(4)
        words[..., 1] = fours[..., 1] >> (np.uint64(64) - w * np.uint64(4))
    return words.view(np.uint8)[..., :width].reshape(len(values), -1)


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The documents' bytes, one after another, and the place of each; ``ids`` u32, every length at least 1."""
    lengths = np.asarray(lengths, dtype=np.int64)
    doc, first, count = _block_table(lengths)
    n = len(doc)
    lanes = np.arange(BLOCK)
    real = lanes < count[:, None]
    at = first[:, None] + lanes
    values = ids[np.minimum(at, len(ids) - 1)] if len(ids) else np.zeros((0, BLOCK), dtype=np.uint32)
    low = np.where(real, values, np.uint32(0xFFFFFFFF)).min(axis=1) if n else np.zeros(0, dtype=np.uint32)
    diff = np.where(real, values - low[:, None], np.uint32(0))
    ranked = np.sort(np.where(real, diff, np.uint32(0xFFFFFFFF)), axis=1)
    width = _bits(ranked[np.arange(n), (count - 1) * PERCENTILE // 100])
    over = (_bits(diff) if n else np.zeros((0, BLOCK), dtype=np.int64)) > width[:, None]
    patches = over.sum(axis=1)
    packed = -(-count * width // 8)
    size = HEAD + packed + 5 * patches

    blocks_of = -(-lengths // BLOCK)
    doc_size = 4 + 4 * blocks_of + np.bincount(doc, weights=size, minlength=len(lengths)).astype(np.int64)
    doc_at = np.cumsum(doc_size) - doc_size
    before = np.cumsum(size) - size
    first_of_doc = np.cumsum(blocks_of) - blocks_of
    start = 4 + 4 * blocks_of[doc] + before - before[first_of_doc[doc]]  # inside the document
    place = doc_at[doc] + start
    out = np.zeros(int(doc_size.sum()), dtype=np.uint8)

    def put(where: np.ndarray, what: np.ndarray) -> None:
        out[where[:, None] + np.arange(4)] = what.astype("<u4").view(np.uint8).reshape(-1, 4)

    put(doc_at, blocks_of)
    put(doc_at[doc] + 4 + 4 * (np.arange(n) - first_of_doc[doc]), start)
    put(place, low)
    out[place + 4] = width
    out[place + 5] = patches
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 2048)):
            body = _packed_words(diff[part], int(w))
            keep = np.arange(body.shape[1]) < packed[part][:, None]
            out[(place[part][:, None] + HEAD + np.arange(body.shape[1]))[keep]] = body[keep]
    row, lane = np.nonzero(over)
    nth = np.arange(len(row)) - (np.cumsum(patches) - patches)[row]
    tail = place[row] + HEAD + packed[row]
    out[tail + nth] = lane
    put(tail + patches[row] + 4 * nth, diff[row, lane])
    return out.tobytes(), doc_at


def unpack(payload: bytes, lengths: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """The ids of all documents of a chunk."""
    lengths, doc_at = np.asarray(lengths, dtype=np.int64), np.asarray(doc_at, dtype=np.int64)
    raw = np.frombuffer(payload, dtype=np.uint8)
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    doc, first, count = _block_table(lengths)
    n = len(doc)

    def get(where: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(raw[where[:, None] + np.arange(4)]).view("<u4")[:, 0]

    blocks_of = -(-lengths // BLOCK)
    nth = np.arange(n) - (np.cumsum(blocks_of) - blocks_of)[doc]
    place = doc_at[doc] + get(doc_at[doc] + 4 + 4 * nth).astype(np.int64)
    low, width, patches = get(place), raw[place + 4].astype(np.int64), raw[place + 5].astype(np.int64)
    packed = -(-count * width // 8)
    diff = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 2048)):
            bit = np.arange(BLOCK) * w
            word = np.lib.stride_tricks.as_strided(padded, (len(raw), 8), (1, 1))[np.minimum(place[part][:, None] + HEAD + bit // 8, len(raw) - 1)]
            diff[part] = (word.view("<u8")[..., 0] >> (bit % 8).astype(np.uint64) & np.uint64((1 << int(w)) - 1)).astype(np.uint32)
    row = np.repeat(np.arange(n), patches)
    nth = np.arange(len(row)) - (np.cumsum(patches) - patches)[row]
    tail = place[row] + HEAD + packed[row]
    diff[row, raw[tail + nth]] = get(tail + patches[row] + 4 * nth)
    return (diff + low[:, None])[np.arange(BLOCK) < count[:, None]]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write them at ``path`` in ascending id order."""
    kind = docs.schema[id_col].dataType
    id_type = pa.int64() if kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping(__name__, _coders.clear)
        coder = _coders.get(tokenizer) or _coders.setdefault(tokenizer, PieceCoder(tokenizer))
        shard, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            payload, at = pack(ids, lengths)
            arrays = [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([[i for h in held for i in h[2]]], pa.list_(id_type)),
                      pa.array([lengths], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "chunk", "n_ids", "doc_id", "n_tokens", "payload_at", "payload"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, lengths = coder.encode(batch.column("text"), end_id)
                names, ends = batch.column("id").to_pylist(), np.cumsum(lengths)
                # Documents by the CHUNK_IDS ids among which they begin.
                cuts = [0, *(np.flatnonzero(np.diff((ends - lengths) // CHUNK_IDS)) + 1).tolist(), len(names)]
                for low, high in zip(cuts, cuts[1:]):
                    held.append((ids[ends[low] - lengths[low]: ends[high - 1]], lengths[low:high], names[low:high]))
                    if sum(len(h[0]) for h in held) >= CHUNK_IDS:
                        yield close()
                        number, held = number + 1, []
        if held:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = f"shard int, chunk long, n_ids long, doc_id array<{'bigint' if id_type == pa.int64() else 'string'}>, n_tokens array<bigint>, payload_at array<bigint>, payload binary"
    ordered.mapInArrow(encode, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Id, start, n_tokens and the crc32 of the ids of every document, decoded from the files at ``path``."""
    chunks = spark.read.parquet(path)
    sizes = chunks.select("shard", "chunk", "n_ids")
    id_kind = chunks.schema["doc_id"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = batch.column("n_tokens")[row].values.to_numpy(zero_copy_only=False)
                ids = unpack(batch.column("payload")[row].as_py(), lengths, batch.column("payload_at")[row].values.to_numpy(zero_copy_only=False))
                ends = np.cumsum(lengths)
                view = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(view[4 * a: 4 * b]) for a, b in zip(ends - lengths, ends)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("shard")[row].as_py()), pa.int32()), pa.array(np.full(n, batch.column("chunk")[row].as_py()), pa.int64()),
                     batch.column("doc_id")[row].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["shard", "chunk", id_col, "inside", "n_tokens", "ids_crc32"])

    docs = chunks.mapInArrow(decode, f"shard int, chunk long, `{id_col}` {id_kind}, inside long, n_tokens long, ids_crc32 long")
    # Shards are as many as the writer's tasks; chunks are summed inside their shard.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    base = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    offset = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    chunk_at = sizes.withColumn("offset", offset).join(base, "shard").select("shard", "chunk", (F.col("offset") + F.col("base")).alias("first"))
    return docs.join(chunk_at, ["shard", "chunk"]).select(id_col, (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, end_id: int = 1) -> DataFrame:
    """Write the documents' ids to a new folder beside the checkpoints and return what reading them back gives."""
    import public_tokenizers

    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id)
    return read_token_files(spark, path)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_files": op7_token_files}
