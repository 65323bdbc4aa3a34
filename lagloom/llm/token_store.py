"""Token ids in a binary store with one shared zstandard dictionary.

Every document's ids, as 16-bit (or 32-bit) integers and with the end id, are
one zstandard frame made with the shared dictionary. A block row holds the
frames of consecutive documents, their offset index and the dictionary's hash,
so one short document is read by slicing one frame out of one block.

Blocks are Parquet rows written by Spark, so half-written files are never seen
and a lost task is simply run again.

Defined results: null text counts as empty (just the end id); rows with equal
doc_id stay side by side; a null doc_id comes first; an empty table gives no
blocks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, partitions, stored
from .tokens import TOKENIZER, encoder

#: The dictionary is trained on at most so many documents, the first in a
#: hashed order of doc_id, of at most so many bytes of text each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1024, 8192, 65536
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 8192

_BLOCK = (
    "shard int, block int, first_id long, last_id long, shard_start long, width int, dict_sha256 string, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
)
_BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()),
        ("shard_start", pa.int64()), ("width", pa.int32()), ("dict_sha256", pa.string()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def _serial(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, width: int, end_id: int, tokenizer: str) -> bytes:
    """A dictionary of the ids of at most SAMPLE_DOCS documents, the first in a
    hashed order among those of at most SAMPLE_BYTES. Samples too few to train
    on serve as the dictionary's content themselves."""
    import zstandard

    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    usable = usable.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    # Only ids and digests are ranked; the chosen texts alone come to the driver.
    picked = usable.select("doc_id", "digest").orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(SAMPLE_DOCS).distinct()
    texts = usable.join(F.broadcast(picked), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).collect()
    encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
    samples = [_serial(encode(r["text"]) + end, width) for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"]))]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        if len(samples) == SAMPLE_DOCS:
            raise
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


class TokenStore:
    """A store at ``path``: blocks/ and dictionary/ in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None, end_id: int = 0, tokenizer: str = TOKENIZER) -> TokenStore:
        spark = docs.sparkSession
        store = cls(spark, path or fresh_path(spark, "token-store"))
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        width = 2 if max(encoder(tokenizer).library.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        raw = train_dictionary(docs, width, end_id, tokenizer)
        sha, end = hashlib.sha256(raw).hexdigest(), np.array([end_id], "<u4").tobytes()
        spark.createDataFrame([(sha, bytearray(raw))], "dict_sha256 string, raw binary").coalesce(1).write.parquet(
            f"{store.path}/dictionary"
        )

        def frames(batches):
            import zstandard

            squeeze = zstandard.ZstdCompressor(dict_data=_dictionary(raw), write_content_size=True).compress
            encode = encoder(tokenizer).encode
            for b in batches:
                n, out = [], []
                for text in b.column("text").to_pylist():
                    ids = encode(text) + end
                    n.append(len(ids) // 4)
                    out.append(squeeze(_serial(ids, width)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "n_tokens", "frame"],
                )

        def blocks(batches):
            shard, block, start = TaskContext.get().partitionId(), 0, 0
            ids, n, out, size = [], [], [], 0

            def row():
                known = [i for i in ids if i is not None]
                columns = [
                    shard, block, known[0] if known else None, known[-1] if known else None, start, width, sha,
                    list(ids), list(n), [0, *np.cumsum([len(f) for f in out]).tolist()], b"".join(out),
                ]
                return pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(columns, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW
                )

            for b in batches:
                for i, k, frame in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True):
                    if out and (size + len(frame) > BLOCK_BYTES or len(out) == BLOCK_DOCS):
                        yield row()
                        block, start, size = block + 1, start + sum(n), 0
                        ids, n, out = [], [], []
                    ids.append(i), n.append(k), out.append(frame)
                    size += len(frame)
            if out:
                yield row()

        framed = stored(docs.mapInArrow(frames, "doc_id long, n_tokens long, frame binary"), "token-frames")
        order = ["doc_id", "n_tokens", "frame"]
        (
            framed.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("frame"))
            .sortWithinPartitions(*order)
            .mapInArrow(blocks, _BLOCK)
            .write.parquet(f"{store.path}/blocks")
        )
        return store

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")

    def dictionary(self) -> tuple[str, bytes]:
        row = self.spark.read.parquet(f"{self.path}/dictionary").first()
        return row["dict_sha256"], bytes(row["raw"])

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, frame_bytes from the files.

        A shard's place needs only the shards' totals: as many rows as shards.
        """
        totals = self.blocks().groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
        starts, before = [], 0
        for r in sorted(totals.collect()):
            starts.append((r["shard"], before))
            before += r["n"]
        starts = self.spark.createDataFrame(starts or [(0, 0)], "shard int, base long")
        unpack = self._unpacker()

        def rows(batches):
            for b in batches:
                for r in b.to_pylist():
                    at, cols = r["base"] + r["shard_start"], ([], [], [], [], [])
                    for i, k, ids, size in unpack(r):
                        for c, v in zip(cols, (i, at, k, zlib.crc32(ids), size), strict=True):
                            c.append(v)
                        at += k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes"]
                    )

        return (
            self.blocks()
            .join(F.broadcast(starts), "shard")
            .mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long")
        )

    def _unpacker(self):
        sha, raw = self.dictionary()

        def unpack(r, only=None):
            import zstandard

            if r["dict_sha256"] != sha:
                raise ValueError(f"block made with dictionary {r['dict_sha256']}, not {sha}")
            expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
            for j, (i, k) in enumerate(zip(r["doc_ids"], r["n_tokens"], strict=True)):
                if only is None or i in only:
                    lo, hi = r["offsets"][j : j + 2]
                    ids = expand(r["payload"][lo:hi])
                    if r["width"] == 2:
                        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    if len(ids) != 4 * k:
                        raise ValueError(f"document {i}: {len(ids) // 4} ids, not {k}")
                    yield i, k, ids, hi - lo

        return unpack

    def lookup(self, doc_ids: list[int]) -> DataFrame:
        """doc_id and ids of a few documents: only their blocks are read, only
        their frames are expanded."""
        unpack, wanted = self._unpacker(), set(doc_ids)
        near = F.lit(False)
        for i in wanted:
            near |= F.lit(i).between(F.col("first_id"), F.col("last_id"))

        def rows(batches):
            for b in batches:
                for r in b.to_pylist():
                    found = [(i, np.frombuffer(ids, "<u4").tolist()) for i, _, ids, _ in unpack(r, wanted)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                        ["doc_id", "ids"],
                    )

        return self.blocks().where(near).mapInArrow(rows, "doc_id long, ids array<long>")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenStore.write(documents(spark, sf_dir)).read()
