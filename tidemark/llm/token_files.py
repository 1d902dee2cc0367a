"""Token ids as compressed binary files, in the order of the documents, and back.

A file is a row of records, each 16 bytes of header (magic, kind, length of the body, CRC-32 of the body), the body and
a newline. It holds segments one after the other:

- ``P``: shard, vocabulary, ids in a block, and the prior of order 0 (zlib);
- ``D``: the segment's documents: ids, which of them are null, and numbers of tokens (zlib);
- ``B``: a block: how many ids, their CRC-32 as little-endian 32-bit integers, and their code.

A segment holds whole documents; its ids are cut into blocks of ``BLOCK``, each coded from the same reset state (see
``range_coder``). Spark writes the files (text writer, one record to a row, so a lost task leaves nothing behind) and
reads them (``binaryFile``), so they can be in any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import range_coder
from tidemark.llm.common import durable, new_path
from tidemark.llm.tokens import Memo, load_tokenizer, of_worker

MAGIC = b"TMI1"
HEADER, HEADER_SIZE = "<4s4sII", 16
#: Ids in a block, and blocks that are coded in lock step.
BLOCK, LANES = 1024, 4096
#: Words that are looked up at once.
WORDS_AT_ONCE = 500_000


class DamagedFile(ValueError):
    pass


def _record(kind: bytes, body: bytes) -> bytes:
    return struct.pack(HEADER, MAGIC, kind.ljust(4), len(body), zlib.crc32(body)) + body


def _records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(content):
        magic, kind, length, crc = struct.unpack_from(HEADER, content, at)
        body = content[at + HEADER_SIZE : at + HEADER_SIZE + length]
        if magic != MAGIC or len(body) != length or zlib.crc32(body) != crc:
            raise DamagedFile(f"record at byte {at}")
        yield kind.rstrip(), body
        at += HEADER_SIZE + length + 1  # the newline


def write_segment(shard: int, vocabulary: int, documents: list[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
    """The records of a segment."""
    ids = np.concatenate([t for _, t in documents]).astype(np.int64)
    prior = range_coder.Prior.of(ids, vocabulary)
    tables = prior.widths.astype("<u2").tobytes() + prior.groups.astype("<u2").tobytes()
    yield _record(b"P", struct.pack("<III", shard, vocabulary, BLOCK) + zlib.compress(tables))
    names = np.array([0 if k is None else k for k, _ in documents], "<i8").tobytes()
    nulls = np.array([k is None for k, _ in documents], "u1").tobytes()
    sizes = np.array([len(t) for _, t in documents], "<u8").tobytes()
    yield _record(b"D", struct.pack("<I", len(documents)) + zlib.compress(names + nulls + sizes))
    for a in range(0, len(ids), BLOCK * LANES):
        part = ids[a : a + BLOCK * LANES]
        rows = np.zeros(-(-len(part) // BLOCK) * BLOCK, np.int64)
        rows[: len(part)] = part
        rows = rows.reshape(-1, BLOCK)
        for k, code in enumerate(range_coder.encode(rows, prior)):
            own = part[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()
            yield _record(b"B", struct.pack("<II", len(own) // 4, zlib.crc32(own)) + code)


def read_file(content: bytes) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(shard, doc ids, numbers of tokens, ids) of each segment; every checksum is compared."""
    shard = documents = prior = None
    blocks: list[bytes] = []

    def ids() -> np.ndarray:
        out = []
        for a in range(0, len(blocks), LANES):
            some = blocks[a : a + LANES]
            for row, b in zip(range_coder.decode([b[8:] for b in some], length, prior), some):
                n, crc = struct.unpack_from("<II", b)
                row = row[:n].astype("<u4")
                if zlib.crc32(row.tobytes()) != crc:
                    raise DamagedFile("the ids of a block differ from their checksum")
                out.append(row)
        return np.concatenate(out)

    for kind, body in _records(content):
        if kind == b"P":
            if blocks:
                yield shard, *documents, ids()
                blocks = []
            shard, vocabulary, length = struct.unpack_from("<III", body)
            tables = np.frombuffer(zlib.decompress(body[12:]), "<u2")
            n_groups = -(-vocabulary // range_coder.GROUP)
            prior = range_coder.Prior(tables[: n_groups * range_coder.GROUP], tables[n_groups * range_coder.GROUP :])
        elif kind == b"D":
            (n,) = struct.unpack_from("<I", body)
            data = zlib.decompress(body[4:])
            names, nulls = np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n)
            documents = [None if gone else int(k) for k, gone in zip(names.tolist(), nulls.tolist())], np.frombuffer(data, "<u8", n, 9 * n).astype(np.int64)
        else:
            blocks.append(body)
    if blocks:
        yield shard, *documents, ids()


def _tokens(texts: pa.Array, memo: Memo, end: bytes) -> Iterator[np.ndarray]:
    """Ids of each text. White space ends words and leaves nothing, so words are encoded once and looked up after."""
    waiting, n = [], 0
    for k in range(len(texts) + 1):
        if k < len(texts):
            waiting.append((texts[k].as_py() or "").encode("utf-8", "surrogatepass").split())
            n += len(waiting[-1])
        if n >= WORDS_AT_ONCE or k == len(texts):
            memo.learn(w for words in waiting for w in words)
            look = memo.__getitem__
            for words in waiting:
                yield np.frombuffer(b"".join(map(look, words)) + end, "<u4")
            waiting, n = [], 0


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the ids to files below ``path``, in ascending order of doc_id.

    A null text is the empty text and has the end id alone; rows without id come last, and rows of one id in the order
    of a hash of their texts. Files are ranges of ids, one to a shuffle partition; the ranges are cut by id, text and row, so
    that an id, or a row, that is there very many times is cut too. The tokenizer must drop white space, as the words between it are encoded
    apart (ASCII white space; what else a tokenizer splits at is left to it).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        vocabulary = tok.get_vocab_size(with_added_tokens=True)

        def encode(words: list[bytes]):
            return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)]

        memo = of_worker(("words", tokenizer), lambda: Memo(encode))
        memo.compute = encode
        end, shard = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(write_segment(shard, vocabulary, held)), pa.binary())], names=["record"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), _tokens(batch.column(1), memo, end)):
                held.append((key, ids))
                n += len(ids)
                if n >= BLOCK * LANES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    rows = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text").withColumn("nth", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("nth")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Bytes pass through the text writer as they are; it puts a newline behind each record.
    records = rows.mapInArrow(work, "record binary").selectExpr("cast(record as string) as record")
    records.write.option("lineSep", "\n").option("compression", "none").text(path)


READ_SCHEMA = "doc_id long, shard long, at long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: its shard, the place of its first id among the shard's, number of ids, their CRC-32 and, if asked for, the ids."""
    schema = READ_SCHEMA + (", ids array<long>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                at = 0
                for shard, names, sizes, ids in read_file(content.as_py()):
                    ends = np.cumsum(sizes)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                    columns = [
                        pa.array(names, pa.int64()),
                        pa.array(np.full(len(sizes), shard), pa.int64()),
                        pa.array(at + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.strip().split()[0] for c in schema.split(", ")])
                    at += int(ends[-1])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, schema)


def token_index(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    One row per row of ``docs``; an empty table gives none. Of the corpus only one number for each file reaches the driver.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, path, **options)
    rows = durable(read_token_files(spark, path), "token-index")
    sizes = sorted((r.shard, r.n) for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    before = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, starts)], "_shard long, _before long")
    joined = rows.join(F.broadcast(before), F.col("shard") == F.col("_shard"))
    return joined.select("doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
