"""Token-ID output: canonical length-limited Huffman codes of ids in independent blocks, with bit offsets as checkpoints."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read, shared_dir
from ._tokens import encoder, slices, vocabulary_path
from ._words import binaries

#: Ids of a block, about; a block holds whole documents.
BLOCK_IDS = 1 << 17
#: Ids between two checkpoints.
STEP = 128
MAGIC = b"TMH1"
HEAD = struct.Struct("<4sIQIQ")


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Bits of the optimal prefix code of at most `longest` bits for each id; 0 where the count is 0. Package-merge, with counts of leaves in place of sets."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit into {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, weights = [], leaves
    for level in range(longest):
        if level:
            packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, packages])
            rank = np.argsort(both, kind="stable")
            weights = both[rank]
            levels.append(np.cumsum(rank < n))
        else:
            levels.append(np.arange(1, n + 1))
    take = 2 * n - 2
    for leaf in reversed(levels):
        if take <= 0:
            break
        a = int(leaf[take - 1])
        lengths[order[:a]] += 1
        take = 2 * (take - a)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id), each the one before plus 1, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    code, bits = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - bits
        bits = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of the codes one after the other, first bit of each id)."""
    bits = lengths[ids]
    ends = np.cumsum(bits)
    at = ends - bits
    words = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 2, np.uint64)
    if len(ids):
        code, word = codes[ids], at >> 6
        over = (at & 63) + bits - 64
        fits = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(fits, first)
        spill = np.flatnonzero(over > 0)
        words[word[spill] + 1] += code[spill] << (64 - over[spill]).astype(np.uint64)
    return words, at


def decode_table(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, bits) for every `longest` next bits."""
    ids, bits = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    each = 1 << (longest - lengths[order])
    n = int(each.sum())
    ids[:n], bits[:n] = np.repeat(order, each), np.repeat(lengths[order], each)
    return ids, bits


def unpack_bits(words: np.ndarray, starts: np.ndarray, step: int, n: int, table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """The n ids of a bit stream; all stretches between checkpoints are decoded side by side."""
    ids, bits = table
    out = np.zeros((step, len(starts)), np.uint32)
    at, last = starts.astype(np.int64), len(words) - 2
    for j in range(step):
        word, off = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
        window = (words[word] << off) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
        found = (window >> np.uint64(64 - longest)).astype(np.int64)
        out[j] = ids[found]
        at = at + bits[found]
    return out.T.ravel()[:n]


def write_block(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block: HEAD (magic, documents, ids, ids between checkpoints, words), then int64 document ids, uint8 whether they are set, uint32 ids of each document, uint64 first bits, and big-endian 64-bit words of codes."""
    words, at = pack_bits(ids, codes, lengths)
    head = HEAD.pack(MAGIC, len(counts), len(ids), STEP, len(words))
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    return b"".join([head, doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), at[::STEP].astype("<u8").tobytes(), words.astype(">u8").tobytes()])


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, whether they are set, ids of each document, ids)."""
    magic, docs, n, step, words = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at, parts = HEAD.size, []
    for kind, k in (("<i8", docs), ("<u1", docs), ("<u4", docs), ("<u8", -(-n // step)), (">u8", words)):
        parts.append(np.frombuffer(block, kind, k, at))
        at += k * parts[-1].itemsize
    doc_ids, known, counts, starts, stream = parts
    return doc_ids, known, counts.astype(np.int64), unpack_bits(stream.astype(np.uint64), starts, step, n, table, longest)


def _tokenized(path: str, end_id: int | None, width: type):
    """Rows (doc_id, n, ids) of documents, ids as unsigned integers of the width; at the end of a task, a row with n = -1 for the (id, count) pairs of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = encoder(path), np.zeros(0, np.int64)
        for batch in batches:
            for at, end in slices(batch.column(1)):
                ids, sizes = coder.encode(batch.column(1).slice(at, end - at))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                here = np.bincount(ids)
                counts = np.pad(counts, (0, max(0, len(here) - len(counts))))
                counts[: len(here)] += here
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sizes), binaries(ids.astype(width), sizes)], names=["doc_id", "n", "ids"])
        seen = np.flatnonzero(counts)
        pairs = np.stack([seen, counts[seen]], 1)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([pairs.tobytes()], pa.binary())], names=["doc_id", "n", "ids"])

    return run


def _encoded(codes: np.ndarray, lengths: np.ndarray, width: type):
    """Rows (part, block, ids, payload) of the sorted documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), width)
            sizes = batch.column(1).to_numpy()
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                before = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + BLOCK_IDS, "right")))
                payload = write_block(batch.column(0).slice(at, end - at), sizes[at:end], ids[before : ends[end - 1]], codes, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), pa.array([int(ends[end - 1]) - before]), pa.array([payload], pa.binary())], names=["part", "block", "ids", "payload"])
                at, block = end, block + 1

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of docs in ascending id order to the folder `out`: blocks/ (part, block, ids, payload) and code/ (id, bits).

    Parts are ranges of document ids, blocks follow each other in a part, and each block can be read alone (write_block). The code is the optimal
    one of at most 18 bits (more if the vocabulary needs it) for the counts of ids over all documents. Spark's committer writes the files, so a
    lost executor leaves no half blocks. Null text counts as empty; a null id comes first; rows that repeat an id are documents of their own,
    in any order; end_id None appends nothing. No rows give no blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    raw = f"{out}/ids"
    width = np.uint16 if max(encoder(tokenizer).full.get_vocab_size() - 1, end_id or 0) < 1 << 16 else np.uint32
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source.mapInArrow(_tokenized(tokenizer, end_id, width), "doc_id long, n long, ids binary").write.option("compression", "zstd").parquet(raw)
    rows = spark.read.parquet(raw)

    def pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for blob in part["ids"]:
                yield pd.DataFrame(np.frombuffer(blob, np.int64).reshape(-1, 2), columns=["id", "n"])

    counted = rows.where("n < 0").select("ids").mapInPandas(pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    longest = max(18, len(counted).bit_length())
    lengths = code_lengths(counts, longest)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used, "bits": lengths[used], "longest": longest}), "id long, bits long, longest long").coalesce(1).write.parquet(f"{out}/code")
    ordered = rows.where("n >= 0").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encoded(codes, lengths, width), "part long, block long, ids long, payload binary").write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    folder = spark._jvm.org.apache.hadoop.fs.Path(raw)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_token_ids(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids as little-endian uint32 bytes if with_ids) of a folder of write_token_ids, by decoding its blocks."""
    code = spark.read.parquet(f"{out}/code").toPandas()  # one row for each id of the vocabulary
    longest = int(code["longest"].max()) if len(code) else 18
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, np.int64)
    lengths[code["id"].to_numpy(np.int64)] = code["bits"].to_numpy(np.int64)
    schema = "part long, block long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, longest)
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, known, counts, ids = read_block(payload, table, longest)
                ends = np.cumsum(counts)
                plain = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(memoryview(plain)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(counts)
                columns = [pa.array(np.full(n, part)), pa.array(np.full(n, block)), pa.array(doc_ids, mask=known == 0), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [binaries(ids, counts)] * with_ids, names=["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    blocks = spark.read.parquet(f"{out}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n"))
    earlier = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("block_start")).join(earlier, "part")
    rows = blocks.select("part", "block", "payload").mapInArrow(decode, schema).join(starts, ["part", "block"])
    return rows.select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), out)
    return read_token_ids(spark, out, with_ids=False)
