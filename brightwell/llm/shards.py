"""Token-id output in training order (operator 10).

Every text is encoded once, with a public byte-level vocabulary, and closed by an end token.  The
rows of one input partition (a *block*) make one stream, which is cut into sequences of ``LENGTH``
tokens; only a block's last sequence is filled up.  The sequences are kept in the shared folder as
they are made, so their number ``n`` is known from counting rows, not from encoding again.

A keyed Feistel permutation of ``range(n)`` with cycle walking gives every sequence its slot, so the
training order is random, reproducible and invertible without a table.  Runs of ``SHARD`` slots are
files of fixed-stride records: slot ``s`` is record ``s % SHARD`` of file ``s // SHARD``, so a reader
starts or resumes anywhere by a seek.

Records are shuffled once, by contiguous ranges of shards: a task deals what it holds to shards and
sends each shard's records as one compressed row.  A task writes its shards one after the other
under another name and renames them, so a repeated task does no harm.  It holds one shard at a time
(``SHARD`` records, 4 MB).

A block's first sequence number comes from the blocks' counts: one row for each input partition,
summed in groups of ``GROUP``; the driver gets one number for each group.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, token_counts

LENGTH = 512
SHARD = 4096
KEY = 20240229
#: Records of one Arrow batch, and those that a task deals to shards at a time.
BATCH_RECORDS, DEALT = 4096, 32_768
#: Shards of one write task, and the most write tasks.
PART_SHARDS, MAX_PARTS = 4, 100_000
GROUP = 1024
#: Blocks (one row of three numbers for each input partition) up to this many are broadcast; more are joined by a shuffle.
BLOCK_ROWS = 2_000_000
RECORD = "block bigint, local bigint, n_tokens int, first_doc_id bigint, last_doc_id bigint, ids binary"
RESULT = "slot bigint, sequence bigint, shard bigint, byte_offset bigint, n_tokens bigint, record_sha256 string, first_doc_id bigint, last_doc_id bigint"


def feistel(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False, rounds: int = 6) -> np.ndarray:
    """The place of each index in a keyed permutation of ``range(n)``, or back.

    Balanced Feistel rounds permute the next power of four; values outside ``range(n)`` walk on
    until they fall inside, which keeps it a permutation.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(0, 2**63, rounds, np.uint64)

    def mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & mask

    out = np.asarray(index).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ mixed(left, k), left
            else:
                left, right = right, left ^ mixed(right, k)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def end_token(path: str) -> int:
    """The first id after the vocabulary's; a record's numbers have 16 bits."""
    end = len(token_counts.spans(path).size)
    if end > 0xFFFF:
        raise ValueError(f"ids up to {end} do not fit 16 bits")
    return end


def sequences(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``RECORD`` rows: the sequences of each block, in order."""

    def run(batches: Iterator[dict]) -> Iterator[list]:
        encode = token_counts.spans(path).encoding.encode_ordinary
        block, local = TaskContext.get().partitionId(), 0
        left, docs_left, ends_left = np.empty(0, "<u2"), [], np.empty(0, np.int64)

        def cut(last: bool) -> Iterator[list]:
            nonlocal local, left, docs_left, ends_left
            k = len(left) // LENGTH
            if last and len(left) % LENGTH:
                k += 1
            sizes = np.full(k, LENGTH)
            if last and k:
                sizes[-1] = len(left) - (k - 1) * LENGTH
                left = np.concatenate([left, np.full(k * LENGTH - len(left), end, "<u2")])
            at = np.arange(k) * LENGTH
            first = np.searchsorted(ends_left, at, "right").tolist()
            final = np.searchsorted(ends_left, at + sizes - 1, "right").tolist()
            for i in range(0, k, BATCH_RECORDS):
                j = min(k, i + BATCH_RECORDS)
                raw = pa.py_buffer(left[i * LENGTH : j * LENGTH].tobytes())
                places = pa.py_buffer((np.arange(j - i + 1) * (2 * LENGTH)).astype(np.int32).tobytes())
                ids = pa.Array.from_buffers(pa.binary(), j - i, [None, places, raw])
                yield [[block] * (j - i), range(local + i, local + j), sizes[i:j].tolist(), [docs_left[x] for x in first[i:j]], [docs_left[x] for x in final[i:j]], ids]
            local += k
            gone = int(np.searchsorted(ends_left, k * LENGTH, "right"))
            left, docs_left, ends_left = left[k * LENGTH :], docs_left[gone:], ends_left[gone:] - k * LENGTH

        for b in batches:
            new = [np.array([*encode(t or ""), end], "<u2") for t in b["text"]]
            ends_left = np.concatenate([ends_left, len(left) + np.cumsum([len(x) for x in new])])
            left, docs_left = np.concatenate([left, *new]), [*docs_left, *b["doc_id"]]
            yield from cut(False)
        yield from cut(True)

    return common.map_rows(docs.select("doc_id", "text"), run, RECORD)


def bases(records: DataFrame) -> tuple[DataFrame, int, int]:
    """``block, base`` (a block's first sequence number), the number of blocks, and that of sequences."""
    counts = records.groupBy("block").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("block") / GROUP))
    counts = common.written(counts, "counts")
    groups = sorted((r.part, r.n, r.blocks) for r in counts.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect())
    starts = accumulate([n for _, n, _ in groups], initial=0)
    table = counts.sparkSession.createDataFrame([(p, s) for (p, _, _), s in zip(groups, starts, strict=False)], "part bigint, start bigint")
    before = F.sum("n").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    out = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(table), "part")
    return out.select("block", (F.col("start") + F.col("before")).alias("base")), sum(b for _, _, b in groups), sum(n for _, n, _ in groups)


def dealt(records: DataFrame, n: int, per_part: int, key: int) -> DataFrame:
    """One row for each shard of which a task holds records: their slots and numbers, and the records themselves, compressed."""

    def run(batches: Iterator[dict]) -> Iterator[list]:
        import zstandard

        held: list[tuple] = []

        def rows() -> list:
            slots = feistel(np.array([r[0] for r in held], np.int64), n, key)
            order = np.argsort(slots, kind="stable")
            shards = slots[order] // SHARD
            edges = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))).tolist()
            out: list[list] = [[] for _ in range(8)]
            for i, j in zip(edges, [*edges[1:], len(order)], strict=True):
                mine = [held[k] for k in order[i:j].tolist()]
                packed = zstandard.ZstdCompressor(level=3).compress(b"".join(r[4] for r in mine))
                shard = int(shards[i])
                for c, v in zip(out, (shard // per_part, shard, slots[order[i:j]].tolist(), *([r[c] for r in mine] for c in range(4)), packed), strict=True):
                    c.append(v)
            held.clear()
            return out

        for b in batches:
            held.extend(zip([x + y for x, y in zip(b["base"], b["local"], strict=True)], b["n_tokens"], b["first_doc_id"], b["last_doc_id"], b["ids"], strict=True))
            if len(held) >= DEALT:
                yield rows()
        if held:
            yield rows()

    kinds = "part int, shard bigint, slots array<bigint>, sequences array<bigint>, sizes array<int>, firsts array<bigint>, lasts array<bigint>, packed binary"
    return common.map_rows(records.select("base", "local", "n_tokens", "first_doc_id", "last_doc_id", "ids"), run, kinds)


def write_shards(docs: DataFrame, out_dir: str, path: str | None = None, key: int = KEY) -> DataFrame:
    """Write the shards to ``out_dir`` (a URI all machines reach); one row for each sequence.

    ``slot, sequence, shard, byte_offset, n_tokens, record_sha256, first_doc_id, last_doc_id``.  The
    files are written when the result is evaluated.  Rows are taken in the order of the table's
    partitions; null and empty texts give only an end token; repeated rows repeat; a null doc_id is
    passed on; an empty table writes nothing; further columns are ignored.  Ids beyond 16 bits are refused.
    """
    path = path or vocabulary()
    end = end_token(path)
    records = common.written(sequences(docs, path, end), "sequences", {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false"})
    table, blocks, n = bases(records)
    n_shards = max(1, -(-n // SHARD))
    per_part = max(PART_SHARDS, -(-n_shards // MAX_PARTS))
    rows = records.join(F.broadcast(table) if blocks <= BLOCK_ROWS else table, "block")
    parts = dealt(rows, n, per_part, key).repartitionById(-(-n_shards // per_part), "part").sortWithinPartitions("shard")

    def write(batches: Iterator[dict]) -> Iterator[list]:
        import zstandard
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(out_dir)
        store.create_dir(folder)
        size = 2 * LENGTH
        shard, full, rows = None, bytearray(), []

        def close() -> list:
            rows.sort()
            name = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                out.write(full[: len(rows) * size])
            store.move(name, f"{folder}/shard-{shard:08d}.bin")
            return [list(c) for c in zip(*rows, strict=True)]

        for b in batches:
            for s, slots, *numbers, packed in zip(*(b[c] for c in ("shard", "slots", "sequences", "sizes", "firsts", "lasts", "packed")), strict=True):
                if s != shard:
                    if rows:
                        yield close()
                    shard, full, rows = s, bytearray(SHARD * size), []
                raw = zstandard.ZstdDecompressor().decompress(packed)
                for i, (slot, sequence, tokens, first, last) in enumerate(zip(slots, *numbers, strict=True)):
                    place, record = slot % SHARD * size, raw[i * size : (i + 1) * size]
                    full[place : place + size] = record
                    rows.append((slot, sequence, s, place, tokens, hashlib.sha256(record).hexdigest(), first, last))
        if rows:
            yield close()

    return common.map_rows(parts.drop("part"), write, RESULT)


def read_slots(out_dir: str, slot: int, n: int) -> Iterator[np.ndarray]:
    """Token ids of ``n`` slots from ``slot`` on: a seek in one file, then sequential reads."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(out_dir)
    while n > 0:
        take = min(n, SHARD - slot % SHARD)
        with store.open_input_file(f"{folder}/shard-{slot // SHARD:08d}.bin") as f:
            f.seek(slot % SHARD * LENGTH * 2)
            for _ in range(take):
                yield np.frombuffer(f.read(LENGTH * 2), "<u2")
        slot, n = slot + take, n - take


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(common.documents(spark, sf_dir), f"{common.scratch_dir(spark)}-shards")
