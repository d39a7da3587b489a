"""Training-order materialisation of token ids in fixed-stride binary shards.

Each input partition packs its documents' ids, an end id after each, into sequences of equal
length; the last one is filled up with end ids.  Sequences are numbered through, partition after
partition.  A keyed Feistel network over the smallest even-bit domain that holds n numbers,
walked until it lands below n, is a permutation of 0..n-1: it gives each sequence its slot in
training order.  Range partitions over the slots write shards in which every record has the
same number of bytes, so record s is at byte (s % records) * stride of shard s // records, and a
reader that stopped after slot s goes on at s + 1.

Ids are little-endian, two bytes if the vocabulary has no more than 65,536 ids, else four.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.piece_bpe import MergeVocabulary
from pulsegrid.llm.shared import materialize, small_batches
from pulsegrid.llm.textkernel import mix, sliced

U = np.uint64
ROUNDS = 6


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of `index` (numbers below n) in the permutation of 0..n-1 that the key picks."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = U((1 << half) - 1), mix(np.arange(1, ROUNDS + 1, dtype=U) + U(key & (2**63 - 1)))

    def network(x):
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << U(half)) | right

    x = network(index.astype(U))
    while (out := x >= U(n)).any():  # cycle-walking
        x[out] = network(x[out])
    return x.astype(np.int64)


def unslot(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """Inverse of slots()."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = U((1 << half) - 1), mix(np.arange(1, ROUNDS + 1, dtype=U) + U(key & (2**63 - 1)))

    def network(x):
        left, right = x >> U(half), x & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        return (left << U(half)) | right

    x = network(slot.astype(U))
    while (out := x >= U(n)).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def _packed(model, length: int, dtype: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        v = None
        part, seq = TaskContext.get().partitionId(), 0
        held, held_docs = np.zeros(0, dtype), []  # ids not yet written, and (document, first id) of those in them

        def rows(ids, docs, count):
            nonlocal seq
            start = np.array([p for _, p in docs], np.int64)
            lists = []
            for i in range(count):
                a = max(0, int(np.searchsorted(start, i * length, "right")) - 1)
                z = int(np.searchsorted(start, (i + 1) * length, "left"))
                lists.append([d for d, _ in docs[a:z]])
            raw = [ids[i * length : (i + 1) * length].tobytes() for i in range(count)]
            out = pa.RecordBatch.from_arrays([pa.array([part] * count, pa.int32()), pa.array(range(seq, seq + count), pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(raw, pa.binary())], names=["part", "seq", "doc_ids", "payload"])
            seq += count
            return out

        for b in sliced(batches, 1):
            v = v or MergeVocabulary(model.value)
            flat = [held]
            at = len(held)
            for d, ids in zip(b.column(0).to_pylist(), v.encode([t or "" for t in b.column(1).to_pylist()], checked=False), strict=True):
                held_docs.append((d, at))
                flat += [ids.astype(dtype), np.array([v.eos], dtype)]
                at += len(ids) + 1
            ids = np.concatenate(flat)
            count = len(ids) // length
            if count:
                yield rows(ids, held_docs, count)
            held = ids[count * length :]
            inside = [i for i, (_, p) in enumerate(held_docs) if p > count * length]
            first = inside[0] if inside else len(held_docs)
            keep = held_docs[max(0, first - 1) :] if len(held) else []
            held_docs = [(d, max(0, p - count * length)) for d, p in keep]
        if len(held):
            yield rows(np.r_[held, np.full(length - len(held), v.eos, dtype)].astype(dtype), held_docs, 1)

    return run


def _placed(offsets, n: int, key: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                index = offsets[b.column(0).to_numpy()] + b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(slots(index, n, key)), b.column(2), b.column(3)], names=["sequence", "slot", "doc_ids", "payload"])

    return run


def _blocks(records: int, block: int):
    """Rows sorted by slot, as blocks of at most `block` records that don't cross a shard."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[int, list, bytes]] = []

        def out():
            raw = b"".join(p for _, _, p in held)
            docs = [list(dict.fromkeys(d)) for _, d, _ in held]
            first = held[0][0]
            row = pa.RecordBatch.from_arrays(
                [pa.array([first // records]), pa.array([first]), pa.array([len(held)], pa.int64()), pa.array([len(held[0][2])], pa.int64()), pa.array([(first % records) * len(held[0][2])], pa.int64()), pa.array([docs], pa.list_(pa.list_(pa.int64()))), pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([raw], pa.binary())],
                names=["shard", "first_slot", "n_records", "stride", "offset", "doc_ids", "sha256", "payload"],
            )
            held.clear()
            return row

        for b in batches:
            for s, d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (s // block != held[0][0] // block or s // records != held[0][0] // records):
                    yield out()
                held.append((s, d, p))
        if held:
            yield out()

    return run


def training_shards(docs: DataFrame, model_path: str, length: int = 1024, key: int = 20240229, records: int = 8192, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of records: (shard, first_slot, n_records, stride, offset, doc_ids, sha256, payload).

    payload holds the block's records one after another; doc_ids lists, for each record, the
    documents whose ids it holds.  Blocks of a shard in the order of first_slot are the shard.
    Null and empty texts are an end id alone; null ids are null in the lists; repeated rows are
    packed each; other columns are ignored.  The numbering follows the input's partitions, so
    the same files read with the same split sizes give the same slots.  An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = f.read()
    dtype = "<u2" if MergeVocabulary(proto).library.get_piece_size() <= 1 << 16 else "<u4"
    model = spark.sparkContext.broadcast(proto)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    packed = materialize(base.mapInArrow(_packed(model, length, dtype), "part int, seq long, doc_ids array<long>, payload binary"), "sequences", compression="zstd")
    counts = {r.part: r["count"] for r in packed.groupBy("part").count().collect()}  # one row per input partition
    size = np.zeros(max(counts, default=-1) + 2, np.int64)
    for p, c in counts.items():
        size[p + 1] = c
    offsets, n = np.cumsum(size), int(size.sum())
    placed = packed.mapInArrow(_placed(offsets, max(n, 1), key), "sequence long, slot long, doc_ids array<long>, payload binary")
    shards = max(1, -(-n // records))
    # a range partition is a fourth of a shard on small inputs, and never more than eight shards
    ranges = max(min(4 * shards, 2048), -(-shards // 8))
    ranged = placed.withColumn("block", (F.col("slot") / block).cast("long")).repartitionByRange(ranges, "block").sortWithinPartitions("slot")
    schema = "shard long, first_slot long, n_records long, stride long, offset long, doc_ids array<array<long>>, sha256 string, payload binary"
    return ranged.select("slot", "doc_ids", "payload").mapInArrow(_blocks(records, block), schema)


MANIFEST = "manifest.json"


def write_shards(blocks: DataFrame, uri: str) -> DataFrame:
    """Writes the blocks of training_shards as files <uri>/shard-<number>.bin, one task a shard; returns (shard, n_records, bytes).

    uri names a folder that all executors see, in any store pyarrow opens.  A shard is written
    under a temporary name and renamed, so a repeated task leaves one whole file.
    finish_shards() adds the manifest.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        shard, out, n, size, temp = None, None, 0, 0, ""

        def close():
            out.close()
            store.move(temp, f"{root}/shard-{shard:08d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["shard", "n_records", "bytes"])

        for b in batches:
            for s, records, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    if out is not None:
                        yield close()
                    import uuid

                    shard, n, size = s, 0, 0
                    temp = f"{root}/.shard-{s:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                out.write(payload)
                n, size = n + records, size + len(payload)
        if out is not None:
            yield close()

    ordered = blocks.select("shard", "n_records", "payload", "first_slot").repartition("shard").sortWithinPartitions("shard", "first_slot")
    return ordered.select("shard", "n_records", "payload").mapInArrow(run, "shard long, n_records long, bytes long")


def finish_shards(written: DataFrame, uri: str, key: int, length: int, dtype: str, records: int) -> dict:
    """Writes the manifest of the shards that write_shards() returned, last of all: a folder that has one is whole.

    It holds the number of records and what a reader must know to find each, or to go on after one.
    """
    import json

    from pyarrow import fs

    n, shards, size = written.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    about = {"n_records": n, "n_shards": shards, "bytes": size, "key": key, "length": length, "dtype": dtype, "records": records, "stride": length * np.dtype(dtype).itemsize}
    if size != n * about["stride"] or shards != -(-n // records):
        raise RuntimeError(f"shards are missing or cut short: {about}")
    store, root = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps(about, sort_keys=True).encode())
    return about


def resume(uri: str, start: int, count: int) -> np.ndarray:
    """Records start..start+count-1 of a finished folder, by its manifest; fewer at the end."""
    import json

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        about = json.loads(f.read())
    return read_records(uri, start, min(count, max(0, about["n_records"] - start)), about["length"], about["records"], about["dtype"])


def read_records(uri: str, start: int, count: int, length: int, records: int, dtype: str = "<u2") -> np.ndarray:
    """Records start..start+count-1 of the shards under uri, as a matrix; fewer at the end."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    stride = length * np.dtype(dtype).itemsize
    rows = []
    while count > 0:
        info = store.get_file_info(f"{root}/shard-{start // records:08d}.bin")
        if info.type == fs.FileType.NotFound:
            break
        with store.open_input_file(info.path) as f:
            take = min(count, records - start % records)
            f.seek((start % records) * stride)
            got = np.frombuffer(f.read(take * stride), dtype).reshape(-1, length)
        rows.append(got)
        if len(got) < take:
            break
        start, count = start + take, count - take
    return np.concatenate(rows) if rows else np.zeros((0, length), dtype)
