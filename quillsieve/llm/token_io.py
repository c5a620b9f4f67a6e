"""Token ids of texts in compact binary files.

Texts are encoded with a given tokenizer; ids are ranked by their count over all documents, so
that frequent ids are small numbers, and each number is stored in one to four bytes. The lengths
stand apart from the bytes: a control byte has two bits for each of four numbers, and decoding is
a table lookup per control byte and a gather, in numpy.

A folder holds manifest.json, ranks.bin (ids by rank, 32-bit) and part files in ascending order of
document id. A part file is a row of blocks; a block is

    4 bytes b"QSVB", then as 64-bit little-endian numbers: documents, ids, control bytes, data bytes
    document ids (64-bit), flags (1 byte each; 1: the id is null), ids of each (64-bit), data bytes of each (64-bit)
    control bytes (each document begins with a new one), data bytes

so both writing and reading hold one block at a time. Part files are written beside their name
and moved there, so a task that is repeated leaves no half file.

Defined results: a null text counts as empty and has the end id alone; a null id comes first;
rows of one id follow each other by their ids' bytes; an empty table gives an empty folder.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..shipping import ship
from . import ragged
from .common import id_ranges, new_folder, scratch, staged

MAGIC = b"QSVB"
HEAD = "<4s4Q"
BLOCK_IDS = 1 << 20

# --- texts to ids -------------------------------------------------------------------------------

#: Bytes that surely are no white space, neither alone nor as the first of a character.
SURE = np.ones(256, bool)
SURE[[*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3]] = False
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces that a byte-level tokenizer encodes on their own, and of each text the number of its first.

    Its pattern never joins a letter to a following mark, nor anything before a single blank to
    what follows that. Only cuts that are sure from the bytes are made; fewer are as right.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        left, here, right = data[:-2], data[1:-1], data[2:]
        ended = ASCII_LETTER[left] | MARK[left]
        latin = np.zeros(n - 2, bool)  # the byte before ends a letter of two bytes, U+00C0 to U+00FF
        latin[1:] = (data[:-3] == 0xC3) & (left[1:] != 0x97) & (left[1:] != 0xB7)
        cut[1:-2] = (here == 32) & (ended | latin) & SURE[right] & (right < 0xF0)
        cut[1:-2] |= MARK[here] & (ASCII_LETTER[left] | latin)
    inner = offsets[:-1]
    cut[inner[inner < n]] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """Texts to ids by the tokenizers library; each distinct piece is encoded once while the table lasts."""

    kept: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, plain_specials: bool = False, most: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.whole = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.memo = ragged.Memo(np.uint32, most)

    @classmethod
    def of(cls, path: str, plain_specials: bool = False) -> Encoder:
        """One for each Python worker, kept from task to task."""
        if (path, plain_specials) not in cls.kept:
            cls.kept[path, plain_specials] = cls(path, plain_specials)
        return cls.kept[path, plain_specials]

    def work(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(pieces), 8192):
            done = self.tokenizer.encode_batch_fast([p.decode() for p in pieces[i : i + 8192]], add_special_tokens=False)
            out += [e.ids for e in done]
        return out

    def uncut(self, part: np.ndarray, at: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes away the cuts within texts that hold an added token, which the library looks for before all else."""
        hits = [m.start() for m in self.whole.finditer(part)] if self.whole else []
        if not hits:
            return starts, first
        held = np.zeros(len(at) - 1, bool)
        held[np.searchsorted(at, hits, "right") - 1] = True
        text = np.searchsorted(at, starts, "right") - 1
        starts = starts[~held[text] | (starts == at[text])]
        return starts, np.searchsorted(starts, at)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: first, end, all their ids joined, ids of each row."""
        data, offsets = ragged.utf8(texts)
        for i, j in ragged.chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, first = cut_points(part, at)
            starts, first = self.uncut(part, at, starts, first)
            ends = np.append(starts[1:], len(part)) if len(starts) else starts
            ids, lengths = self.memo.look_up(part, starts, ends, self.work)
            total = np.append(0, np.cumsum(lengths))
            yield i, j, ids, np.diff(total[first])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _encode(path: str, end_id: int | None, code: str, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, plain_specials)
        for batch in batches:
            for i, j, ids, counts in encoder.encode(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.append(0, np.cumsum(counts)) * np.dtype(code).itemsize), pa.py_buffer(ids.astype(code).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), raw.cast(pa.binary())], ["doc_id", "n_ids", "ids"])

    return run


# --- numbers to bytes and back ------------------------------------------------------------------

SHIFTS = np.array([0, 2, 4, 6], np.uint8)
LENGTHS = ((np.arange(256)[:, None] >> SHIFTS) & 3).astype(np.uint8) + 1  # of the four numbers of each control byte


def pack(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and data bytes of each document, for the joined numbers of documents."""
    numbers = numbers.astype("<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    controls = -(-counts // 4)
    codes = np.zeros(4 * int(controls.sum()), np.uint8)
    shift = 4 * (np.cumsum(controls) - controls) - (np.cumsum(counts) - counts)
    codes[np.arange(len(numbers)) + np.repeat(shift, counts)] = size - 1
    control = (codes.reshape(-1, 4) << SHIFTS).sum(1, dtype=np.uint8)
    run = np.append(0, np.cumsum(size, dtype=np.int64))
    ends = np.cumsum(counts)
    return control, data, run[ends] - run[ends - counts]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    controls = -(-counts // 4)
    size = LENGTHS[control].reshape(-1)
    shift = 4 * (np.cumsum(controls) - controls) - (np.cumsum(counts) - counts)
    size = size[np.arange(int(counts.sum())) + np.repeat(shift, counts)]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- files --------------------------------------------------------------------------------------


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def _count(code: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(0)), code)
            total += np.bincount(ids, minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return run


def _pack(rank: np.ndarray, code: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(2).to_numpy(zero_copy_only=False)
            ids = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(3)), code)
            control, data, sizes = pack(rank[ids], counts)
            columns = []
            for values, lengths in ((control, -(-counts // 4)), (data, sizes)):
                at = np.append(0, np.cumsum(lengths)).astype(np.int64)
                columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["range", "doc_id", "n_ids", "control", "data"])

    return run


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = _open(folder)
        done: list[tuple[int, int, int]] = []
        out = now = None
        block: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal block, held
            if block:
                ids = np.array([0 if b[0] is None else b[0] for b in block], "<i8")
                controls, datas = b"".join(b[2] for b in block), b"".join(b[3] for b in block)
                out.write(struct.pack(HEAD, MAGIC, len(block), held, len(controls), len(datas)))
                out.write(ids.tobytes() + bytes(b[0] is None for b in block) + np.array([b[1] for b in block], "<i8").tobytes() + np.array([len(b[3]) for b in block], "<i8").tobytes())
                out.write(controls)
                out.write(datas)
            block, held = [], 0

        def close() -> None:
            flush()
            out.close()
            whole = f"{root}/part-{now:08d}.bin"
            if system.get_file_info(whole).is_file:  # of an earlier attempt; some file systems don't replace
                system.delete_file(whole)
            system.move(name, whole)
            done.append((now, docs, total))

        for batch in batches:
            for part, doc, n, control, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    if out:
                        close()
                    now, docs, total = part, 0, 0
                    name = f"{root}/_{part:08d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                block.append((doc, n, control, data))
                held, docs, total = held + n, docs + 1, total + n
                if held >= BLOCK_IDS:
                    flush()
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], ["range", "docs", "ids"])

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, folder: str | None = None, plain_specials: bool = False) -> str:
    """Writes the ids of every text to a folder (a new shared one by default) and returns that.

    The strings of special tokens in a text become those tokens, as the library has it, or with
    plain_specials ordinary text. Ids have to be whole numbers.
    """
    from tokenizers import Tokenizer

    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col}: document ids of token files have to be whole numbers")
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), (end_id or 0) + 1)
    code = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch():
        return _written(spark, rows, path, folder, end_id, code, plain_specials, vocabulary)


def _written(spark, rows: DataFrame, path: str, folder: str, end_id: int | None, code: str, plain_specials: bool, vocabulary: int) -> str:
    encoded = staged(rows.mapInArrow(_encode(path, end_id, code, plain_specials), "doc_id long, n_ids long, ids binary"), "ids")
    counted = encoded.select("ids").mapInArrow(_count(code, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    count = np.zeros(vocabulary, np.int64)
    for r in counted:
        count[r.id] = r.n
    order = np.argsort(-count, kind="stable")
    rank = np.empty(vocabulary, np.uint32)
    rank[order] = np.arange(vocabulary, dtype=np.uint32)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, ranges = id_ranges(encoded, "doc_id", 2 * tasks)
    packed = encoded.select(place.alias("range"), "doc_id", "n_ids", "ids").mapInArrow(_pack(rank, code), "range int, doc_id long, n_ids long, control binary, data binary")
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    ordered = packed.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "n_ids", "control", "data")
    parts = sorted(ordered.mapInArrow(_write(folder), "range long, docs long, ids long").collect())  # one row a file
    with system.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(order.astype("<u4").tobytes())
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"version": 1, "parts": [{"name": f"part-{r['range']:08d}.bin", "documents": r.docs, "ids": r.ids} for r in parts]}).encode())
    return folder


def blocks(folder: str, name: str, by_rank: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of each block of a part file: document ids, ids of each document, all ids joined."""
    system, root = _open(folder)
    with system.open_input_stream(f"{root}/{name}") as file:
        while head := file.read(struct.calcsize(HEAD)):
            magic, docs, n, controls, size = struct.unpack(HEAD, head)
            if magic != MAGIC:
                raise ValueError(f"{name}: not a block of token ids")
            ids, null = np.frombuffer(file.read(8 * docs), "<i8"), file.read(docs)
            counts = np.frombuffer(file.read(8 * docs), "<i8")
            file.read(8 * docs)
            control = np.frombuffer(file.read(controls), np.uint8)
            numbers = unpack(control, np.frombuffer(file.read(size), np.uint8), counts)
            if len(numbers) != n:
                raise ValueError(f"{name}: a block of {n} ids has {len(numbers)}")
            yield [None if z else int(i) for i, z in zip(ids, null, strict=True)], counts, by_rank[numbers]


def _read(folder: str, row: Callable[[np.ndarray], tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        with system.open_input_stream(f"{root}/ranks.bin") as file:
            by_rank = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, counts, ids in blocks(folder, name, by_rank):
                    ends = np.cumsum(counts)
                    at = ends - counts
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array(docs, pa.int64()), pa.array(at + start), pa.array(counts), pa.array(sums, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if row:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    start += int(ends[-1]) if len(ends) else 0
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and on request the ids."""
    ship(spark)
    system, root = _open(folder)
    with system.open_input_stream(f"{root}/manifest.json") as file:
        parts = json.loads(file.read())["parts"]
    starts = np.append(0, np.cumsum([p["ids"] for p in parts])).tolist()
    files = spark.createDataFrame([(p["name"], s) for p, s in zip(parts, starts, strict=False)], "name string, start long").repartition(max(1, len(parts)))
    return files.mapInArrow(_read(folder, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
