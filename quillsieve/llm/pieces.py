"""SentencePiece models: texts to piece ids and back, by Viterbi in numpy.

Texts are cut where no piece of the model can reach across (no piece holds both neighbours), and
each distinct part is segmented once while a bounded table lasts. Parts of equal length advance
together: hashes of all their substrings probe the sorted keys of the pieces, and for each end
position the maximum over the pieces that end there is stored with its length, to be followed
back from the end.

What is maximised depends on the model. A unigram model adds the scores of its pieces. A BPE model
has no such sum: its scores order merges, and adding them gives other pieces than merging does.
But merging is local: pieces a, b stand side by side just when merging the text of a and b alone
gives a, b again. So in a BPE model a piece may end at a position only if it fits behind the piece
that ends where it starts, of which there is exactly one, and the same table of maxima and
lengths finds it. Characters that are no piece part a word in two. A row of blanks, whose pieces
share one score below all others, joins from the left after all else (`blanks`): in one pass.

A word of more than `LONG` characters has no others to advance with. Its substrings are probed all
at once for each length; then a unigram model takes the maxima end by end, and a BPE model merges
with a heap, which gives the same pieces in n log n steps.

Ids are those of the sentencepiece library for both kinds of model. Supported: models without a
character map, with blanks as U+2581. Decoding gives the text back, but that U+2581 in a text
becomes a blank, as in the library.

Defined results: a null text counts as empty and has no ids; characters that are no piece become
their bytes' pieces, or the unknown id if the model has none; repeated rows are encoded each on
their own; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import ragged
from .common import fresh

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLANK = "▁"
CELLS = 1 << 18  # words times length that are worked on at once
LONG = 512  # characters above which a word is worked on alone
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _sized(length: int) -> np.uint64:
    """What a length adds to a hash."""
    return np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    kept: dict[str, Model] = {}

    def __init__(self, data: bytes, most: int = 1 << 19) -> None:
        self.text: list[str] = []
        scores, self.kind = [], []
        self.model_type, prefix, squeeze, charmap = UNIGRAM, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kind.append(piece.get(3, NORMAL))
            elif field == 2:
                self.model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                prefix, squeeze, charmap = spec.get(3, 1), spec.get(4, 1), spec.get(2, b"")
        if charmap or squeeze or self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that leave characters and blanks as they are")
        self.prefix = bool(prefix)
        self.score = np.array(scores, np.float32)
        self.normal = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (NORMAL, USER)}
        self.unknown = self.kind.index(UNKNOWN)
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.longest = max(map(len, self.normal))
        self.worst = float(min(self.score[i] for i in self.normal.values())) - 10.0
        # Neighbouring bytes inside a piece: elsewhere a text can be cut.
        self.joins = np.zeros((256, 256), bool)
        for t in self.normal:
            parts = [c.replace(BLANK, " ").encode() for c in t]
            for a, b in zip(parts, parts[1:], strict=False):
                self.joins[a[-1], b[0]] = True
        keys = self._hashes([np.array([list(map(ord, t))], np.uint32) for t in self.normal])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.normal.values()), np.int32)[order]
        self.memo = ragged.Memo(np.uint16 if len(self.text) <= 1 << 16 else np.uint32, most)
        if self.model_type == BPE:
            self._prepare_merges()
        table = [bytes([int(t[3:5], 16)]) if k == BYTE else (b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else t.replace(BLANK, " ").encode()) for t, k in zip(self.text, self.kind, strict=True)]
        self.out_length = np.array([len(t) for t in table], np.int64)
        self.out_start = np.cumsum(self.out_length) - self.out_length
        self.out_bytes = np.frombuffer(b"".join(table), np.uint8)

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in cls.kept:
            with open(path, "rb") as file:
                cls.kept[path] = cls(file.read())
        return cls.kept[path]

    # --- tables ---------------------------------------------------------------------------------

    @staticmethod
    def _hashes(rows: list[np.ndarray]) -> np.ndarray:
        out = []
        for row in rows:
            run = np.zeros(len(row), np.uint64)
            for k in range(row.shape[1]):
                run = run * _BASE + row[:, k].astype(np.uint64) + np.uint64(1)
            out.append(ragged.mixed(run + _sized(row.shape[1])))
        return np.concatenate(out)

    def merged(self, symbols: list[str]) -> list[tuple[str, tuple[str, str] | None]]:
        """Merging of a piece's characters: the best-scored neighbours join, the leftmost of equals first."""
        parts = [(s, None) for s in symbols]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.normal.get(parts[i][0] + parts[i + 1][0])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                return parts
            a, b = parts[at][0], parts[at + 1][0]
            parts[at : at + 2] = [(a + b, (a, b))]

    def _prepare_merges(self) -> None:
        long = sorted((t for t in self.normal if len(t) > 1), key=lambda t: -self.score[self.normal[t]])
        n = len(self.text)
        self.rank = np.zeros(n, np.int64)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.reached = np.zeros(n, bool)
        pairs, ranks = [], []
        self.joined: dict[int, tuple[int, int]] = {}  # of two pieces, as one number: how early they join, and to what
        for i in self.normal.values():
            self.reached[i] = len(self.text[i]) == 1
        before, level = None, 0
        self.ties = False  # pieces of equal score: their order depends on the place
        scores = {blank: [self.score[self.normal[t]] for t in long if (not t.strip(BLANK)) == blank] for blank in (True, False)}
        blanks_low = not all(scores.values()) or max(scores[True]) < min(scores[False])
        for r, t in enumerate(long, 1):
            i = self.normal[t]
            score, blank = self.score[i], not t.strip(BLANK)
            level += score != before
            self.ties |= score == before and not blank or not blank and BLANK in t[1:] or blank and not blanks_low
            before = score
            self.rank[i] = r
            parts = self.merged(list(t))
            if len(parts) == 1 and all(p in self.normal for p in parts[0][1]):
                self.left[i], self.right[i] = (self.normal[p] for p in parts[0][1])
                self.reached[i] = not blank
            for k in range(1, len(t)):
                a, b = self.normal.get(t[:k]), self.normal.get(t[k:])
                if a is not None and b is not None:
                    self.joined[a * n + b] = level, i
                    if not blank:
                        pairs.append(a * n + b)
                        ranks.append(r)
            self.ties |= any(c not in self.normal for c in t)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = np.array(pairs, np.int64)[order], np.array(ranks, np.int64)[order]

    def merge_all(self, word: str) -> list[int]:
        """Ids of a word of known characters by merging with a heap: the best-scored neighbours first, the leftmost of equals."""
        n, size = len(self.text), len(word)
        ids = [self.normal[c] for c in word]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        joined = self.joined
        heap = [found[0] << 40 | i for i in range(size - 1) if (found := joined.get(ids[i] * n + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            level, i = divmod(heapq.heappop(heap), 1 << 40)
            j = after[i]
            if ids[i] < 0 or j >= size:
                continue
            found = joined.get(ids[i] * n + ids[j])
            if not found or found[0] != level:
                continue  # one of the two has joined another since
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if found := joined.get(ids[i] * n + ids[k]):
                    heapq.heappush(heap, found[0] << 40 | i)
            if (h := before[i]) >= 0 and (found := joined.get(ids[h] * n + ids[i])):
                heapq.heappush(heap, found[0] << 40 | h)
        return [i for i in ids if i >= 0]

    def blanks(self, count: int) -> list[int]:
        """Ids of so many blanks in a row: joined from the left, as their pieces score alike."""
        n, one, out = len(self.text), self.normal[BLANK], []
        for _ in range(count):
            out.append(one)
            while len(out) > 1 and (found := self.joined.get(out[-2] * n + out[-1])):
                out[-2:] = [found[1]]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b alone leaves them as they are.

        Merges are undone from the latest on; if at some point the pieces that touch at the border
        could have joined before those merges were made, they would have.
        """
        out = np.ones(len(a), bool)
        active, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        n = len(self.text)
        while len(active):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            out[active[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joins & ((rx > 0) | (ry > 0))
            active, x, y, rx, ry = active[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    # --- segmentation ---------------------------------------------------------------------------

    def segment(self, codes: np.ndarray) -> list[list[int]]:
        """Ids of words of one length (rows of code points); -1 stands for a character that is no piece."""
        n, size = codes.shape
        bpe = self.model_type == BPE
        power = np.ones(self.longest + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(self.longest, _BASE))
        prefix = np.zeros((n, size + 1), np.uint64)
        for k in range(size):
            prefix[:, k + 1] = prefix[:, k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        last, back = np.full((n, size + 1), -1, np.int32), np.zeros((n, size + 1), np.int16)
        for end in range(1, size + 1):
            for length in range(min(end, self.longest), 0, -1):  # of equal sums the longest last piece stays
                start = end - length
                h = ragged.mixed(prefix[:, end] - prefix[:, start] * power[length] + _sized(length))
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                piece = np.where(self.keys[at] == h, self.ids[at], -1)
                rows = np.flatnonzero(((piece >= 0) | (length == 1)) & (best[:, start] > -np.inf))
                if not len(rows):
                    continue
                found = piece[rows]
                if bpe:
                    ok = (found >= 0) & self.reached[found]
                    rows, found = rows[ok], found[ok]
                    if start:
                        ok = self.fits(last[rows, start], found)
                        rows, found = rows[ok], found[ok]
                    total = np.zeros(len(rows), np.float32)
                else:
                    total = best[rows, start] + np.where(found >= 0, self.score[found], np.float32(self.worst))
                better = total > best[rows, end]
                rows, found = rows[better], found[better]
                best[rows, end], last[rows, end], back[rows, end] = total[better], found, length
        out: list[list[int]] = [[] for _ in range(n)]
        at = np.full(n, size)
        while (rows := np.flatnonzero(at)).size:
            for r, piece in zip(rows.tolist(), last[rows, at[rows]].tolist(), strict=True):
                out[r].append(piece)
            at[rows] -= back[rows, at[rows]]
        return [ids[::-1] for ids in out]

    def alone(self, word: str) -> list[int]:
        """Ids of one long word; as segment() gives them."""
        if self.model_type == BPE:
            return self.merge_all(word)
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        size = len(codes)
        found: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # by their ends: length and id, the longest first
        run = np.zeros(size, np.uint64)
        for length in range(1, min(size, self.longest) + 1):  # the hash of each substring from that of the one a character shorter
            run = run[: size - length + 1] * _BASE + codes[length - 1 :]
            h = ragged.mixed(run + _sized(length))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            for start in np.flatnonzero((self.keys[at] == h) | (length == 1)).tolist():
                found[start + length - 1].append((length, int(self.ids[at[start]]) if self.keys[at[start]] == h[start] else -1))
        best, last, back = [np.float32(0)] + [np.float32(-np.inf)] * size, [-1] * (size + 1), [0] * (size + 1)
        worst = np.float32(self.worst)
        for end in range(1, size + 1):
            for length, piece in reversed(found[end - 1]):
                total = best[end - length] + (self.score[piece] if piece >= 0 else worst)
                if total > best[end]:
                    best[end], last[end], back[end] = total, piece, length
            found[end - 1] = []
        out, at = [], size
        while at:
            out.append(last[at])
            at -= back[at]
        return out[::-1]

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def _units(self, word: str) -> Iterator[tuple[int, str]]:
        """A part of a text as units: blanks in a row (their number), and words of known characters."""
        at, size = 0, len(word)
        while at < size:
            end = at
            while end < size and word[end] in self.normal:
                end += 1
            if end > at:
                lead = end - at - len(word[at:end].lstrip(BLANK))
                if not self.ties and lead > 1:
                    rest = word[at + lead - 1 : end]  # the last blank may join what follows it
                    yield (lead, "") if len(rest) == 1 else (lead - 1, rest)
                else:
                    yield 0, word[at:end]
                at = end
            else:
                yield -1, word[at]
                at += 1

    def work(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of parts of texts, each on its own."""
        bpe = self.model_type == BPE
        units: list[list[tuple[int, str]]] = []
        done: dict[str, list[int]] = {}
        by_length: dict[int, list[str]] = {}
        for part in parts:
            word = part.decode().replace(" ", BLANK)
            units.append(list(self._units(word)) if bpe else [(0, word)] if word else [])
            for count, text in units[-1]:
                if count >= 0 and text and text not in done:
                    if bpe and self.ties:
                        done[text] = self.merge_all(text)
                    elif len(text) > LONG:
                        done[text] = self.alone(text)
                    else:
                        done[text] = []
                        by_length.setdefault(len(text), []).append(text)
        for size, words in by_length.items():
            step = max(1, CELLS // size)
            for k in range(0, len(words), step):
                some = words[k : k + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(-1, size)
                done.update(zip(some, self.segment(codes), strict=True))
        out = []
        for unit in units:
            ids: list[int] = []
            for count, text in unit:
                if count < 0:
                    ids += self.bytes_of(text)
                    continue
                found = done[text] if text else []
                if count:
                    alone = bool(found) and self.text[found[0]] == BLANK  # the last blank has joined no letter
                    ids += self.blanks(count + alone)
                    found = found[1:] if alone else found
                if -1 in found:
                    at = 0
                    for p in found:
                        ids += self.bytes_of(text[at]) if p < 0 else [p]
                        at += 1 if p < 0 else len(self.text[p])
                else:
                    ids += found
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: first, end, all their ids joined, ids of each row."""
        texts = texts.cast(pa.large_string()).fill_null("")
        texts = pc.replace_substring(texts, BLANK, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        data, offsets = ragged.utf8(texts)
        for i, j in ragged.chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            cut = np.zeros(len(part) + 1, bool)
            if len(part) > 1:
                cut[1:-1] = ~self.joins[part[:-1], part[1:]] & ((part[1:] & 0xC0) != 0x80)
            cut[at[:-1]] = True
            starts = np.flatnonzero(cut[: len(part)])
            ends = np.append(starts[1:], len(part)) if len(starts) else starts
            ids, lengths = self.memo.look_up(part, starts, ends, self.work)
            total = np.append(0, np.cumsum(lengths))
            yield i, j, ids, np.diff(total[np.searchsorted(starts, at)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, joined, and their offsets."""
        lengths = self.out_length[ids]
        data = ragged.gather(self.out_bytes, self.out_start[ids], lengths)
        offsets = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        if self.prefix:  # the blank that encoding put before each text
            full = np.flatnonzero(np.diff(offsets))
            keep = np.ones(len(data), bool)
            keep[offsets[full][data[offsets[full]] == 32]] = False
            offsets = np.append(0, np.cumsum(keep))[offsets]
            data = data[keep]
        return data, offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())


def _encode(path: str, new: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            for i, j, ids, counts in model.encode(batch.column(0)):
                ends = np.cumsum(counts)
                data, offsets = model.decode(ids, counts)
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                columns = [*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), strings(data, offsets)]
                names = [*batch.schema.names[1:], *new]
                if len(new) > 3:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encoded(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns n_pieces, ids_crc32, decoded (the text from the ids) and ids, and the names these have."""
    ship(docs.sparkSession)
    kinds = {"n_pieces": "long", "ids_crc32": "long", "decoded": "string"} | ({"ids": "array<int>"} if with_ids else {})
    names = dict(zip(kinds, fresh(docs, *kinds), strict=True))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns] + [f"`{names[c]}` {k}" for c, k in kinds.items()])
    rows = docs.select(F.col(text_col).cast("string").alias("pieces_text__"), *[F.col(f"`{c}`") for c in docs.columns])
    return rows.mapInArrow(_encode(path, list(names.values())), schema), names


def report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32, text_sha256 (of the decoded text), round_trip."""
    rows, _ = encoded(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), path, with_ids=False)
    return rows.select("doc_id", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("text_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
