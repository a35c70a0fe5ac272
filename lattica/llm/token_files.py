"""Token files: ids in canonical length-limited Huffman code, in independent blocks.

Writing: every whole text is encoded by a public tokenizer and ended by ``end_id``; documents are
dealt to parts by ranges of doc_id and sorted; each part is cut into blocks of about
``block_ids`` ids. Counts of all ids give one code for the whole corpus (package-merge, at most
``max_length`` bits); each block is then coded by itself. Reading: a table of 2^max_length entries
decodes one id a step, in lanes: every ``EVERY`` ids a block notes the bit where the next lane
starts, so that all lanes of a block advance together.

Format of a folder: ``code`` (Parquet: id, length) and ``blocks`` (Parquet, not compressed, one
folder a part; part and block ascend as doc_id does): part, block, start (ids of the part before
the block), n_ids, doc_ids, payload. A payload: magic ``HUF1``, then little-endian unsigned 32-bit: number
of documents, number of ids, EVERY, number of checkpoints, number of bytes of bits; then the
documents' lengths, the checkpoints, and the bits (high bit first).

Tokenizing by pieces: the tokenizer's own splitting never joins across the places where a run of
white space ends and a word (with the one space before it) begins, so a text's ids are those of
its pieces, and each distinct piece goes through the library about once a worker (kept in flat
arrays, a bounded number of them). Tests hold this against whole texts.

Defined cases: null and empty texts have only the end id; null doc_id sorts first; repeated rows
and ties of doc_id are documents like others, ordered by their ids' bytes; an empty table gives
empty files and no row; the documents' other columns are not read. A document longer than a block
has a block of its own.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lattica.llm.common import Scratch, bound_arrow, map_batches
from lattica.llm.words import mixed

EVERY = 64
CACHE = 800_000  # pieces that a worker keeps
TOGETHER = 8 << 20  # bytes of text encoded at once
LONG_PIECE = 64  # bytes; longer pieces are not kept
#: White space as Unicode defines it, which is what the tokenizer's pattern means by \s.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


#: Texts whose white space isn't just single spaces and one or two line breaks between other characters.
_IRREGULAR = "\x00|  | \n|\n |\n\n\n|^[ \n]|[ \n]$|[\t\x0b-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _piece_keys(pieces: pa.StringArray) -> np.ndarray:
    """64 bits of each piece's first and last eight bytes and length; longer pieces may share them."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = bytes(8) + memoryview(pieces.buffers()[2] or b"")[offsets[0] : offsets[-1]] + bytes(8)
    offsets += 8 - offsets[0]
    size = np.diff(offsets)
    eights, shift = np.ndarray(len(data) - 7, "<u8", data, 0, (1,)), (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    return mixed((eights[offsets[:-1]] << shift) ^ mixed((eights[offsets[1:] - 8] >> shift) ^ mixed(size.astype(np.uint64))))


class PieceCache:
    """Pieces and their ids in a few flat arrays, found by sorted 64-bit keys and compared whole.

    Of more than ``CACHE`` pieces the half used last stays. Of pieces with one key the first is kept.
    """

    def __init__(self, kind: str):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pieces, self.used, self.turn = pa.array([], pa.string()), np.zeros(0, np.int32), 0
        self.ends, self.ids = np.zeros(1, np.int32), np.zeros(0, kind)  # a row's ids are those from the end before it on

    def find(self, pieces: pa.StringArray, keys: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 where there is none."""
        self.turn += 1
        if not len(self.keys):
            return np.full(len(pieces), -1, np.int32)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.where(self.keys[place] == keys, self.rows[place], -1)
        met = np.flatnonzero(rows >= 0)
        same = pc.equal(pieces.take(pa.array(met)), self.pieces.take(pa.array(rows[met])))
        rows[met[~same.to_numpy(zero_copy_only=False)]] = -1
        self.used[rows[rows >= 0]] = self.turn
        return rows

    def add(self, pieces: pa.StringArray, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Pieces that ``find`` didn't, with the number of ids of each and all those ids."""
        keys, first = np.unique(keys, return_index=True)
        place = np.searchsorted(self.keys, keys)
        free = place == np.searchsorted(self.keys, keys, "right")
        keys, first, place = keys[free], first[free], place[free]
        self.keys = np.insert(self.keys, place, keys)
        self.rows = np.insert(self.rows, place, np.arange(len(first), dtype=np.int32) + len(self.pieces))
        self.pieces = pa.concat_arrays([self.pieces, pieces.take(pa.array(first))])
        self.used = np.append(self.used, np.full(len(first), self.turn, np.int32))
        self._append(sizes[first], ids, (np.cumsum(sizes) - sizes)[first])
        if len(self.pieces) > CACHE:
            self._keep(np.sort(np.argpartition(self.used, -(CACHE // 2))[-(CACHE // 2) :]))

    def _append(self, sizes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.ids = np.append(self.ids, _runs(ids, at, sizes))
        self.ends = np.append(self.ends, (ends + self.ends[-1]).astype(np.int32))

    def _keep(self, rows: np.ndarray) -> None:
        number = np.full(len(self.pieces), -1, np.int32)
        number[rows] = np.arange(len(rows))
        self.pieces, self.used = self.pieces.take(pa.array(rows)), self.used[rows]
        rows_of = number[self.rows]
        self.keys, self.rows = self.keys[rows_of >= 0], rows_of[rows_of >= 0]
        ids, at, sizes = self.ids, self.ends[:-1][rows], np.diff(self.ends)[rows]
        self.ids, self.ends = self.ids[:0], self.ends[:1]
        self._append(sizes, ids, at)


def _runs(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of runs that begin at ``at``, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceEncoder:
    """Text to ids as little-endian bytes, through the tokenizers library, piece by piece.

    A batch's texts are split and their pieces numbered by Arrow; only pieces that the worker
    hasn't met go through the library, many at a time, one a line: a lone line break between two
    pieces is always one id, and no piece of other characters holds that id. Texts of irregular
    white space are split by PIECES instead. A tokenizer that doesn't split as byte-level BPE does
    gets whole texts.

    A piece is noted without the one space before it; one that has no space there begins with NUL
    instead, but for a line break.
    """

    def __init__(self, tokenizer_path: str, width: int, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        made = json.loads(self.tokenizer.to_str())
        splitting = made["pre_tokenizer"] or {}
        self.by_piece = made["normalizer"] is None and (splitting.get("type"), splitting.get("use_regex"), splitting.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0] if self.by_piece else None
        self.width, self.kind, self.end = width, f"<u{width}", int(end_id).to_bytes(width, "little")
        self.cache = PieceCache(self.kind)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_ids(self, noted: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them, from the library."""
        sizes, found = np.zeros(len(noted), np.int64), []
        for a in range(0, len(noted), 512):
            pieces = [p[1:] if p[:1] == "\x00" else p if p == "\n" else " " + p for p in noted.slice(a, 512).to_pylist()]
            blank = [i for i, p in enumerate(pieces) if not p or p.isspace()]
            if blank:
                alone = dict(zip(blank, self._encoded([pieces[i] for i in blank]), strict=True))
                rest = [p for i, p in enumerate(pieces) if i not in alone]
                lines = iter(np.split(*self._lines(rest)) if rest else [])
                parts = [np.array(alone[i], self.kind) if i in alone else next(lines) for i in range(len(pieces))]
                sizes[a : a + 512], ids = [len(p) for p in parts], np.concatenate(parts)
            else:
                ids, ends = self._lines(pieces)
                sizes[a : a + 512] = np.diff(ends, prepend=0, append=len(ids))
            found.append(ids)
        return sizes, np.concatenate([np.zeros(0, self.kind), *found])

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of other characters than white space, and where all but the last piece's end."""
        ids = np.array(self._encoded(["\n".join(pieces)])[0], self.kind)
        line = ids == self.line
        cuts = np.flatnonzero(line)
        if len(cuts) != len(pieces) - 1:
            raise ValueError("the tokenizer joins pieces across lines")
        return ids[~line], cuts - np.arange(len(cuts))

    def _ids_of(self, noted: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: number of ids, place of the first among all ids, and all ids; from what is kept or the library."""
        keys, kept = _piece_keys(noted), self.cache
        rows = kept.find(noted, keys)
        old, new = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        sizes, at, pool = np.zeros(len(noted), np.int64), np.zeros(len(noted), np.int64), kept.ids
        at[old] = kept.ends[rows[old]]
        sizes[old] = kept.ends[rows[old] + 1] - at[old]
        if len(new):
            unmet = noted.take(pa.array(new))
            sizes[new], ids = self._new_ids(unmet)
            at[new] = np.cumsum(sizes[new]) - sizes[new] + len(pool)
            pool = np.append(pool, ids)
            short = np.flatnonzero(pc.binary_length(unmet).to_numpy() <= LONG_PIECE)
            new = new[short]
            kept.add(unmet.take(pa.array(short)), keys[new], sizes[new], _runs(pool, at[new], sizes[new]))
        return sizes, at, pool

    @staticmethod
    def _split(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x00"), pc.replace_substring(texts, "\n", " \n \x00"), ""), " ")

    def _regular(self, texts: pa.Array) -> list[bytes]:
        """Pieces are parted by spaces."""
        if not len(texts):
            return []
        split = [self._split(texts.slice(i, 256)) for i in range(0, len(texts), 256)]
        numbered = pa.chunked_array([s.values for s in split]).dictionary_encode().chunks  # one dictionary for all
        indices, offsets, noted = [c.indices.to_numpy() for c in numbered], [s.offsets.to_numpy() for s in split], numbered[0].dictionary
        del split, numbered
        sizes, at, pool = self._ids_of(noted)
        out = []
        for some, first in zip(indices, offsets, strict=True):
            n = sizes[some]
            cuts = (np.concatenate(([0], np.cumsum(n)))[first] * self.width).tolist()
            got = _runs(pool, at[some], n).tobytes()
            out += [got[a:b] + self.end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _irregular(self, texts: list[str]) -> list[bytes]:
        split = [PIECES.findall(t) for t in texts]
        pieces = list(set().union(*split))
        sizes, at, pool = self._ids_of(pa.array(["\x00" + p for p in pieces], pa.string()))
        ids = {p: pool[a : a + n].tobytes() for p, a, n in zip(pieces, at.tolist(), sizes.tolist(), strict=True)}
        return [b"".join([ids[p] for p in found]) + self.end for found in split]

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not self.by_piece:
            return [np.array(ids, self.kind).tobytes() + self.end for ids in self._encoded([t or "" for t in texts.to_pylist()])]
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, _IRREGULAR), pc.equal(pc.binary_length(texts), 0))
        regular = iter(self._regular(texts.filter(pc.invert(odd))))
        irregular = iter(self._irregular(texts.filter(odd).to_pylist()))
        return [next(irregular if o else regular) for o in odd.to_pylist()]


@functools.cache
def _encoder(tokenizer_path: str, width: int, end_id: int) -> PieceEncoder:
    """One a worker process, for all its tasks."""
    return PieceEncoder(tokenizer_path, width, end_id)


def _gathered(batches, size: int):
    """Batches put together to about ``size`` bytes, so that a piece is looked up once in more texts."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if total:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tokenizing(tokenizer_path: str, width: int, end_id: int, bounds: list[int]):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, edges = _encoder(tokenizer_path, width, end_id), np.array(bounds, np.int64)
        for batch in _gathered(batches, TOGETHER):
            ids = batch.column(0)
            part = np.searchsorted(edges, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([ids, pa.array(part.astype(np.int32)), pa.array(encoder.encode(batch.column(1)), pa.binary())], names=["doc_id", "part", "ids"])
            pa.default_memory_pool().release_unused()

    return run


def _blocking(width: int, block_ids: int, vocabulary: int):
    """Sorted documents of a part to blocks of them, and at the end a row with the task's counts of ids."""
    columns = ["part", "block", "start", "doc_ids", "lengths", "ids", "seen", "counts"]

    def run(batches):
        _encoder.cache_clear()  # this worker may have tokenized before
        part, block, start, names, parts, size = None, 0, 0, [], [], 0
        total = np.zeros(vocabulary, np.int64)

        def flush():
            nonlocal total
            lengths, ids = [len(x) // width for x in parts], b"".join(parts)
            total += np.bincount(np.frombuffer(ids, f"<u{width}"), minlength=vocabulary)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([ids], pa.binary()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64()))],
                names=columns,
            )

        for batch in batches:
            for doc, p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if parts and (p != part or size + len(ids) > block_ids * width):
                    yield flush()
                    start, block = start + size // width, block + 1
                    names, parts, size = [], [], 0
                if p != part:
                    part, block, start = p, 0, 0
                names.append(doc)
                parts.append(ids)
                size += len(ids)
        if parts:
            yield flush()
        seen = np.flatnonzero(total)
        if len(seen):
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.array([seen], pa.list_(pa.int32())), pa.array([total[seen]], pa.list_(pa.int64()))], names=columns)

    return run


def code_lengths(counts: dict[int, int], max_length: int) -> dict[int, int]:
    """Optimal code lengths of at most ``max_length`` bits, by package-merge."""
    ids = sorted(counts, key=lambda k: (counts[k], k))
    if len(ids) <= 1:
        return dict.fromkeys(ids, 1)
    if len(ids) > 1 << max_length:
        raise ValueError(f"{len(ids)} ids need codes of more than {max_length} bits")
    weights = np.array([counts[k] for k in ids], np.int64)
    # levels[i]: for each item of the merged list, True where it is a single id (else a package)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_length):
        merged = np.concatenate((weights, packages))
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(len(ids), np.int64), 2 * (len(ids) - 1)
    for single in reversed(levels):  # the cheapest items of each level; ids are taken lightest first
        n = int(single[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    return dict(zip(ids, lengths.tolist(), strict=True))


class CanonicalCode:
    """Codes ascend by (length, id)."""

    def __init__(self, lengths: dict[int, int]):
        self.ids = np.array(sorted(lengths, key=lambda k: (lengths[k], k)), np.int64)
        self.lengths = np.array([lengths[k] for k in self.ids.tolist()], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        ends = np.cumsum(np.left_shift(1, self.longest - self.lengths))
        self.codes = np.right_shift(np.concatenate(([0], ends[:-1]))[: len(self.ids)], self.longest - self.lengths)

    def encoder(self, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        code, length = np.zeros(vocabulary, np.uint32), np.zeros(vocabulary, np.uint8)
        code[self.ids], length[self.ids] = self.codes, self.lengths
        return code, length

    def table(self) -> np.ndarray:
        """Id and, in the low byte, length of the code that a string of ``longest`` bits begins with."""
        spans = np.left_shift(1, self.longest - self.lengths)
        entries = np.repeat((self.ids << 8 | self.lengths).astype(np.uint32), spans)
        return np.pad(entries, (0, (1 << self.longest) - len(entries)), constant_values=1)


def pack_block(ids: np.ndarray, lengths: list[int], code: np.ndarray, bits: np.ndarray) -> bytes:
    size = bits[ids]
    end = np.cumsum(size, dtype=np.int32 if len(ids) < 1 << 26 else np.int64)
    at = end - size
    value = code[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), first)
    stream = out.astype(">u4").tobytes()[: -(-int(end[-1]) // 8)]
    marks = at[::EVERY].astype("<u4")
    head = np.array([len(lengths), len(ids), EVERY, len(marks), len(stream)], "<u4")
    return b"HUF1" + head.tobytes() + np.array(lengths, "<u4").tobytes() + marks.tobytes() + stream


def unpack_block(payload: bytes, table: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of documents, all ids)."""
    if payload[:4] != b"HUF1":
        raise ValueError("not a block of token ids")
    docs, n, every, marks, size = np.frombuffer(payload, "<u4", 5, 4).tolist()
    lengths = np.frombuffer(payload, "<u4", docs, 24)
    at = np.frombuffer(payload, "<u4", marks, 24 + 4 * docs).astype(np.int64)
    stream = np.frombuffer(payload + bytes(8), np.uint8, size + 8, 24 + 4 * docs + 4 * marks).astype(np.uint32)
    window = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
    out = np.zeros((marks, every), np.uint32)
    full, mask = n // every, np.uint32((1 << longest) - 1)
    for step in range(every):
        lanes = full + (n % every > step)
        key = (window[at[:lanes] >> 3] >> (32 - longest - (at[:lanes] & 7)).astype(np.uint32)) & mask
        out[:lanes, step] = got = table[key]
        at[:lanes] += got & 255
    out >>= 8
    return lengths, out.reshape(-1)[:n] if n % every == 0 else np.concatenate((out[:full].reshape(-1), out[full, : n % every]))


def _packing(code_of, width: int, vocabulary: int):
    def run(batches):
        _encoder.cache_clear()  # this worker may have tokenized before
        code, bits = code_of.value.encoder(vocabulary)
        for batch in batches:
            rows = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            blocks = [pack_block(np.frombuffer(ids, f"<u{width}"), lengths, code, bits) for lengths, ids in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) // width for x in batch.column(5).to_pylist()], pa.int64()), batch.column(3), pa.array(blocks, pa.binary())], names=["part", "block", "start", "n_ids", "doc_ids", "payload"])

    return run


def _unpacking(code_of, with_ids: bool):
    def run(batches):
        _encoder.cache_clear()
        code = code_of.value
        table = code.table()
        for batch in batches:
            for part, start, names, payload in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                lengths, ids = unpack_block(payload, table, code.longest)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                cut = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(starts + start), pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()), pa.array([x.tolist() for x in cut] if with_ids else [None] * len(cut), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def _vocabulary_size(tokenizer_path: str):
    def run(batches):
        from tokenizers import Tokenizer

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([Tokenizer.from_file(tokenizer_path).get_vocab_size()])], names=["n"])

    return run


def _two_columns(df: DataFrame) -> dict[int, int]:
    """The first column to the second; by Arrow, as rows would take several times the memory of the driver."""
    got = df.toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, vocabulary: int | None = None, part_bytes: int = 32 << 20, block_ids: int = 1 << 18, max_length: int = 20) -> None:
    """Writes the documents' ids to the folder ``path``, in ascending order of doc_id."""
    spark = docs.sparkSession
    bound_arrow(spark)
    if vocabulary is None:  # asked of a task, so that the driver holds no tokenizer
        vocabulary = max(map_batches(spark.range(0, 1, 1, 1), _vocabulary_size(tokenizer_path), "n long").first()[0], end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    scratch = Scratch(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    bounds = sorted(set(docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    tokens = map_batches(docs, _tokenizing(tokenizer_path, width, end_id, [int(b) for b in bounds]), "doc_id long, part int, ids binary")
    sorted_ = tokens.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), "ids")
    blocks = scratch.save(map_batches(sorted_, _blocking(width, block_ids, vocabulary), "part int, block int, start long, doc_ids array<long>, lengths array<int>, ids binary, seen array<int>, counts array<long>"), "blocks", "none")
    counts = blocks.select(F.explode(F.arrays_zip("seen", "counts")).alias("x")).groupBy(F.col("x.seen").alias("id")).agg(F.sum("x.counts").alias("n"))
    lengths = code_lengths(_two_columns(counts), max_length)  # a row for each id of the vocabulary at most
    code = pa.table({"id": pa.array(lengths.keys(), pa.int64()), "length": pa.array(lengths.values(), pa.int32())})
    spark.createDataFrame(code, "id long, length int").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    code = spark.sparkContext.broadcast(CanonicalCode(lengths))
    packed = map_batches(blocks.where("part is not null").drop("seen", "counts"), _packing(code, width, vocabulary), "part int, block int, start long, n_ids long, doc_ids array<long>, payload binary")
    packed.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("blocks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    bound_arrow(spark)
    lengths = _two_columns(spark.read.schema("id long, length int").parquet(f"{path}/code"))
    code = spark.sparkContext.broadcast(CanonicalCode(lengths))
    blocks = spark.read.schema("part int, block int, start long, n_ids long, doc_ids array<long>, payload binary").parquet(f"{path}/blocks")
    docs = map_batches(blocks.select("part", "start", "doc_ids", "payload"), _unpacking(code, with_ids), "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = docs.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes token files in the shared folder and reads them back: one row a document."""
    spark = docs.sparkSession
    out = Scratch(spark, "token-files").path("corpus")
    write_token_files(docs, out, tokenizer_path)
    return read_token_files(spark, out)


SQL = None  # SQL has no tokenizer; tests hold the rows against the library and zlib
