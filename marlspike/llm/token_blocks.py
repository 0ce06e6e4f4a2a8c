"""Token ids in patched frame-of-reference blocks (operator 6).

File format (little-endian), one file per run of documents:

- header: magic ``MTB1``, block size, documents, ids, blocks, bytes of the
  payload (six unsigned 32-bit numbers after the magic: block size, documents,
  blocks, 0; then two unsigned 64-bit: ids, payload bytes);
- documents: doc_id (int64), null flag (byte), ids with the end id (int64);
- index: for each block its start in the payload (uint64), minimum (uint32),
  width (byte), number of exceptions (uint16);
- payload of a block: width * 16 words of 64 bits, then its exceptions
  (place uint16, value above the minimum uint32).

A block has 1,024 ids (the last is padded with its minimum). The minimum is
subtracted; the width is the number of bits that ``percentile`` of the
differences fit in; larger differences are exceptions. A block's 1,024 values
form 64 lanes of 16, so that packing and unpacking are a few shifts on whole
rows. The index of block starts lets a reader open any block alone.

Files are rows (file number, bytes) of a Parquet table in ascending doc_id
order, so that any store that Spark writes to holds them.

Defined cases: a null or empty text is the end id alone; a text of any length
is encoded whole and stands in one file, which may then be larger; null doc_ids
come first; documents with equal doc_id keep the order of their texts, and
repeated rows are encoded each; an empty table gives no file and an empty
result. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools
import json
import operator
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches
from .textnum import give_back, together

BLOCK, LANES = 1024, 64
MAGIC = b"MTB1"
FILE_IDS = 1 << 20
#: Bytes of text that are encoded together: the more, the more words are alike.
TEXT_BYTES = 12 << 20


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values below 2^width -> (blocks, width * 16) words."""
    v = values.reshape(len(values), LANES, 16)
    out = np.zeros((len(values), width, 16), np.uint64)
    for j in range(LANES):
        w, s = divmod(j * width, 64)
        out[:, w] |= v[:, j] << np.uint64(s)
        if s + width > 64:
            out[:, w + 1] |= v[:, j] >> np.uint64(64 - s)
    return out.reshape(len(values), width * 16)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    v = words.reshape(len(words), width, 16)
    out = np.empty((len(words), LANES, 16), np.uint64)
    most = np.uint64((1 << width) - 1)
    for j in range(LANES):
        w, s = divmod(j * width, 64)
        x = v[:, w] >> np.uint64(s)
        if s + width > 64:
            x = x | (v[:, w + 1] << np.uint64(64 - s))
        out[:, j] = x & most
    return out.reshape(len(words), BLOCK)


def encode_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.98) -> bytes:
    """One file's bytes; ``lengths`` ids of each document stand one after another in ``ids``."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n_blocks, BLOCK)
    tail = len(ids) - (n_blocks - 1) * BLOCK
    if n_blocks:
        blocks[-1, tail:] = blocks[-1, :tail].min()
    low = blocks.min(1) if n_blocks else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    allowed = BLOCK - min(BLOCK, int(np.ceil(percentile * BLOCK)))
    width, most = np.zeros(n_blocks, np.int64), np.full(n_blocks, int(rest.max()).bit_length() if n_blocks else 0)
    while (width < most).any():  # by halving: a block needs more bits while too many values are beyond
        half = (width + most) // 2
        beyond = (rest > ((1 << half) - 1).astype(np.uint32)[:, None]).sum(1) > allowed
        width, most = np.where(beyond & (width < most), half + 1, width), np.where(beyond, most, half)
    over = rest > ((1 << width) - 1).astype(np.uint32)[:, None]
    n_over = over.sum(1)
    sizes = width * 128 + n_over * 6
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            packed = _pack((rest[own] & np.uint32((1 << int(w)) - 1)).astype(np.uint64), int(w)).astype("<u8").view(np.uint8).reshape(len(own), -1)
            payload[starts[own][:, None] + np.arange(w * 128)] = packed
    for b in np.flatnonzero(n_over):
        place = np.flatnonzero(over[b])
        s = starts[b] + width[b] * 128
        payload[s : s + 2 * len(place)] = place.astype("<u2").view(np.uint8)
        payload[s + 2 * len(place) : s + 6 * len(place)] = rest[b, place].astype("<u4").view(np.uint8)
    return b"".join([
        MAGIC, struct.pack("<IIIIQQ", BLOCK, len(doc_ids), n_blocks, 0, len(ids), len(payload)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), lengths.astype("<i8").tobytes(),
        starts[:-1].astype("<u8").tobytes(), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), n_over.astype("<u2").tobytes(), payload.tobytes(),
    ])


def read_header(raw: bytes) -> dict:
    """Everything of a file but its payload's values; ``at`` is where the payload starts."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token block file")
    block, docs, blocks, _, ids, payload = struct.unpack_from("<IIIIQQ", raw, 4)
    at, out = 36, {"block": block, "n_ids": ids}
    for name, kind, n in (("doc_id", "<i8", docs), ("null", "u1", docs), ("length", "<i8", docs), ("start", "<u8", blocks), ("low", "<u4", blocks), ("width", "u1", blocks), ("n_over", "<u2", blocks)):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    if len(raw) != at + payload:
        raise ValueError("a token block file is cut short")
    return out | {"at": at}


def decode_blocks(raw: bytes, head: dict, which: np.ndarray) -> np.ndarray:
    """The ids of the blocks ``which``, (blocks, 1024)."""
    out = np.zeros((len(which), BLOCK), np.uint64)
    body = np.frombuffer(raw, np.uint8, offset=head["at"])
    width, start = head["width"][which].astype(np.int64), head["start"][which].astype(np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            packed = np.ascontiguousarray(body[start[own][:, None] + np.arange(w * 128)]).view("<u8")
            out[own] = _unpack(packed, int(w))
    for i in np.flatnonzero(head["n_over"][which]):
        n = int(head["n_over"][which[i]])
        s = int(start[i] + width[i] * 128)
        place = np.frombuffer(body[s : s + 2 * n].tobytes(), "<u2")
        out[i, place] = np.frombuffer(body[s + 2 * n : s + 6 * n].tobytes(), "<u4")
    return out + head["low"][which].astype(np.uint64)[:, None]


def decode_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file."""
    head = read_header(raw)
    ids = decode_blocks(raw, head, np.arange(len(head["start"]))).ravel()[: head["n_ids"]].astype(np.uint32)
    return [None if z else int(d) for d, z in zip(head["doc_id"], head["null"])], head["length"], ids


#: Letters of blocks without later additions: Latin up to Extended-B, the Russian alphabet.
_LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{410}-\x{44F}]"
#: ASCII marks but the apostrophe, which can join with letters.
_MARKS = r"[!-&(-/:-@\[-`{-~]"
_MARK_CHARS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and b != 39)


def _apart(data: np.ndarray) -> np.ndarray:
    """True for spaces and line ends: where a text is cut."""
    return (data == 32) | (data == 10)


def _other_blanks(data: np.ndarray) -> np.ndarray:
    """Places of control characters but line ends, and of longer white space, in UTF-8 bytes."""
    found = [np.flatnonzero((data < 32) & (data != 10))]
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(at):
        second, third = (data[np.minimum(at + j, len(data) - 1)].astype(np.int64) for j in (1, 2))
        code = (data[at].astype(np.int64) << 16) | (second << 8) | np.where(data[at] == 0xC2, 0, third)
        wide = [0xC28500, 0xC2A000, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
        found.append(at[np.isin(code, wide)])
    return np.concatenate(found)


_ID = operator.attrgetter("id")
#: Stretches whose ids are put together at once.
_ROWS = 1 << 18


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each row, one row after another."""
    run = np.cumsum(size)
    return np.repeat(begin - (run - size), size) + np.arange(run[-1] if len(run) else 0)


class _Known:
    """Ids of stretches by their bytes: rows of one flat array."""

    def __init__(self):
        self.row: dict[bytes, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, names: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        self.row.update(zip(names, range(len(self.size), len(self.size) + len(names))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level pre-tokenizer ends a piece before a lone space, and before and
    after a lone line end, whatever surrounds them. So the ids of a text are
    those of its stretches from one such place to the next, one after another.
    A batch's stretches are numbered, so each different one goes to the library
    once; nothing is kept from batch to batch. Texts with other white space, and
    tokenizers of other kinds, are encoded in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_stretch = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if self.by_stretch:
            self.line_end = self._whole(["\n"])[0]
            shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]  # bytes that stand for themselves; the others follow 255
            hidden = [b for b in range(256) if b not in shown]
            self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden) if b != 10}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of letters, each with its space: one piece for the pre-tokenizer, so they go to the model as they are."""
        ids: list[int] = []
        ends = [0]
        for found in map(self.tok.model.tokenize, b"\n".join(words).decode("latin-1").translate(self.letters).split("\n") if words else []):
            ids.extend(map(_ID, found))
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64))

    def _learn(self, names: list[bytes]) -> _Known:
        """The ids of different stretches.

        Most are a word of letters (of old blocks, which all Unicode versions agree on), after a line end, which is a
        piece of its own, or before marks, which are one; the others go through the library whole."""
        known = _Known()
        arr = pa.array(names, pa.large_binary()).cast(pa.large_string())
        line = np.fromiter((p[0] == 10 for p in names), bool, len(names))
        if line.any():
            arr = pa.compute.if_else(pa.array(line), pa.compute.utf8_slice_codeunits(arr, 1), arr)
        easy = pa.compute.match_substring_regex(arr, f"^ ?{_LETTERS}+{_MARKS}*$").to_numpy(zero_copy_only=False)
        if not easy.all():
            hard = np.flatnonzero(~easy)
            found = self._whole([names[i].decode() for i in hard.tolist()])
            known.add([names[i] for i in hard.tolist()], np.concatenate(found), np.array([len(x) for x in found], np.int64))
            own = np.flatnonzero(easy)
            names, line, arr = [names[i] for i in own.tolist()], line[own], arr.filter(pa.array(easy))
        if not names:
            return known
        bare = pa.compute.ascii_rtrim(arr, _MARK_CHARS)
        cut = pa.compute.binary_length(bare).to_numpy()
        bare = bare.dictionary_encode()
        words = [w.encode() for w in bare.dictionary.to_pylist()]
        new = [w for w in words if w not in known.row]
        known.add(new, *self._words(new))
        word = np.fromiter(map(known.row.__getitem__, words), np.int64, len(words))[bare.indices.to_numpy()]
        whole = pa.compute.binary_length(arr).to_numpy()
        more = np.flatnonzero(line | (cut < whole))
        if not len(more):
            return known
        # line end, word and marks of the stretches that are not a word alone
        raw = [names[i] for i in more.tolist()]
        tails = [p[c + n :] for p, c, n in zip(raw, cut[more].tolist(), line[more].tolist())]
        tail = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        ends = [np.zeros(0, np.uint32) if not t else x for t, x in zip(tail, self._whole([t.decode() for t in tail]))]
        end_size = np.array([len(x) for x in ends], np.int64)
        pool = np.concatenate([known.flat, self.line_end, *ends])
        of = np.fromiter(map(tail.__getitem__, tails), np.int64, len(tails))
        begin = np.stack([np.full(len(more), len(known.flat)), known.begin[word[more]], len(known.flat) + len(self.line_end) + (np.cumsum(end_size) - end_size)[of]], 1)
        size = np.stack([line[more] * len(self.line_end), known.size[word[more]], end_size[of]], 1)
        known.add(raw, pool[_ragged(begin.ravel(), size.ravel())], size.sum(1))
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); null is empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        plain = self._plain(texts, data, off)
        if not plain.all():
            some = np.flatnonzero(~plain)
            rest = self._whole([x.decode() for x in texts.take(pa.array(some)).to_pylist()])
            ids, count = self._stretches(texts.filter(pa.array(plain)))
            of = np.flatnonzero(plain)
            parts: list = [None] * n
            for d, x in zip(of.tolist(), np.split(ids, np.cumsum(count)[:-1]) if len(of) else []):
                parts[d] = x
            for d, x in zip(some.tolist(), rest):
                parts[d] = x
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return self._stretches(texts)

    def _plain(self, texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts without white space but lone spaces and line ends between other characters, and without special tokens."""
        n = len(texts)
        if not self.by_stretch:
            return np.zeros(n, bool)
        full = np.flatnonzero(np.diff(off))
        ok = np.ones(n, bool)
        apart = _apart(data)
        ok[full] = ~apart[off[full]] & ~apart[off[full + 1] - 1]
        bad = np.concatenate([np.flatnonzero(apart[1:] & apart[:-1]), _other_blanks(data)])
        ok[np.searchsorted(off, bad, "right") - 1] = False
        for s in self.special:
            ok &= ~pa.compute.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return ok

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        cut = _apart(data)
        cut[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(cut)
        each = np.searchsorted(start, off)
        bounds = np.append(start, len(data)).astype(np.int64)
        named = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        which = named.indices.to_numpy()
        _, ends, body = named.dictionary.buffers()
        ends, body = np.frombuffer(ends, np.int64)[: len(named.dictionary) + 1].tolist(), body.to_pybytes()
        names = list(map(body.__getitem__, map(slice, ends[:-1], ends[1:])))
        known = self._learn(names)
        row = np.fromiter(map(known.row.__getitem__, names), np.int32, len(names))[which]
        del named, which, names, body, ends
        known.row.clear()
        count = known.size[row]
        run = np.concatenate([[0], np.cumsum(count)])
        ids = [known.flat[_ragged(known.begin[row[k : k + _ROWS]], count[k : k + _ROWS])] for k in range(0, len(row), _ROWS)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), run[each[1:]] - run[each[:-1]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, percentile: float = 0.98, doc_id: str = "doc_id", text: str = "text", text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Encode every whole text and write the files: (part int, seq int, n_ids long, file binary).

    ``tokenizer`` is a path that every executor can open. Documents are range
    partitioned by doc_id, so parts and the files in them are in ascending order.
    ``text_bytes`` bounds what a worker holds, but for a longer text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        enc = encoder(tokenizer)
        now, seq, names, sizes, found = None, 0, [], [], []

        def file():
            ids = np.concatenate(found)
            raw = encode_file(names, np.concatenate(sizes), ids, percentile)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "n_ids", "file"])

        for b in together(batches, text_bytes):
            ids, count = enc.encode(b.column(1))
            ids, count = np.insert(ids, np.cumsum(count), np.uint32(end_id)), count + 1
            upto = np.concatenate([[0], np.cumsum(count)])
            part = b.column(2).to_numpy()
            # a file ends with its range, and where it has FILE_IDS ids
            cut = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (upto[1:-1] // FILE_IDS != upto[:-2] // FILE_IDS)]))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
                if names and (part[x] != now or sum(map(len, found)) >= FILE_IDS):
                    yield file()
                    seq, names, sizes, found = seq + 1, [], [], []
                if part[x] != now:
                    now, seq = int(part[x]), 0
                names += b.column(0).slice(x, y - x).to_pylist()
                sizes.append(count[x:y])
                found.append(ids[upto[x] : upto[y]])
        if names:
            yield file()
        give_back()

    return materialize(rows.mapInArrow(run, "part int, seq int, n_ids long, file binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    by_part = by_part.withColumn("p0", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("s0"))
    base = base.join(by_part.select(F.col("part"), "p0"), "part").select("part", "seq", (F.col("p0") + F.col("s0")).alias("base"))

    def run(batches):
        for b in batches:
            for part, seq, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                names, lengths, ids = decode_file(raw)
                start = np.cumsum(lengths) - lengths
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array([seq] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
