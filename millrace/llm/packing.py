"""Packing along a space-filling curve.

Each document's tokens make a hashed vector, which is projected to a few dimensions; the cell it falls in has a place on
a Hilbert curve, and documents are range-sorted by that place. Laid end to end in this order the tokens are cut every
2048, so that a sequence holds neighbours on the curve and no padding; the last, shorter stretch is cut into powers of
two, which need none either.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LENGTH, END = 2048, 1
DIMS, BITS, HASHED = 4, 12, 4096
#: Distinct words whose ids a Python worker keeps, and the longest word that it keeps.
KEPT, KEPT_CHARS = 1_000_000, 48
_SPACES = [chr(c) + " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_CUT = re.compile(r"(?<=\S)(?= )")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, put together from the ids of their words.

    The tokenizer never joins what lies before a space that follows a non-space with what comes after, so a text is cut
    there, and each distinct piece is tokenized once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = range(self.tokenizer.get_vocab_size())
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in ids])  # a space's own sign
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _pieces(self, text: str) -> tuple[str, list[str]]:
        """The first piece, and each later one without its leading space."""
        spaces = _SPACES[:10] if text.isascii() else _SPACES
        if text[:1] != " " and not any(s in text for s in spaces):
            pieces = text.split(" ")
        else:
            pieces = [x[i > 0 :] for i, x in enumerate(_CUT.split(text))]
        return pieces.pop(0), pieces

    def _coded(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of each piece. Pieces of one word each that a space leads are tokenized 50 in a row, and fall apart where
        an id begins with a space."""
        single = [i for i, x in enumerate(pieces) if lead and x.split() == [x]]
        out: list[bytes | None] = [None] * len(pieces)
        groups = [single[i : i + 50] for i in range(0, len(single), 50)]
        joined = self.tokenizer.encode_batch_fast(
            ["".join(lead + pieces[i] for i in g) for g in groups], add_special_tokens=False
        )
        for group, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, "<u2")
            begins = (2 * np.flatnonzero(self.spaced[ids])).tolist()
            if len(begins) == len(group):
                raw = ids.tobytes()
                for i, a, b in zip(group, begins, [*begins[1:], len(raw)], strict=True):
                    out[i] = raw[a:b]
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(
            alone, self.tokenizer.encode_batch_fast([lead + pieces[i] for i in alone], add_special_tokens=False), strict=True
        ):
            out[i] = np.array(e.ids, "<u2").tobytes()
        return out

    def _learn(self, known: dict[str, bytes], new: list[str], lead: str) -> list[str]:
        """Add what is new to what is known; gives back what must be forgotten after use."""
        room = KEPT - len(known)
        known.update(zip(new, self._coded(new, lead), strict=True))
        return [x for k, x in enumerate(new) if k >= room or len(x) > KEPT_CHARS]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        out = []
        for at in range(0, len(texts), 128):
            cut = [self._pieces(t) for t in texts[at : at + 128]]
            heads, tails = {first for first, _ in cut}, set().union(*(later for _, later in cut))
            sides = ((self.first, heads, ""), (self.later, tails, " "))
            passing = [(d, self._learn(d, [x for x in seen if x not in d], lead)) for d, seen, lead in sides]
            get = self.later.__getitem__
            out += [self.first[first] + b"".join(map(get, later)) for first, later in cut]
            for known, names in passing:
                for x in names:
                    del known[x]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def projection(seed: int = 5) -> np.ndarray:
    """For each id the few coordinates that it adds: its signed place in the hashed vector, projected."""
    rng = np.random.default_rng(seed)
    base, ids = rng.standard_normal((HASHED, DIMS)), np.arange(1 << 16, dtype=np.uint64)
    mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    sign = np.where(mixed >> np.uint64(23) & np.uint64(1), 1.0, -1.0)
    return (base[(mixed % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (n, dims), each coordinate below 2**bits."""
    x = cells.T.astype(np.int64).copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, from the largest cube down
        for i in range(dims):
            far = (x[i] & q) > 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(far, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flips ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flips
    place = np.zeros(cells.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def tokenized(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, n (with the end id), x0.. (coordinates), ids (binary, 16 bits each) for each row of docs."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    xs = [f"x{i}" for i in range(DIMS)]
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, code = projection(), encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = code.encode([t or "" for t in part.column(1).to_pylist()])
                means = np.array([table[np.frombuffer(b, "<u2")].mean(0) if b else np.zeros(DIMS) for b in coded])
                n = pa.array([len(b) // 2 + 1 for b in coded], pa.int64())
                cols = [pa.array(means[:, i].astype(np.float64)) for i in range(DIMS)]
                ids = pa.array([b + tail for b in coded], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), n, *cols, ids], names=["doc_id", "n", *xs, "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, {', '.join(f'{x} double' for x in xs)}, ids binary")


def _curve_place(keys: DataFrame) -> DataFrame:
    """Add key: cells are equal shares of a normal distribution with each coordinate's mean and spread."""
    xs = [f"x{i}" for i in range(DIMS)]
    spread = keys.agg(*[F.avg(x) for x in xs], *[F.stddev_pop(x) for x in xs]).first()
    mean = np.array([spread[i] or 0.0 for i in range(DIMS)])
    scale = np.array([spread[DIMS + i] or 1.0 for i in range(DIMS)])
    names = [c for c in keys.columns if c not in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in xs], 1) - mean) / scale
            share = 1.0 / (1.0 + np.exp(-1.702 * np.clip(z, -8, 8)))
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(hilbert(cells), pa.int64())], names=[*names, "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema if f.name in names)
    return keys.mapInArrow(run, f"{fields}, key long")


def _running(value: Column, by: str, part: str | None = None) -> Column:
    w = (Window.partitionBy(part) if part else Window).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (long), and ids.

    docs: doc_id, text; a null or empty text is the end id alone. Each row of docs is a document, so repeated rows are
    packed as often as they stand. Other columns are not carried; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(tokenized(docs, path, end).withColumn("row", F.monotonically_increasing_id()))
    keys = _curve_place(tokens.select("row", "doc_id", "n", *[f"x{i}" for i in range(DIMS)]))
    ordered = stored(
        keys.repartitionByRange("key", "doc_id", "row")
        .sortWithinPartitions("key", "doc_id", "row")
        .select("row", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    )
    # one row for each partition of the range sort
    parts = ordered.groupBy("part").agg(F.sum("n").alias("m"))
    parts = stored(parts.select("part", "m", _running(F.col("m"), "part").alias("base")))
    total = parts.agg(F.sum("m")).first()[0] or 0
    begins = ordered.join(F.broadcast(parts.select("part", "base")), "part").select(
        "row", (F.col("base") + _running(F.col("n"), "place", "part")).alias("begin")
    )
    whole, rest = divmod(total, length)
    #: Where the sequences of the last stretch begin: its length as a sum of powers of two, largest first.
    cuts = [whole * length]
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    tail = np.array(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, begin, n, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    now = begin
                    while now < begin + n:
                        if now < tail[0]:
                            seq, first = divmod(now, length)
                            to = min(begin + n, (seq + 1) * length)
                        else:
                            k = int(np.searchsorted(tail, now, side="right")) - 1
                            seq, first, to = whole + k, now - int(tail[k]), min(begin + n, int(tail[k + 1]))
                        piece = wide[now - begin : to - begin].tobytes()
                        rows.append((doc_id, now - begin, to - now, zlib.crc32(piece), n, seq, first, piece))
                        now = to
                columns = list(zip(*rows, strict=True))
                types = [part.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    fields = f"doc_id {kind}, {', '.join(f'{x} long' for x in names[1:-1])}, ids binary"
    return tokens.join(begins, "row").select("doc_id", "begin", "n", "ids").mapInArrow(run, fields)
