"""Token ids of documents in a compressed file: canonical length-limited Huffman codes, decoded by table.

Format: a folder with two Parquet tables. ``codes`` (id, n, length) has the code length of every id
in use; the codes are canonical, ordered by (length, id). ``blocks`` (part, start, doc_ids, lengths,
checkpoints, bits) has whole documents in ascending order of doc_id; ``start`` counts the ids
before the block, ``checkpoints`` has the bit offset of every ``STRIDE``-th id, ``bits`` the codes,
highest bit first. A block is decoded without any other one, and from any checkpoint on.

Writing: texts are encoded next to the scan, ids move once, by range of doc_id, and are written as
raw blocks; ids are counted over all of them; code lengths come from these global counts
(package-merge, at most ``MAX_BITS`` bits; the vocabulary bounds what the driver sees).

Nulls: a null text is encoded as an empty one, which gives the end id alone; rows without doc_id
come first. Rows of one doc_id are ordered by their ids. A very long text is a block of its own.
An empty table gives empty tables.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.llm import text as X
from inkstat.llm.scratch import Scratch

END_ID = 1
BLOCK = 1 << 16
STRIDE = 128
MAX_BITS = 16
CACHE = 800_000
# marks that the pre-tokeniser always splits off a word that ends in an ASCII letter or digit
TAIL = b"!#$%&()*+,-./:;=?@[]^_`{}~"


class WordEncoder:
    """Ids of a text from the ids of its parts between ASCII white space, which no token crosses.

    Every different part goes through the tokenizer once per batch; the frequent ones stay in a
    cache of bounded size. A-Z are lower-cased before (the tokenizer does that too) unless a
    combining mark, which lower case could compose with, or a special token's bracket is there.
    """

    def __init__(self, path: str, dtype: str = "<u2"):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.cache = Tokenizer.from_file(path), dtype, {}
        self.model = self.tokenizer.model
        # the byte-level alphabet, for bytes that do not stand for themselves
        moved = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(moved)}
        # letters go straight to the model only if the tokenizer's steps before it are known to do no more than this
        self.direct = all(self.tokenizer.encode(w, add_special_tokens=False).ids == [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet))] for w in ("the", "été", "größe", "ñandú"))

    def one_piece(self, part: bytes) -> str | None:
        """What the model sees of a word of lower-case Latin letters, which the tokenizer neither changes nor splits; else null."""
        if not self.direct:
            return None
        if part.isalpha():  # ASCII letters, which stand for themselves
            return part.decode() if part.islower() else None
        word = part.decode()
        if not word.isalpha() or max(word) > "\u024f" or not unicodedata.is_normalized("NFC", word) or word != word.lower():
            return None
        return part.decode("latin-1").translate(self.alphabet)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def fresh(self, parts: set[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that the cache lacks; a word and the marks behind it are encoded apart, as the pre-tokeniser splits there."""
        cuts = {}
        for p in parts:
            core = p.rstrip(TAIL)
            cuts[p] = (core, p[len(core) :]) if len(core) < len(p) and core[-1:].isalnum() else (p,)
        known = {x: self.cache.get(x) for c in cuts.values() for x in c}
        rest = [x for x, ids in known.items() if ids is None]
        other = []
        for x in rest:
            if (piece := self.one_piece(x)) is None:
                other.append(x)
            else:
                known[x] = self.packed([t.id for t in self.model.tokenize(piece)])
        for x, e in zip(other, self.tokenizer.encode_batch_fast([x.decode() for x in other], add_special_tokens=False)):
            known[x] = self.packed(e.ids)
        if len(self.cache) < CACHE:
            self.cache.update(known)
        return {p: b"".join(known[x] for x in c) for p, c in cuts.items()}

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text, without an end id."""
        split = [(t.lower() if b"\xcc" not in t and b"\xcd" not in t and b"<|" not in t else t).split() for t in texts]
        rows = [list(map(self.cache.get, s)) for s in split]
        holes = [[k for k, ids in enumerate(r) if ids is None] if None in r else [] for r in rows]
        found = self.fresh({s[k] for s, h in zip(split, holes) for k in h})
        if len(self.cache) < CACHE:
            self.cache.update(found)
        for s, r, h in zip(split, rows, holes):
            for k in h:
                r[k] = found[s[k]]
        return [b"".join(r) for r in rows]


ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, dtype: str) -> WordEncoder:
    """One encoder, with its cache, per Python worker."""
    if (path, dtype) not in ENCODERS:
        ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return ENCODERS[path, dtype]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for counts > 0 (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit into codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, []
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        merged = np.argsort(both, kind="stable")
        kinds.append(merged < n)
        level = both[merged]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in code order, their lengths, and their codes."""
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    codes = np.zeros(len(ids), np.int64)
    for i in range(1, len(ids)):
        codes[i] = (codes[i - 1] + 1) << (lengths[i] - lengths[i - 1])
    return ids, lengths, codes


def pack(ids: np.ndarray, code_of: np.ndarray, length_of: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the codes of ``ids``, and the bit offset of every STRIDE-th id."""
    length = length_of[ids]
    ends = np.cumsum(length)
    begin = ends - length
    total = int(ends[-1]) if len(ids) else 0
    cell, shift = begin >> 5, (64 - (begin & 31) - length).astype(np.uint64)
    value = code_of[ids].astype(np.uint64) << shift
    cells = (total + 31) // 32 + 1
    # the bits of one cell never overlap, so their sum is below 2**32 and exact in a double
    bits = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), cells) + np.bincount(cell + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), cells)[:cells] if len(ids) else np.zeros(1)
    return bits.astype(">u4").tobytes()[: (total + 7) // 8], begin[::STRIDE]


def decode_table(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of ``most`` bits the id that it begins with and that id's code length."""
    symbol, width = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    spans = 1 << (most - lengths)
    filled = int(spans.sum())
    symbol[:filled], width[:filled] = np.repeat(ids, spans), np.repeat(lengths, spans)
    return symbol, width


def unpack(blocks: list[bytes], marks: list[np.ndarray], sizes: list[int], symbol: np.ndarray, width: np.ndarray, most: int) -> list[np.ndarray]:
    """Ids of several blocks: all stretches between checkpoints advance together, one id a step."""
    bases = np.cumsum([0, *(len(b) for b in blocks)])
    raw = np.frombuffer(b"".join(blocks) + bytes(8), np.uint8).astype(np.uint32)
    view = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.concatenate([m.astype(np.int64) + 8 * base for m, base in zip(marks, bases)])
    last, mask = 8 * (len(view) - 1), (1 << most) - 1
    out = np.empty((len(at), STRIDE), np.uint32)
    for k in range(STRIDE):
        hit = (view[at >> 3] >> (32 - most - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = symbol[hit]
        at = np.minimum(at + width[hit], last)
    rows = np.cumsum([0, *(len(m) for m in marks)])
    return [out[a:b].reshape(-1)[:n] for a, b, n in zip(rows[:-1], rows[1:], sizes)]


def raw_blocks(docs: DataFrame, tokenizer: str, dtype: str, end_id: int, parts: int) -> DataFrame:
    """(part, start_in_part, n, doc_ids, lengths, ids): encoded documents in order of doc_id, cut into blocks."""
    bounds = np.unique(docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []) if parts > 1 else np.empty(0)

    def encoded(batches):
        coder, end = encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes()
        for batch in batches:
            for piece in X.pieces(batch):
                buf, offs = X.buffers(piece.column("text"))
                data = buf.tobytes()
                ids = [x + end for x in coder.batch([data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])]
                key = piece.column("doc_id")
                part = np.where(np.asarray(key.is_valid()), np.searchsorted(bounds, key.fill_null(0).to_numpy(zero_copy_only=False), "left"), 0)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), key, pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def blocks(batches):
        unit, held, size = np.dtype(dtype).itemsize, [], 0
        part, start = None, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([[len(x) // unit for _, x in held]], pa.list_(pa.int64())), pa.array([b"".join(x for _, x in held)], pa.binary())],
                names=["part", "start_in_part", "n", "doc_ids", "lengths", "ids"],
            )

        for batch in batches:
            for p, d, x in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if held and (p != part or size + len(x) // unit > BLOCK):
                    yield row()
                    start, held, size = (start + size if p == part else 0), [], 0
                part = p
                held.append((d, x))
                size += len(x) // unit
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, "part int, doc_id long, ids binary")
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return ordered.mapInArrow(blocks, "part int, start_in_part long, n long, doc_ids array<long>, lengths array<long>, ids binary")


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, max_bits: int = MAX_BITS) -> None:
    """Encode ``docs(doc_id, text)`` and write the file to the new folder ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    max_bits = max(max_bits, (size - 1).bit_length())
    raw = scratch.save(raw_blocks(docs, tokenizer, dtype, end_id, int(spark.conf.get("spark.sql.shuffle.partitions"))), "raw")

    def counts(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(x, dtype), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])

    used = sorted((r["id"], r["n"]) for r in raw.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect())
    ids, n = np.array([u[0] for u in used], np.int64), np.array([u[1] for u in used], np.int64)
    lengths = code_lengths(n, max_bits)
    spark.createDataFrame(list(zip(ids.tolist(), n.tolist(), lengths.tolist())), "id long, n long, length long").coalesce(1).write.parquet(f"{path}/codes")

    order, widths, codes = canonical(ids, lengths)
    code_of, length_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
    code_of[order], length_of[order] = codes, widths
    tables = spark.sparkContext.broadcast((code_of, length_of))
    # one row per range of doc_id
    ends = sorted((r["part"], r["n"]) for r in raw.groupBy("part").agg(F.sum("n").alias("n")).collect())
    front = dict(zip((p for p, _ in ends), np.cumsum([0, *(k for _, k in ends)]).tolist()))

    def coded(batches):
        code_of, length_of = tables.value
        for batch in batches:
            for part, at, doc_ids, lengths, x in zip(*(batch.column(c).to_pylist() for c in ("part", "start_in_part", "doc_ids", "lengths", "ids"))):
                bits, marks = pack(np.frombuffer(x, dtype), code_of, length_of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([front[part] + at], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([marks.astype("<i8").tobytes() if len(bits) >= 1 << 28 else marks.astype("<u4").tobytes()], pa.binary()), pa.array([bits], pa.binary())],
                    names=["part", "start", "doc_ids", "lengths", "checkpoints", "bits"],
                )

    raw.mapInArrow(coded, "part int, start long, doc_ids array<long>, lengths array<long>, checkpoints binary, bits binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop("raw")


def read_token_file(spark: SparkSession, path: str, fold: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a file, or ``value long``, what ``fold`` makes of a document's ids, in the place of ids."""
    used = spark.read.parquet(f"{path}/codes").select("id", "length").collect()  # at most the vocabulary
    ids, widths = np.array([r["id"] for r in used], np.int64), np.array([r["length"] for r in used], np.int64)
    most = int(widths.max(initial=1))
    tables = spark.sparkContext.broadcast(decode_table(*canonical(ids, widths), most))

    def flush(held) -> Iterator[pa.RecordBatch]:
        symbol, width = tables.value
        marks = [np.frombuffer(m, "<i8" if len(b) >= 1 << 28 else "<u4") for m, b in zip(held["checkpoints"], held["bits"])]
        sizes = [sum(x) for x in held["lengths"]]
        doc_ids, starts, ns, values = [], [], [], []
        for found, start, docs, lengths in zip(unpack(held["bits"], marks, sizes, symbol, width, most), held["start"], held["doc_ids"], held["lengths"]):
            ends = np.cumsum([0, *lengths]).tolist()
            doc_ids += docs
            starts += [start + a for a in ends[:-1]]
            ns += lengths
            values += [fold(found[a:b]) if fold else found[a:b] for a, b in zip(ends[:-1], ends[1:])]
        last = pa.array(values, pa.int64()) if fold else X.list_column([v.astype(np.int64) for v in values])
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), last], names=["doc_id", "start", "n_tokens", "value" if fold else "ids"])

    def rows(batches):
        for batch in batches:
            # several blocks are decoded at a time, about a million ids
            a = 0
            sizes = [sum(x) for x in batch.column("lengths").to_pylist()]
            while a < batch.num_rows:
                b, total = a, 0
                while b < batch.num_rows and (b == a or total + sizes[b] <= 16 * BLOCK):
                    total += sizes[b]
                    b += 1
                yield from flush({c: batch.column(c).slice(a, b - a).to_pylist() for c in ("start", "doc_ids", "lengths", "checkpoints", "bits")})
                a = b

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "checkpoints", "bits")
    return blocks.mapInArrow(rows, f"doc_id long, start long, n_tokens long, {'value long' if fold else 'ids array<long>'}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a token file, written to the shared folder and read back."""
    scratch = Scratch(docs.sparkSession)
    write_token_file(docs, f"{scratch.root}/file", tokenizer, end_id)
    return read_token_file(docs.sparkSession, f"{scratch.root}/file", crc32).withColumnRenamed("value", "ids_crc32")
