"""Product codes of vectors by member-resident Lloyd rounds in whole numbers.

A component x becomes floor(4096 * x); a vector is cut into ``PARTS`` equal parts, each coded by the
index of the nearest of up to ``ENTRIES`` codebook entries of its position (squared Euclidean
distance, ties to the lower index).

State: rows (position, entry, salt, n, members, sums) in the shared folder, each a packed block of parts
that live with their entry; a hot entry is spread over ``salts``. A round reads the blocks and
compares their members with the new codebook: members that stay are written again by the same task without an
exchange, only parts that change entry are dealt to their new owner. ``sums`` are the owner's totals of its
members; added up per entry they give the next codebook (positions x entries x width numbers, whatever the
rows). No task holds more than one Arrow batch of blocks, and a lost executor costs the tables of one round.

Nulls: rows whose vector is null or holds null or non-finite components are dropped, as are vectors of
another length than that of the smallest kept id, and lengths that ``PARTS`` does not divide; an empty vector has no
components and is dropped. A null id sorts last; equal ids are ordered by components. Components beyond +-``LIMIT`` (after scaling)
are set to it, so that sums of squares stay exact. With fewer vectors than entries there are fewer entries.
An empty table gives an empty result. Columns besides the three are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.scratch import Scratch

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 1 << 26
BLOCK_BYTES = 1 << 16
STATE = "position int, entry int, salt int, n long, members binary, sums array<long>, moved boolean"


def whole_numbers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, components): the kept vectors as whole numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).where(fine)
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int"))
    return kept.select("vec_id", "label", whole.alias("components"))


def first_codebooks(whole: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Entries of the smallest ids: array (position, entry, width)."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).select("components").collect()
    if not rows:
        return None
    width = len(rows[0].components)
    same = np.array([r.components for r in rows if len(r.components) == width], dtype=np.int64)
    return np.ascontiguousarray(same.reshape(len(same), parts, width // parts).transpose(1, 0, 2))


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``members``; exact in 64-bit whole numbers."""
    best = np.zeros(len(members), dtype=np.int64)
    least = np.full(len(members), np.iinfo(np.int64).max, dtype=np.int64)
    for k, entry in enumerate(book):
        gap = members - entry
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = distance < least
        best[closer], least[closer] = k, distance[closer]
    return best, least


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


class Blocks:
    """Rows of the state, collected as packed blocks of at most ``BLOCK_BYTES``."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, position: int, entry: int, salt: int, members: np.ndarray, moved: bool) -> None:
        most = max(1, BLOCK_BYTES // (4 * members.shape[1]))
        for at in range(0, len(members), most):
            cut = members[at:at + most]
            self.rows.append((position, entry, salt, len(cut), cut.astype("<i4").tobytes(), cut.sum(axis=0).tolist(), moved))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_())
        names = ("position", "entry", "salt", "n", "members", "sums", "moved")
        columns = zip(*self.rows) if self.rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=list(names))


def settle(whole: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """The first blocks: every part goes to its nearest entry. Salts go round robin, so equal rows are spread as well."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            out, vectors = Blocks(), matrix(batch.column(0)).reshape(-1, parts, width)
            for position in range(parts):
                members = vectors[:, position]
                entry, _ = nearest(members, books[position])
                for k in np.unique(entry):
                    out.add(position, int(k), turn % salts, members[entry == k], True)
                    turn += 1
            yield out.batch()

    return whole.select("components").mapInArrow(run, STATE)


def reassign(state: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """The blocks after a comparison with ``books``; ``moved`` marks those whose members change entry."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes: dict[tuple, list[bytes]] = {}
            for position, entry, salt, members in zip(*(batch.column(i).to_pylist() for i in range(4))):
                homes.setdefault((position, entry, salt), []).append(members)
            out, leaving = Blocks(), {}
            for (position, entry, salt), packed in homes.items():
                members = np.frombuffer(b"".join(packed), dtype="<i4").reshape(-1, width).astype(np.int64)
                now, _ = nearest(members, books[position])
                out.add(position, entry, salt, members[now == entry], False)
                for k in np.unique(now[now != entry]):
                    leaving.setdefault((position, int(k), salt), []).append(members[now == k])
            for (position, k, salt), members in leaving.items():
                out.add(position, k, (salt + k) % salts, np.concatenate(members), True)
            yield out.batch()

    return state.select("position", "entry", "salt", "members").mapInArrow(run, STATE)


def migrate(blocks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The next state: blocks that stay, as the tasks that read them wrote them, and those that moved, dealt to their owner."""
    written = scratch.save(blocks, f"{name}-kept")  # written before it is split by kind, so that Python runs once over each block
    moved = scratch.save(written.where("moved").repartition("position", "entry", "salt"), f"{name}-moved")
    return written.where("NOT moved").union(moved)


def owners_update(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of its members' mean, from the totals of its blocks; entries without members stay."""
    totals = state.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])))
    out = books.copy()
    for row in totals.collect():  # positions x entries rows
        out[row.position, row.entry] = [row[f"s{i}"] // row.n for i in range(books.shape[2])]
    return out


def fit_codebooks(whole: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, salts: int = 32) -> np.ndarray | None:
    """Codebooks (position, entry, width) after ``rounds`` Lloyd rounds over all parts; none for an empty table."""
    books = first_codebooks(whole, parts, entries)
    if books is None:
        return None
    whole = whole.where(F.size("components") == parts * books.shape[2])
    state = None
    for turn in range(rounds):
        if state is None:
            state = scratch.save(settle(whole, books, salts).repartition("position", "entry", "salt"), f"{turn}-moved")
        else:
            state = migrate(reassign(state, books, salts), scratch, f"{turn}")
            scratch.drop(f"{turn - 1}-kept", f"{turn - 1}-moved")
        books = owners_update(state, books)
    scratch.drop(f"{rounds - 1}-kept", f"{rounds - 1}-moved")
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector under ``books``: two hex digits a part, and the summed squared distance."""
    parts, _, width = books.shape
    rows = whole.where(F.size("components") == parts * width)
    kept = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(2)).reshape(-1, parts, width)
            codes, error = np.empty((len(vectors), parts), dtype=np.uint8), np.zeros(len(vectors), dtype=np.int64)
            for position in range(parts):
                codes[:, position], least = nearest(vectors[:, position], books[position])
                error += least
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kept['vec_id'].dataType.simpleString()}, label {kept['label'].dataType.simpleString()}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, salts: int = 32) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of all kept vectors of ``vectors(vec_id, embedding, label)``, and the codebooks."""
    if entries > 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    scratch = Scratch(vectors.sparkSession)
    whole = whole_numbers(vectors, parts)
    books = fit_codebooks(whole, scratch, parts, entries, rounds, salts)
    if books is None:
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    return scratch.save(encode(whole, books), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together (null beyond 64 bits); a label's rows are never gathered."""
    label = codes.groupBy(F.col("label").alias("_l")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(label, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")
