"""Weights of terms by packed postings: what moves is a few bytes for each term of a text.

A task reads its texts in chunks, numbers their words and bigrams, and writes for every bucket of terms one row: the sorted terms
and, for each, the texts that hold it and how often, all deflated. A bucket is then read whole by one task, which counts the texts of
each term, gives out the weights of the terms asked for, and adds up the squares of all weights by text.
Buckets grow in number with the texts, not in size; terms are compared as text, hashes only deal them out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WORDS, CHUNK_TEXTS = 700_000, 60_000  # texts of a chunk are numbered in 16 bits
BUCKET_CHARS, TASK_CHARS = 12_000_000, 128_000_000
HELD_SUMS, OUT_ROWS, BATCH_ROWS = 1_000_000, 50_000, 200
PACKED = "bucket int, wanted boolean, terms binary, sizes binary, ids binary, texts binary, tfs binary"


def _hashes(words):
    import zlib

    import numpy as np

    return np.array([zlib.crc32(w.encode()) + 1 for w in words], dtype=np.uint64)


def _bucket(first, second, buckets: int):
    """Bucket of a term from the hashes of its words; the second of a single word is 0."""
    import numpy as np

    x = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    return (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pack_terms(rows: DataFrame, buckets: int, chunk: int = CHUNK_WORDS) -> DataFrame:
    """Packed postings of rows (doc_id, w): the words of the texts of an id, one list for each text."""
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def packed(ids, texts, words):
        """Rows of a chunk: ``texts`` has the number of texts of each id, ``words`` the lists of words of all texts."""
        n = len(ids)
        lengths = np.concatenate([w.value_lengths().to_numpy(zero_copy_only=False) for w in words])
        coded = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        known, rank = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
        code, size = rank[coded.indices.to_numpy(zero_copy_only=False)], len(known) + 1
        if not len(code):
            return
        text = np.repeat(np.arange(len(lengths)), lengths)
        doc = np.repeat(np.repeat(np.arange(n), texts), lengths)
        pair = text[1:] == text[:-1]
        terms = np.concatenate([code * size, (code[:-1] * size + code[1:] + 1)[pair]])  # a word, and a word with the next one
        terms *= n
        terms += np.concatenate([doc, doc[:-1][pair]])
        del coded, code, text, doc, pair
        held, tf = np.unique(terms, return_counts=True)
        del terms
        term, doc = held // n, (held % n).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(term)]]))
        first, second = term[starts] // size, term[starts] % size
        hashes = _hashes(known.to_pylist())
        to = _bucket(hashes[first], np.where(second > 0, hashes[second - 1], np.uint64(0)), buckets)
        order = np.argsort(to, kind="stable")
        to, starts, sizes, first, second = to[order], starts[order], sizes[order], first[order], second[order]
        ends = np.cumsum(sizes)
        at = np.arange(len(term)) + np.repeat(starts - (ends - sizes), sizes)
        doc, tf = doc[at], np.minimum(tf[at], 2**32 - 1).astype(np.uint32)
        follow = pc.if_else(pa.array(second > 0), pc.binary_join_element_wise(pa.scalar(""), known.take(pa.array(np.maximum(second - 1, 0))), " "), pa.scalar(""))
        printed = pc.binary_join_element_wise(known.take(pa.array(first)), follow, "\n", "")
        offsets, data = np.frombuffer(printed.buffers()[1], dtype=np.int32), memoryview(printed.buffers()[2])
        if pa.types.is_integer(ids.type) and not ids.null_count:
            numbers = ids.to_numpy(zero_copy_only=False)
            ids = pa.array(np.diff(numbers, prepend=numbers.dtype.type(0)), ids.type)  # steps of ids in a row deflate to little
        given = zlib.compress(pa.record_batch([ids], names=["doc_id"]).serialize().to_pybytes(), 1)
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        for a, b in zip(cuts, cuts[1:]):
            x, y = ends[a] - sizes[a], ends[b - 1]
            yield [int(to[a]), False, zlib.compress(data[offsets[a]:offsets[b]], 6), zlib.compress(sizes[a:b].astype(np.uint32).tobytes(), 1), given,
                   zlib.compress(doc[x:y].tobytes(), 1), zlib.compress(tf[x:y].tobytes(), 1)]

    def run(batches):
        ids, texts, words, held = [], [], [], 0

        def flush():
            for row in packed(pa.concat_arrays(ids), np.concatenate(texts), words):
                yield _batch([row])

        for batch in batches:
            sizes = np.cumsum([0, *pc.list_value_length(batch.column(1)).fill_null(0).to_pylist()])
            inner = batch.column(1).flatten()
            ends = np.cumsum([0, *pc.list_value_length(inner).to_pylist()])[sizes]  # words up to each row
            at = 0
            while at < batch.num_rows:
                room = min(CHUNK_TEXTS - sum(len(x) for x in ids), batch.num_rows - at)
                stop = min(at + room, max(at + 1, int(np.searchsorted(ends, ends[at] + chunk - held, side="right")) - 1))
                ids.append(batch.column(0).slice(at, stop - at))
                texts.append(np.diff(sizes[at:stop + 1]))
                words.append(inner.slice(sizes[at], sizes[stop] - sizes[at]))
                held, at = held + int(ends[stop] - ends[at]), stop
                if held >= chunk or sum(len(x) for x in ids) >= CHUNK_TEXTS or at < batch.num_rows:
                    yield from flush()
                    ids, texts, words, held = [], [], [], 0
        if ids:
            yield from flush()

    return rows.mapInArrow(run, PACKED)


def _batch(rows):
    import pyarrow as pa

    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "wanted", "terms", "sizes", "ids", "texts", "tfs"])


def pack_wanted(terms: DataFrame, buckets: int) -> DataFrame:
    """Rows for the terms asked for, beside the packed postings of their buckets."""
    import zlib

    import numpy as np

    def run(batches):
        for batch in batches:
            given = [x for x in batch.column(0).to_pylist() if x is not None]
            parts = [x.split(" ", 1) for x in given]
            to = _bucket(_hashes([p[0] for p in parts]), np.array([zlib.crc32(p[1].encode()) + 1 if len(p) > 1 else 0 for p in parts], dtype=np.uint64), buckets)
            by: dict = {}
            for k, x in zip(to.tolist(), given):
                by.setdefault(k, []).append(x + "\n")
            if by:
                yield _batch([[k, True, zlib.compress("".join(x).encode(), 1), *[b""] * 4] for k, x in by.items()])

    return terms.mapInArrow(run, PACKED)


def raw_weights(packed: DataFrame, ids, n: int, min_df: int) -> DataFrame:
    """(doc_id, term, w) before lengths are taken for the terms asked for; rows without a term have sums of squares over all terms.

    ``packed`` has whole buckets in a task, in order, what is asked for first. ``ids`` is the field of doc_id.
    """
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", ids.dataType), StructField("term", StringType()), StructField("w", DoubleType())])
    arrow = to_arrow_schema(schema)
    given = pa.schema([pa.field("doc_id", arrow[0].type)])
    numbers = lambda blobs, kind: np.concatenate([np.frombuffer(zlib.decompress(b), dtype=kind) for b in blobs])
    listed = lambda blob: pa.array(zlib.decompress(blob).decode().split("\n")[:-1], pa.string())

    def listed_ids(blob):
        ids = pa.ipc.read_record_batch(pa.py_buffer(zlib.decompress(blob)), given).column(0)
        return pa.array(np.cumsum(ids.to_numpy(zero_copy_only=False), dtype=ids.type.to_pandas_dtype()), ids.type) if pa.types.is_integer(ids.type) and not ids.null_count else ids

    def weighed(wanted, rows):
        """Weights asked for and sums of squares by text, of one bucket."""
        coded = pa.concat_arrays([listed(r["terms"]) for r in rows]).dictionary_encode()
        sizes = numbers([r["sizes"] for r in rows], np.uint32).astype(np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        df = np.bincount(code, weights=sizes, minlength=len(coded.dictionary))
        idf = np.where(df >= min_df, np.log((1 + n) / (1 + df)) + 1, 0.0)
        code = np.repeat(code, sizes)
        w = np.log(numbers([r["tfs"] for r in rows], np.uint32))
        w += 1
        w *= idf[code]
        docs = [listed_ids(r["ids"]) for r in rows]
        at = [np.frombuffer(zlib.decompress(r["texts"]), dtype=np.uint16).astype(np.int32) for r in rows]
        at = np.concatenate([a + base for a, base in zip(at, np.cumsum([0, *(len(d) for d in docs)]))])
        docs = pa.concat_arrays(docs)
        sums = pa.table({"doc_id": docs, "w": np.bincount(at, weights=w * w, minlength=len(docs))})
        asked = pc.is_in(coded.dictionary, pa.concat_arrays(wanted)).to_numpy(zero_copy_only=False) if wanted else np.zeros(len(df), dtype=bool)
        asked &= df >= min_df
        kept = np.flatnonzero(asked[code])
        return (docs.take(pa.array(at[kept])), coded.dictionary.take(pa.array(code[kept])), pa.array(w[kept])), sums

    def run(batches):
        wanted, rows, bucket, sums = [], [], None, []

        def added():
            t = pa.concat_tables(sums)
            return pa.TableGroupBy(t, "doc_id", use_threads=False).aggregate([("w", "sum")]).select(["doc_id", "w_sum"]).rename_columns(["doc_id", "w"])

        def out(columns):
            for at in range(0, len(columns[0]), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(at, OUT_ROWS).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        def close():
            nonlocal sums
            if rows:
                kept, more = weighed(wanted, rows)
                sums.append(more)
                if sum(len(s) for s in sums) > HELD_SUMS:
                    sums = [added()]
                    if len(sums[0]) > HELD_SUMS:
                        yield from total()
                        sums = []
                yield from out(kept)

        def total():
            t = added().combine_chunks()
            ids, w = (c.combine_chunks() for c in t.columns)
            yield from out((ids, pa.nulls(len(ids), pa.string()), w))

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["bucket"] != bucket:
                    yield from close()
                    wanted, rows, bucket = [], [], row["bucket"]
                if row["wanted"]:
                    wanted.append(listed(row["terms"]))
                else:
                    rows.append(row)
        yield from close()
        if sums:
            yield from total()

    return packed.mapInArrow(run, schema)


def weights_of(docs: DataFrame, rows: DataFrame, terms: DataFrame, min_df: int, chunk: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, term, w) of ``terms``, l2-normalized over all terms; ``rows`` are the words of ``docs`` by id (see ``pack_terms``)."""
    session = docs.sparkSession
    if int(session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:  # a row is a text, or the postings of a chunk in a bucket
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    count = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    tasks = max(session.sparkContext.defaultParallelism, math.ceil(count["chars"] / TASK_CHARS))
    buckets = tasks * max(1, math.ceil(count["chars"] / tasks / BUCKET_CHARS))
    packed = pack_terms(rows, buckets, chunk).unionByName(pack_wanted(terms.select("term").distinct(), buckets))
    packed = packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", F.desc("wanted"))
    raw = raw_weights(packed, docs.schema["doc_id"], count["n"], min_df)
    squares = F.sum(F.when(F.col("term").isNull(), F.col("w"))).over(Window.partitionBy("doc_id"))
    return raw.withColumn("length", F.sqrt(squares)).where(F.col("term").isNotNull()).select("doc_id", "term", (F.col("w") / F.col("length")).alias("w"))
