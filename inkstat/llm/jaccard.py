"""Self-join of documents on the Jaccard similarity of their word shingles, by T-occurrence search.

A document is the set of its distinct 5-word shingles. Two documents link when
``100 * intersection >= percent * union``; the result is the connected component of each. Exact:
no candidate is dropped without proof, and every link is counted on the whole sets.

1. Shingles found in ``long_list`` texts or more are *long lists*. They are counted over all
   texts; what the tasks keep of them is a bitmap of fixed size (``2**BITS`` bits).
2. Equal sets are one class; only its representative goes on.
3. Representatives that share a MinHash band are compared with a centre of their band: one
   comparison per member, not one per pair. The centre is the member with the largest share of
   shingles in long lists; among many near copies that is the text they were made from, whatever
   its id. Members that it does not reach get further centres (``star_rounds``). Texts whose lists
   then still meet another component are compared with that component's hub, once per component.
   Groups of near copies fall together here.
4. T-occurrence over the cluster: short lists first, then long ones, each set is ordered alike.
   A pair that links shares at least ``turn`` of its first ``n - ceil(0.8 n) + turn`` shingles, so
   only those are dealt out as inverted lists. As in DivideSkip long lists produce no candidates
   unless a pair could reach its overlap T in long lists alone; all others must occur at least
   ``min(turn, T - L)`` times in short ones. Lists give no pair inside one component of step 3.
5. A query's candidates are searched in one go (``divide_skip``): short lists are merged, long
   ones probed by binary search, documents with T occurrences stay.

Nulls: a null text has no shingles; a row without doc_id keeps a null component. Empty texts are
linked with nothing. Rows of the same doc_id are one document with several texts: it links with
whatever one of them links with. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm import text as X
from inkstat.llm.components import components
from inkstat.llm.scratch import Scratch

BITS = 24
BANDS, ROWS = 3, 2
LONG_LIST = 64
FLUSH = 1 << 20
GROUP_ELEMENTS = 500_000
CROWD = 16  # fewer members of a band than this need no further centre
MISSES = 2  # centres in a row that reach nobody before a band gets no other


def overlap(percent: int, na, nb):
    """The smallest intersection with 100 * i >= percent * (na + nb - i)."""
    return F.expr(f"({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent}")


def turns(n: np.ndarray | int):
    """How many shared shingles of their prefixes a pair must show: 1 for short sets, 3 from 48 shingles."""
    return 1 + np.minimum(2, np.asarray(n) // 24)


def bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bits that are set for the values (0 <= v < 2**bits) of a column; 2**bits / 8 bytes, whatever the number of rows."""
    rows = keys.groupBy(F.expr(f"{column} div 32768").alias("part")).agg(F.expr(f"bitmap_construct_agg({column} % 32768)").alias("bits")).collect()
    out = np.zeros(1 << bits, bool)
    for r in rows:
        out[r["part"] * 32768 : (r["part"] + 1) * 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")[: 1 << bits]
    return np.packbits(out)


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def deal(columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Cut columns that are led by a hash at equal ranges of the hash: one packed row per range."""
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    top = columns[0].dtype.itemsize * 8
    edges = [((i << top) + parts - 1) // parts for i in range(1, parts)]
    cuts = [0, *np.searchsorted(columns[0], np.array(edges, columns[0].dtype)).tolist(), len(order)]
    rows = [(i, *(c[a:b].tobytes() for c in columns)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k + 1] for r in rows], pa.binary()) for k in range(len(columns)))], names=["part", *(f"c{k}" for k in range(len(columns)))])


def unpacked(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def long_lists(docs: DataFrame, k: int, least: int, parts: int) -> DataFrame:
    """(at): bitmap positions of the shingles that at least ``least`` texts hold, counted over all texts."""

    def tokens(batches):
        held, size = [], 0
        for batch in batches:
            for piece in X.pieces(batch):
                sets = X.shingle_sets(*X.buffers(piece.column("text")), k)
                held += [(s >> X.U(32)).astype(np.uint32) for s in sets]
                size += sum(map(len, sets))
                if size >= FLUSH:
                    yield from deal([np.concatenate(held)], parts)
                    held, size = [], 0
        if held:
            yield from deal([np.concatenate(held)], parts)

    def frequent(table: pa.Table) -> pa.Table:
        values, counts = np.unique(unpacked(table, "c0", np.uint32), return_counts=True)
        return pa.table({"at": pa.array(np.unique(values[counts >= least] >> np.uint32(32 - BITS)).astype(np.int64))})

    return docs.select("text").mapInArrow(tokens, "part int, c0 binary").groupBy("part").applyInArrow(frequent, "at long")


def profiles(docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """Per row: set size, its shingles in long lists, digest, MinHash bands and ordered prefix."""
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    seeds = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)

    def rows(batches):
        bits = hot.value
        for batch in batches:
            for piece in X.pieces(batch):
                sets = X.shingle_sets(*X.buffers(piece.column("text")), k)
                n, long_n, digests, bands, prefixes = [], [], [], [[] for _ in range(BANDS)], []
                for s in sets:
                    is_long = marked(bits, (s >> X.U(64 - BITS)).astype(np.int64))
                    size = len(s)
                    n.append(size)
                    long_n.append(int(is_long.sum()))
                    digests.append(xxhash.xxh128_digest(s.tobytes()))
                    ordered = np.concatenate([s[~is_long], s[is_long]]) if long_n[-1] else s
                    prefixes.append(ordered[: size - (percent * size + 99) // 100 + int(turns(size))] if size else ordered)
                    least = [int(X.mix(s ^ seed).min()) if size else 0 for seed in seeds]
                    for b in range(BANDS):
                        bands[b].append(hash((b, *least[b * ROWS : (b + 1) * ROWS])))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(long_n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), X.list_column([np.array(x, np.int64) for x in zip(*bands)]), X.list_column(prefixes)],
                    names=["doc_id", "n", "n_long", "d1", "d2", "bands", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, n_long long, d1 long, d2 long, bands array<long>, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, items): whole shingle sets of the wanted documents; and a few others, as a bitmap of ids chooses them."""
    at = F.expr(f"shiftrightunsigned(xxhash64(doc_id), {64 - BITS})")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(at.alias("at")), "at"))

    def rows(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(bits.value, batch.column("at").to_numpy(zero_copy_only=False)))) if batch.num_rows else batch
            for piece in X.pieces(batch):
                sets = X.shingle_sets(*X.buffers(piece.column("text")), k)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), X.list_column(sets)], names=["doc_id", "items"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", at.alias("at")).mapInArrow(rows, "doc_id long, items array<long>")


def divide_skip(query: np.ndarray, members: list[np.ndarray], need: np.ndarray, mu: float = 0.01) -> np.ndarray:
    """For every member whether it occurs in ``need`` or more of the query's inverted lists.

    ``query`` and ``members`` are sorted sets. The ``T / (mu * log2(longest) + 1)`` longest lists are
    put aside; the others are merged in one pass (sorted runs, counted), and a member whose count
    can still reach its threshold is looked up in the long lists by binary search.
    """
    flat = np.concatenate(members) if members else query[:0]
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    at = np.searchsorted(query, flat)
    hit = at < len(query)
    hit[hit] = query[at[hit]] == flat[hit]
    lists, owner = at[hit], owner[hit]
    lengths = np.bincount(lists, minlength=len(query))
    longest = int(lengths.max(initial=0))
    if not longest:
        return np.asarray(need) <= 0
    put_aside = min(len(query), int(max(1, need.min()) / (mu * np.log2(max(2, longest)) + 1)), int(max(1, need.min())) - 1)
    aside = np.zeros(len(query), bool)
    if put_aside > 0:
        aside[np.argsort(-lengths, kind="stable")[:put_aside]] = True
    short = ~aside[lists]
    count = np.bincount(np.sort(owner[short], kind="stable"), minlength=len(members))
    found = np.zeros(len(members), bool)
    probes = query[aside]
    for m in np.flatnonzero(count + len(probes) >= need):
        spot = np.searchsorted(members[m], probes)
        inside = spot < len(members[m])
        found[m] = count[m] + int((members[m][spot[inside]] == probes[inside]).sum()) >= need[m]
    return found


def linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b, n) of different documents, n the size of b's set, whose whole sets reach the similarity.

    A query's candidates are cut into groups of bounded size, so that one hot document is many tasks.
    """
    load = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.expr(f"cast(ceil(sum(n) / {GROUP_ELEMENTS}) AS int)")).alias("groups"))
    dealt = scratch.save(pairs.join(load, "a").select("a", "b", F.expr("pmod(xxhash64(b), groups)").alias("g")), f"{name}-pairs")
    wanted = dealt.select(F.col("a").alias("doc_id")).union(dealt.select("b")).distinct()
    sets = scratch.save(sets_of(docs, wanted, k), f"{name}-sets")  # a few more than wanted; the joins below drop them
    asked = dealt.select("a", "g").distinct().join(sets, F.col("a") == sets.doc_id).select("a", "g", F.lit(None).cast("long").alias("b"), "items")
    offered = dealt.join(sets, dealt.b == sets.doc_id).select("a", "g", "b", "items")

    def search(table: pa.Table) -> pa.Table:
        b = table.column("b").to_pylist()
        col = table.column("items").combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        flat, offs = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
        items = [flat[x:y] for x, y in zip(offs[:-1], offs[1:])]
        members = [i for i, x in enumerate(b) if x is not None]
        kept = set()
        for q in (i for i, x in enumerate(b) if x is None):
            need = np.array([(percent * (len(items[q]) + len(items[i])) + 99 + percent) // (100 + percent) for i in members])
            if len(members):
                kept.update(b[i] for i, ok in zip(members, divide_skip(items[q], [items[i] for i in members], need)) if ok)
        a = table.column("a")[0].as_py()
        return pa.table({"a": pa.array([a] * len(kept), pa.int64()), "b": pa.array(sorted(kept), pa.int64())})

    found = scratch.save(asked.union(offered).groupBy("a", "g").applyInArrow(search, "a long, b long").distinct(), name)
    scratch.drop(f"{name}-pairs", f"{name}-sets")
    return found


def postings(reps: DataFrame, parts: int) -> DataFrame:
    """(token, doc_id) of the prefixes, for tokens that at least two rows hold."""

    def tokens(batches):
        held, size = [], 0
        for batch in batches:
            col = batch.column("prefix")
            held.append((col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy()))))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from deal([np.concatenate(x) for x in zip(*held)], parts)
                held, size = [], 0
        if held:
            yield from deal([np.concatenate(x) for x in zip(*held)], parts)

    def repeated(table: pa.Table) -> pa.Table:
        token, doc = unpacked(table, "c0", np.uint64), unpacked(table, "c1", np.int64)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "doc_id": pa.array(doc[keep])})

    return reps.select("doc_id", "prefix").mapInArrow(tokens, "part int, c0 binary, c1 binary").groupBy("part").applyInArrow(repeated, "token long, doc_id long")


def star_rounds(reps: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between centres of MinHash bands and members of their bands.

    Each round compares every open member with one centre. What a centre does not reach goes on
    with the next one while ``CROWD`` members are left and not more than ``MISSES`` centres in a row
    reached nobody. Rounds only find links early; the search of the lists misses none.
    """
    start = reps.select("doc_id", "n", (F.col("n_long") / F.col("n")).alias("common"), F.explode("bands").alias("band"), F.lit(0).alias("missed"))
    members, found, turn = scratch.save(start, "members-0"), None, 0
    while True:
        best = F.max_by(F.struct("doc_id", "n"), F.struct("common", (-F.col("doc_id")).alias("first"))).alias("c")
        centre = members.groupBy("band").agg(best, F.count("*").alias("m")).where("m > 1").select("band", F.col("c.doc_id").alias("a"), F.col("c.n").alias("a_n"))
        asked = members.join(centre, "band").where("doc_id <> a")
        pairs = asked.where(f"100 * least(n, a_n) >= {percent} * greatest(n, a_n)").select("a", F.col("doc_id").alias("b"), "n").distinct()
        links = linked(pairs, docs, k, percent, scratch, f"stars-{turn}")
        found = links if found is None else found.union(links)
        rest = asked.join(links, (asked.a == links.a) & (asked.doc_id == links.b), "left").select("doc_id", "n", "common", "band", "missed", links.b.isNotNull().alias("won"))
        state = rest.groupBy("band").agg(F.sum(F.expr("int(NOT won)")).alias("left"), F.max("won").alias("any"), F.max("missed").alias("before"))
        goes_on = state.withColumn("missed", F.expr("CASE WHEN any THEN 0 ELSE before + 1 END")).where(f"left >= {CROWD} AND missed <= {MISSES}").select("band", "missed")
        turn += 1
        members = scratch.save(rest.where("NOT won").drop("won", "missed").join(goes_on, "band").select(*start.columns), f"members-{turn}")
        scratch.drop(f"members-{turn - 1}")
        if not members.limit(1).count():
            scratch.drop(f"members-{turn}")
            return found.distinct()


def short_lists(reps: DataFrame, near: DataFrame, percent: int, hot: np.ndarray, parts: int, scratch: Scratch) -> DataFrame:
    """(token, doc_id, n, n_long, comp, is_long): the inverted lists that can produce candidates."""
    known = reps.select("doc_id", "n", "n_long").join(near, reps.doc_id == near.node, "left").select("doc_id", "n", "n_long", F.coalesce("component", "doc_id").alias("comp"))
    # one bit decides whether a list is long; the bitmap goes to the tasks as a broadcast value of fixed size
    bits = reps.sparkSession.sparkContext.broadcast(hot)

    def flag(batches):
        for batch in batches:
            at = (batch.column("token").to_numpy(zero_copy_only=False).view(np.uint64) >> X.U(64 - BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("doc_id"), pa.array(marked(bits.value, at))], names=["token", "doc_id", "is_long"])

    rows = postings(reps, parts).mapInArrow(flag, "token long, doc_id long, is_long boolean").join(known, "doc_id")
    return scratch.save(rows.where(f"NOT is_long OR 100 * n_long >= {percent} * n").distinct(), "rest-lists")


def apart(rows: DataFrame) -> DataFrame:
    """Lists that several components meet in: their main component and whether a row lies apart from it."""
    by_comp = rows.groupBy("token", "comp").count()
    mixed = by_comp.groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("token", "main")
    return rows.join(mixed, "token").withColumn("apart", F.col("comp") != F.col("main"))


def hub_pairs(lists: DataFrame, links: DataFrame, near: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): texts that lie apart in a list, with the best linked text of the list's main component."""
    degree = links.groupBy("a").count()
    hubs = degree.join(near, degree.a == near.node).groupBy(F.col("component").alias("main")).agg(F.max_by("a", F.struct("count", "a")).alias("a"))
    sized = hubs.join(reps.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n")).distinct(), "a")
    return (lists.where("apart").select(F.col("doc_id").alias("b"), "n", "main").distinct().join(sized, "main")
            .where(f"a <> b AND 100 * least(n, a_n) >= {percent} * greatest(n, a_n)").select("a", "b", "n").distinct())


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): pairs of representatives of different components that occur together often enough in the lists."""
    left = lists.where("apart").select("token", "is_long", *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "n_long", "comp")))
    right = lists.select("token", *(F.col(c).alias(f"y_{c}") for c in ("doc_id", "n", "n_long", "comp", "apart")))
    met = left.join(right, "token").where(
        f"x_comp <> y_comp AND x_doc_id <> y_doc_id AND (NOT y_apart OR x_doc_id < y_doc_id) AND 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)"
        f" AND (NOT is_long OR least(x_n_long, y_n_long) >= ({percent} * (x_n + y_n) + {99 + percent}) div {100 + percent})"
    )
    pair = met.select(
        F.expr("least(x_doc_id, y_doc_id)").alias("a"), F.expr("greatest(x_doc_id, y_doc_id)").alias("b"), F.expr("CASE WHEN x_doc_id < y_doc_id THEN y_n ELSE x_n END").alias("n"),
        F.expr("1 + least(2, x_n div 24, y_n div 24)").alias("turn"), (overlap(percent, "x_n", "y_n") - F.least("x_n_long", "y_n_long")).alias("short_need"),
    )
    counted = pair.groupBy("a", "b", "n", "turn", "short_need").count()
    return counted.where("count >= CASE WHEN short_need <= 0 THEN turn ELSE least(turn, short_need) END").select("a", "b", "n").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs(doc_id, text)``; see the module."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark)
    parts = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = bitmap(long_lists(docs, k, long_list, parts), "at")
    rows = scratch.save(profiles(docs, k, percent, hot), "profiles")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = scratch.save(full.join(classes.select("d1", "d2", F.col("rep").alias("doc_id")), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"]), "reps")

    first = star_rounds(reps, docs, k, percent, scratch)
    near = components(first, scratch, "near")
    lists = short_lists(reps, near, percent, hot, parts, scratch)
    hubs = linked(hub_pairs(apart(lists), first, near, reps, percent), docs, k, percent, scratch, "hubs")
    # both ends of a hub's link change to one component; the lists are contracted before pairs are sought
    ends = hubs.join(near.select(F.col("node").alias("a"), F.col("component").alias("a_comp")), "a").join(near.select(F.col("node").alias("b"), F.col("component").alias("b_comp")), "b", "left")
    joined = components(ends.select(F.col("a_comp").alias("a"), F.coalesce("b_comp", "b").alias("b")), scratch, "joined")
    merged = lists.join(joined, lists.comp == joined.node, "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")
    second = linked(candidates(scratch.save(apart(merged), "rest-mixed"), percent), docs, k, percent, scratch, "found")

    owners = scratch.save(full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "rep"), "owners")
    twice = owners.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id", "lo")
    links = first.union(hubs).union(second).union(owners.join(twice, "doc_id").select(F.col("lo").alias("a"), F.col("rep").alias("b")))
    label = components(links, scratch, "all")
    at = owners.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(label, F.col("rep") == label.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(at, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    done = scratch.save(out, "result")
    scratch.drop("profiles", "classes", "reps", "rest-lists", "rest-mixed", "owners", "hubs", "found")
    return done
