"""Near-duplicates by a multi-index Hamming join of b-bit minhash signatures (operator 9).

A document is its set of hashed word shingles.  Documents of the same set are
one class, and all that follows works on classes, so that copies cost nothing.

A class has a signature of 65 minhash values of 16 bits.  Signatures are cut
into 13 chunks of 5.  By the pigeonhole principle, of two signatures that
differ in at most ``MOST`` = 25 places at least one chunk differs in at most
one place; enumerating each place of each chunk as the one that may differ
gives 65 exact keys a class, and such a pair has one in common.  (Two documents
at a similarity of 0.85 differ in 10 places on average, and in over 25 with a
probability under 1e-6; at 0.80 in 13 and under 1e-4.)

Classes that share a key are compared: only those whose signatures differ in
at most ``MOST`` places become candidates of each other.  A key's classes are
compared outwards from one class, each time with those that none has reached
yet, so that a key of near copies costs one comparison a class; what comes out
are stars around the smallest class of each part that hangs together.

Near copies share most of their keys, which would compare them again and again.
So the keys of the first ``FIRST`` chunks come first, and of the others only
those whose classes the first didn't connect all.  A key of over
``KEY_BLOCK`` classes is dealt to blocks; some pivots of it come to every
block.  Blocks that have a common pivot in their parts are connected by it,
which is mostly all of a family of near copies.  Then, for such keys alone, the classes that are not in the
largest component of their key meet all other blocks of it, so that every
pair of the key is tested or connected.

Candidates that hang together are a group.  Their links are confirmed on the
full sets, in two rounds.  First groups are dealt to blocks of bounded size, and
some pivots of a group come to each of its blocks; in a block every pair is
tested.  Mostly all of a group is linked then.  Where it isn't, and the group
has several blocks, the classes outside of its largest component meet all others.
All tasks together have tested every pair of a group that no links connect.

Texts that are null or without words are empty: 0 shingles, linked with
nothing.  With fewer words than a shingle has, the whole sequence is the one
shingle.  Rows that repeat an identifier and a text get the same result each;
rows of one identifier and different texts are judged by their own texts;
rows with a null identifier belong to the class of their set, and a class without
any identifier takes no part in links and has a null component.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import components, joinable, settled, with_checkpoints
from stocktake.llm._rows import by_group, groups, narrow, stream
from stocktake.llm._shingles import mix, shingle_sets

CHUNKS, CHUNK = 13, 5
PLACES = CHUNKS * CHUNK
#: Places in which the signatures of candidates may differ.
MOST = 2 * CHUNKS - 1
#: Classes of a key that are compared with each other in one task, and pivots that come to each block of a larger key (on average).
KEY_BLOCK, KEY_PIVOTS = 4096, 32
#: Chunks whose keys come first.
FIRST = 2
#: Shingles of a block of a group, and pivots that come to each block (on average).
BLOCK_SHINGLES, PIVOTS = 200_000, 32

_SEEDS = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_NODE = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6A09E667F3BCC909))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bits of the minimum under each permutation, for non-empty sets that stand one after another."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), PLACES), np.uint64)
    for k in range(PLACES):
        out[:, k] = np.minimum.reduceat((hashes ^ _SEEDS[k]) * np.uint64(0x9FB21C651E98DF25 + 2 * k), starts)
    return (mix(out) & np.uint64(0xFFFF)).astype(np.uint16)


def keys(signature: np.ndarray) -> np.ndarray:
    """All keys of each signature: a chunk's number, the place left out, and the four other values, hashed."""
    chunks = signature.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(signature), CHUNKS, CHUNK), np.uint64)
    for free in range(CHUNK):
        h = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(free))[None, :]
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for c in range(CHUNK):
            if c != free:
                packed = (packed << np.uint64(16)) | chunks[:, :, c]
        out[:, :, free] = mix(packed ^ mix(h + np.uint64(1)))
    return out.reshape(len(signature), PLACES).view(np.int64)


def nodes(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """128 bits for each set that stand for it, null for an empty one."""
    full = sizes > 0
    out = np.zeros((len(sizes), 2), np.uint64)
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, seed in enumerate(_NODE):
            out[full, k] = np.add.reduceat(mix(hashes ^ seed), starts)
    return _binary(out.view(np.uint8), ~full)


def _binary(rows: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as an Arrow array."""
    flat = pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
    return flat if null is None else pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), flat)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a column without nulls whose values all have ``width`` bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, node, low, high``: the node is a hash of the whole set, null without shingles; the lower and upper bytes of the signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in groups(texts):
                hashes, sizes = shingle_sets(texts[a:b], width)
                full = sizes > 0
                found = np.zeros((b - a, PLACES), np.uint16)
                if full.any():
                    found[full] = signatures(hashes, sizes[full])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes.astype(np.int64)), nodes(hashes, sizes), *(_binary((found >> np.uint16(k)).astype(np.uint8)) for k in (0, 8))], schema=schema)

    return stream(docs, run, "doc_id long, n_shingles long, node binary, low binary, high binary")


def keyed(classes: DataFrame, first: int, last: int) -> DataFrame:
    """``key, handle, label`` for the keys of some chunks of all classes; the handle is eight bytes of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (last - first) * CHUNK
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                low, high = (_matrix(part.column(c), PLACES).astype(np.uint16) for c in ("low", "high"))
                found = keys(low | high << np.uint16(8))[:, first * CHUNK : last * CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), *(pa.array(np.repeat(part.column(c).to_numpy(), width)) for c in ("handle", "label"))], names=["key", "handle", "label"])

    return stream(classes.select("handle", "label", "low", "high"), run, "key long, handle long, label long")


def parts(low: np.ndarray) -> list[list[int]]:
    """What hangs together by pairs of signatures (their lower bytes) that differ in at most ``MOST`` places; parts of one are left out."""
    out: list[list[int]] = []
    left = np.arange(len(low))
    while len(left):
        part, left = [int(left[0])], left[1:]
        queue = [part[0]]
        while queue and len(left):
            near = (low[left] != low[queue.pop()]).sum(axis=1) <= MOST
            if near.any():
                reached = left[near].tolist()
                part += reached
                queue += reached
                left = left[~near]
        if len(part) > 1:
            out.append(part)
    return out


def compared(tiles: DataFrame) -> DataFrame:
    """``a, b``: stars of what hangs together in each tile (``key, one, two``) of rows with ``node, low``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def edges(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            names, found = table.column("node").to_pylist(), set()
            low = _matrix(table.column("low"), PLACES)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for part in parts(low[a:b]):
                    own = [names[a + x] for x in part]
                    centre = min(own)
                    found.update((centre, y) for y in own if y != centre)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            change = np.zeros(table.num_rows + 1, bool)
            change[0] = True
            for c in ("key", "one", "two"):
                x = table.column(c).to_numpy()
                change[1:-1] |= x[1:] != x[:-1]
            cuts = np.flatnonzero(change)
            if len(cuts) > 1:
                yield edges(table, cuts)
            # The last key may go on in the next batch.
            held = table.slice(int(cuts[-1])) if table.num_rows else table
        if held is not None and held.num_rows:
            yield edges(held.combine_chunks(), np.array([0, held.num_rows]))

    return stream(tiles.select("key", "one", "two", "node", "low").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two"), compare, "a binary, b binary")


def shared_keys(by_key: DataFrame) -> DataFrame:
    """``key, n, blocks`` of all keys that have classes of different labels; nearly all keys have one class only."""
    shared = by_key.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("top"), F.count(F.lit(1)).alias("n")).where("least <> top")
    return with_checkpoints(shared.select("key", "n", F.ceil(F.col("n") / KEY_BLOCK).alias("blocks")))


def members_of(by_key: DataFrame, shared: DataFrame, side: DataFrame) -> DataFrame:
    """``key, n, blocks, node, low`` of the classes of some keys; of two nodes of one handle both."""
    return by_key.select("key", "handle").join(shared, "key").join(side, "handle").select("key", "n", "blocks", "node", "low")


def tiles_of(members: DataFrame) -> DataFrame:
    """A block for each row, and every block for a pivot; at most ``KEY_PIVOTS`` more rows a block on average."""
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / KEY_PIVOTS)) == 0)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return members.withColumn("one", F.explode(F.when(pivot, every).otherwise(F.array(_block())))).withColumn("two", F.col("one"))


def _block() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("blocks"))


def outside_tiles(members: DataFrame, label: DataFrame) -> DataFrame:
    """Of keys of several blocks whose classes aren't all connected (``node, root``): what is outside of the largest component with each block."""
    many = members.where("blocks > 1").join(label.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    many = with_checkpoints(many)
    counts = many.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.sum("m").alias("all"), F.max("m").alias("most")).where("most < all")
    placed = many.join(joinable(largest.select("key", "largest", F.ceil((F.col("all") - F.col("most")) / KEY_BLOCK).alias("rows"))), "key")
    row, column = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")), _block()
    at = lambda r, c: F.struct(r.alias("one"), c.alias("two"))
    to_all = [F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), f) for k, f in (("blocks", lambda c: at(row, c)), ("rows", lambda r: at(r, column)))]
    places = F.array_distinct(F.concat(F.when(F.col("label") != F.col("largest"), to_all[0]).otherwise(F.array().cast("array<struct<one: bigint, two: bigint>>")), to_all[1]))
    return placed.withColumn("at", F.explode(places)).select("key", "at.one", "at.two", "node", "low")


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """``a, b``: edges that connect all classes with a key in common and signatures that differ in at most ``MOST`` places (or others between them)."""
    side = classes.select("handle", "node", "low")
    early = keyed(classes.withColumn("label", F.col("handle")), 0, FIRST)
    early_keys = shared_keys(early)
    found = settled(compared(tiles_of(members_of(early, early_keys, side))))
    known = classes.join(components(found), "node", "left").withColumn("label", F.xxhash64(F.coalesce("root", "node")))
    late = keyed(known, FIRST, CHUNKS)
    late_keys = shared_keys(late)
    found = settled(found.unionByName(compared(tiles_of(members_of(late, late_keys, side)))))
    # Keys of several blocks are few; all others are done.
    early_keys, late_keys = (k.where("blocks > 1") for k in (early_keys, late_keys))
    if early_keys.isEmpty() and late_keys.isEmpty():
        return found
    large = members_of(early, early_keys, side).unionByName(members_of(late, late_keys, side))
    return found.unionByName(compared(outside_tiles(large, components(found))))


def links(sets: list[np.ndarray], share: int, sides: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (of different ``sides``, if given).

    ``known`` numbers components that are known before.  Two sets link when
    100 * common >= share * together.  Prefix filtering: by a common order,
    rarest first, two such sets share one of the first
    ``n - ceil(share * n) + 1`` shingles; the pairs that do, and aren't
    connected yet, are counted out.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    ids = rank[ids].astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    rows = [np.sort(ids[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
    first = [r[: len(r) - -(-share * len(r) // 100) + 1] for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in first])
    prefix = np.concatenate(first)
    order = np.lexsort((owner, prefix))
    prefix, owner = prefix[order], owner[order]
    cut = np.searchsorted(prefix, np.arange(len(seen) + 1))
    label = np.arange(len(rows)) if known is None else known.copy()
    together: dict[int, list[int]] = {}
    for i, k in enumerate(label.tolist()):
        together.setdefault(k, []).append(i)
    mark, out = np.zeros(len(seen), bool), []
    for x, own in enumerate(rows):
        if len(together) == 1:
            break
        near = np.unique(np.concatenate([owner[cut[p] : cut[p + 1]] for p in first[x]]))
        near = near[near < x]
        fits = (label[near] != label[x]) & (100 * np.minimum(sizes[near], sizes[x]) >= share * np.maximum(sizes[near], sizes[x]))
        near = near[fits] if sides is None else near[fits & (sides[near] != sides[x])]
        mark[own] = True
        while len(near):
            part, near = near[:512], near[512:]
            common = np.add.reduceat(mark[np.concatenate([rows[y] for y in part])], np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            for y in part[100 * common >= share * (sizes[part] + sizes[x] - common)].tolist():
                if label[y] != label[x]:
                    out.append((x, y))
                    # The smaller component takes the name of the larger one.
                    few, many = sorted((int(label[x]), int(label[y])), key=lambda k: len(together[k]))
                    label[together[few]] = many
                    together[many] += together.pop(few)
            near = near[label[near] != label[x]]
        mark[own] = False
    return out


def with_sets(dealt: DataFrame, width: int) -> DataFrame:
    """``dealt`` with each class's ``shingles`` instead of its ``text``."""
    others = [c for c in dealt.columns if c not in ("text", "node")]
    schema = "node binary, shingles array<long>" + "".join(f", {c} {dealt.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("text").to_pylist()
            for a, b in groups(every):
                hashes, sizes = shingle_sets(every[a:b], width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(hashes.view(np.int64)))
                part = batch.slice(a, b - a)
                # Rows of the same identifier and another text aren't of this class.
                own = pa.compute.equal(nodes(hashes, sizes), part.column("node"))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists, *(part.column(c) for c in others)], names=["node", "shingles", *others]).filter(own)

    return stream(dealt.select("node", "text", *others), run, schema)


def _forest_of(part: pa.Table, share: int) -> pa.RecordBatch | None:
    """The links of a block; ``side`` and ``label``, if there, say which pairs aren't wanted."""
    names = part.column("node").to_pylist()
    two = "side" in part.column_names
    # Rows may repeat.
    at = list({(n, s): i for i, (n, s) in enumerate(zip(names, part.column("side").to_pylist() if two else names, strict=True))}.values())
    if len(at) < 2:
        return None
    shingles = part.column("shingles")
    sides = part.column("side").to_numpy()[at] if two else None
    known = np.unique([part.column("label")[i].as_py() for i in at], return_inverse=True)[1] if two else None
    found = links([shingles[i].values.to_numpy().view(np.uint64) for i in at], share, sides, known)
    return pa.RecordBatch.from_arrays([pa.array([names[at[p[s]]] for p in found], pa.binary()) for s in (0, 1)], names=["a", "b"])


def confirmed(docs: DataFrame, members: DataFrame, width: int, share: int) -> DataFrame:
    """``node, root`` of the classes that links connect; ``members`` has ``doc_id, node, root, n_shingles``."""
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"), F.ceil(F.count(F.lit(1)) / PIVOTS).alias("one_of"))
    sized = with_checkpoints(members.join(blocks, "root"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("one_of")) == 0)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    to = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))

    def compare(keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in by_group(batches, keys):
                found = _forest_of(part, share)
                if found is not None:
                    yield found

        return run

    # The texts of the classes in groups, for both rounds; all other texts are shuffled once and go.
    texts = settled(docs.join(sized.select("doc_id", "node", "root", "blocks", "one_of").hint("merge"), "doc_id").drop("doc_id"))
    first = with_sets(texts.select("node", "text", "root", to.alias("to")), width).select("root", F.explode("to").alias("block"), "node", "shingles")
    found = with_checkpoints(stream(first.repartition("root", "block").sortWithinPartitions("root", "block"), compare(["root", "block"]), "a binary, b binary"))
    linked = components(found)

    # Groups of several blocks that aren't one component yet: whatever is outside of the largest meets everything.
    label = sized.where("blocks > 1").join(linked.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = with_checkpoints(label)
    counts = label.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_groups = with_checkpoints(label.join(largest, "root").withColumn("outside", F.col("label") != F.col("largest")))
    if open_groups.isEmpty():
        return linked
    rows = F.ceil(F.sum(F.when(F.col("outside"), F.col("n_shingles"))) / BLOCK_SHINGLES).alias("rows")
    grid = open_groups.join(open_groups.groupBy("root").agg(rows), "root")
    row, column = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")), own
    all_rows, all_columns = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("rows", "blocks"))
    place = lambda r, c, side: F.struct(r.alias("i"), c.alias("j"), F.lit(side).alias("side"))
    outside = F.when(F.col("outside"), F.transform(all_columns, lambda c: place(row, c, 0)))
    places = F.concat(F.coalesce(outside, F.array().cast("array<struct<i: bigint, j: bigint, side: int>>")), F.transform(all_rows, lambda r: place(r, column, 1)))
    second = with_sets(texts.where("blocks > 1").select("node", "text").join(grid.select("node", "root", "label", places.alias("to")), "node"), width).select("root", "label", F.explode("to").alias("at"), "node", "shingles").select("root", "label", "at.*", "node", "shingles")
    more = stream(second.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), compare(["root", "i", "j"]), "a binary, b binary")
    return components(found.unionByName(more))


def near_duplicates(docs: DataFrame, share: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; sets link from ``share`` per cent similarity."""
    rows = narrow(docs, id_col, text_col)
    held = with_checkpoints(shingled(rows, width))
    classes = held.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("low").alias("low"), F.first("high").alias("high"))
    classes = with_checkpoints(classes.withColumn("handle", F.xxhash64("node")))
    members = components(candidate_pairs(classes)).join(classes.select("node", "doc_id", "n_shingles"), "node")
    linked = confirmed(rows, members, width, share)
    least = linked.join(classes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = classes.select("node", "doc_id").join(linked, "node", "left").join(least, "root", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    out = held.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
