"""Near-dedup by MinHash and an LSH forest, links confirmed on full sets.

1. One scan gives each text its set of distinct 4-word shingles (as 64-bit
   hashes), the set's size, a 128-bit key of the set, and a sketch of SKETCH
   bytes, one for each min-hash. Texts of equal sets are one class, which its
   least doc_id stands for; only those go on.
2. The forest has TREES orders of the sketches, each a rotation of the bytes.
   Each order is range-partitioned and sorted. A region of rows that share a
   prefix is divided by one more byte until it holds at most LEAF rows, so the
   depth adapts to each region and a row meets at most LEAF others in an order,
   however many documents there are. Its candidates are the rows next to it,
   which have the longest common prefixes, and of its leaf the row that its sketch
   agrees with most, and the most alike of those before it, so that the alike rows
   of a leaf hang together; all agree in MATCHES bytes or more.
3. Candidates are confirmed on full sets: 100 * intersection >= 80 * union.
4. What the forest left out (at the ends of leaves and partitions, or by chance) is
   found exactly: of each class the prefix of its set's rarest shingles that a
   similar set must meet (n - ceil(0.8 n) + 1 of n) is dealt by shingle, and where
   a shingle's classes are of different components, all pairs between these whose
   sizes, places and bitmaps leave room for a link are confirmed on full sets.
   Rarity is counted over all texts; as any order of shingles gives the same
   links, it and all constants above decide the time only. A shingle of very many
   prefixes is compared in cells of about BLOCK classes a side.
5. Confirmed links make components.

Words are what lies between ASCII white space after lower-casing A-Z. Defined
cases: fewer than four words make one shingle of all of them; without words (or
text) the set is empty, links with nothing and is its own component; equal sets
are always linked, equal texts the more so; shingles are told apart by 64-bit
hashes, in full sets too; rows that repeat a doc_id are one node; a null doc_id joins the class of its set, and where no row of that set has
an id it is compared with nothing, has a null component and stays; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.components import connected_components
from usagebook.llm.shared import free_names, id_and_text, stored, table
from usagebook.llm.textvec import ASCII_SPACES, as_bytes, byte_mask, chunks, hash_spans, lower_ascii, mix, ngrams, words

SHINGLE = 4
THRESHOLD = 80  # per cent
SKETCH = 64
TREES = 16
#: Bytes that two rows of an order must share at least, and the rows of a region that is not divided further.
DEPTH, LEAF = 2, 32
#: Rows of a region that a task holds until the region ends.
HELD = 1 << 16
#: At a similarity of 0.8 a sketch agrees in 51 of 64 bytes on average, with a deviation of 3.2.
MATCHES = 38
#: Rows up to which a side (of 16 bytes a row) is broadcast; beyond, Spark chooses the join.
BROADCAST_IDS = 1_000_000
#: Shingles in a range that is counted at once; the most frequent shingles, up to COMMON, go last in the order of prefixes.
RANGE, COMMON, BLOCK = 1 << 19, 250_000, 1024

_IS_WORD = ~byte_mask(ASCII_SPACES)
_RNG = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _RNG.integers(1, 2**64 - 1, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64 - 1, SKETCH, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and each text's number of them."""
    buf = lower_ascii(buf)
    starts, ends, counts = words(buf, offsets, _IS_WORD)
    hashes = hash_spans(buf, starts, ends)
    texts = np.repeat(np.arange(len(counts)), counts)
    found, at = ngrams(hashes, counts, n)
    parts, owners = [found], [texts[at]]
    for k in range(1, n):  # shorter texts are one shingle
        short = counts[texts] == k
        found, at = ngrams(hashes[short], counts[counts == k], k)
        parts.append(found)
        owners.append(texts[short][at])
    found, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=len(counts))


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary column from a matrix of bytes."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = as_bytes(batch.column(1))
        for i, j, b, o in chunks(buf, offsets):
            found, sizes = shingle_sets(b, o)
            full = sizes > 0
            begins = (np.cumsum(sizes) - sizes)[full]
            keys, bytes_ = np.zeros((j - i, 2), np.uint64), np.zeros((j - i, SKETCH), np.uint8)
            if len(begins):
                keys[full, 0] = np.add.reduceat(found, begins)
                keys[full, 1] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), begins)
                for k in range(SKETCH):
                    least = np.minimum.reduceat((found * _MULTIPLY[k] + _ADD[k]) >> np.uint64(16), begins)
                    bytes_[full, k] = (mix(least) >> np.uint64(24)).astype(np.uint8)
            made = [pa.array(sizes, pa.int64()), fixed(keys.view(np.uint8).reshape(j - i, 16)), fixed(bytes_)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made, batch.column(2).slice(i, j - i)], ["doc_id", "n_shingles", "set_key", "sketch", "text_hash"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, sketch, text_hash of each row of (doc_id, text, text_hash)."""
    return docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, sketch binary, text_hash long")


def leaves(common: np.ndarray, width: int) -> np.ndarray:
    """The leaf of each row of an order, -1 for rows of more than LEAF equal keys. common: the bytes that a row shares with the one before."""
    leaf, base = np.full(len(common), -1, np.int64), 0
    for depth in range(DEPTH, width + 1):
        region = np.cumsum(common < depth)
        small = (leaf < 0) & (np.bincount(region)[region] <= LEAF)
        leaf[small] = base + region[small]
        base += len(common) + 1
        if (leaf >= 0).all():
            break
    return leaf


def neighbours(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs a < b of rows in the order of their sketches, each pair once."""
    n = len(ids)
    differ = keys[1:] != keys[:-1]
    common = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), SKETCH))) if n else np.zeros(0, np.int64)
    leaf = leaves(common, SKETCH)
    best, partner = np.full((2, n), MATCHES - 1, np.int64), np.zeros((2, n), np.int64)  # of all rows of the leaf, and of those before
    beside = np.flatnonzero(common[1:] >= DEPTH)
    beside = beside[(keys[beside] == keys[beside + 1]).sum(1) >= MATCHES]
    rows, others = [beside], [beside + 1]
    for step in range(1, LEAF):
        near = np.flatnonzero((leaf[step:] == leaf[:-step]) & (leaf[step:] >= 0))
        if not len(near):
            break
        agree = (keys[near] == keys[near + step]).sum(1)
        near, agree = near[agree >= MATCHES], agree[agree >= MATCHES]
        for k, row, other in ((0, near, near + step), (0, near + step, near), (1, near + step, near)):
            better = agree > best[k, row]
            best[k, row[better]], partner[k, row[better]] = agree[better], other[better]
    for k in (0, 1):
        row = np.flatnonzero(best[k] >= MATCHES)
        rows.append(row)
        others.append(partner[k, row])
    a, b = ids[np.concatenate(rows)], ids[np.concatenate(others)]
    one = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)))[:, a != b], axis=1)
    return one[0], one[1]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of rows (tree, id, sketch) in the order of (tree, sketch)."""
    ids, keys, last = np.zeros(0, np.int64), np.zeros((0, SKETCH), np.uint8), None

    def pairs(ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in neighbours(ids, keys)], ["a", "b"])

    for batch in batches:
        trees = batch.column(0).to_numpy()
        for tree in np.unique(trees):
            at = np.flatnonzero(trees == tree)
            if tree != last and len(ids):
                yield pairs(ids, keys)
                ids, keys = ids[:0], keys[:0]
            last = tree
            ids = np.concatenate((ids, batch.column(1).to_numpy()[at]))
            keys = np.concatenate((keys, as_bytes(batch.column(2))[0].reshape(-1, SKETCH)[at]))
            # the last region may go on in the next batch
            region = int((keys[:, :DEPTH] != keys[-1, :DEPTH]).any(1).sum())
            done = len(ids) if len(ids) - region > HELD else region
            if done:
                yield pairs(ids[:done], keys[:done])
                ids, keys = ids[done:], keys[done:]
    if len(ids):
        yield pairs(ids, keys)


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) with a < b: the forest's candidates among (id, sketch)."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = SKETCH // TREES
    orders = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.concat(F.expr(f"substring(sketch, {t * step + 1})"), F.expr(f"substring(sketch, 1, {t * step})")).alias("key")) for t in range(TREES)]))
    ordered = classes.select("id", orders.alias("of")).select("of.tree", "id", "of.key").repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    return ordered.mapInArrow(_neighbours, "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = as_bytes(batch.column(1))
        for i, j, b, o in chunks(buf, offsets):
            found, sizes = shingle_sets(b, o)
            cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32) * 8
            sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(found))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sets], ["id", "shingles"])


def _counts(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text): the shingles of a chunk of texts in ascending order, and in how many of its texts each is, by ranges of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b, o in chunks(*as_bytes(batch.column(1))):
                found, n = np.unique(shingle_sets(b, o)[0], return_counts=True)
                own = (found >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
                cuts = np.append(first, len(own)).astype(np.int32)
                packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts * np.int32(x.itemsize)), pa.py_buffer(x)]) for x in (found, n.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(own[first].astype(np.int64)), *packed], ["range", "shingles", "counts"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    """A range's shingles that are in two texts or more, and in how many."""
    shingle, n = (np.frombuffer(as_bytes(group.column(c))[0], kind) for c, kind in (("shingles", np.uint64), ("counts", np.uint32)))
    order = np.argsort(shingle)
    shingle = shingle[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(shingle)), bool), shingle[1:] != shingle[:-1])))
    total = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    keep = total > 1
    return pa.table({"shingle": shingle[first[keep]].view(np.int64), "n": total[keep]})


def shingle_counts(texts: DataFrame, total: int) -> DataFrame:
    """(shingle, n): the shingles of two texts or more of (doc_id, text), whose sets have `total` elements in all."""
    dealt = texts.mapInArrow(_counts(max(1, -(-total // RANGE))), "range long, shingles binary, counts binary")
    return dealt.groupBy("range").applyInArrow(_summed, "shingle long, n long")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if min(len(x), len(y)) * 100 >= max(len(x), len(y)) * THRESHOLD:
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep[k] = 100 * both >= THRESHOLD * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similar sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(_confirm, "a long, b long")


def frequent(counts: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of (shingle, n), no more than `most`, in the order of their hashes, and their n.

    Counts are taken by their logarithm, without a top, and inside that by a byte of
    the hash; so where not all shingles of about one frequency fit, a share of them
    is taken. About 60,000 numbers come to the driver at most.
    """
    level = counts.select("shingle", "n", F.floor(F.log2("n") * 4).cast("long").alias("level"), F.pmod(F.xxhash64("shingle"), F.lit(256)).alias("part"))
    last, kept = None, 0
    for r in sorted(level.groupBy("level", "part").count().collect(), key=lambda r: (-r["level"], r["part"])):
        kept += r["count"]
        if kept > most:
            break
        last = r
    chosen = level.where("false") if last is None else level.where((F.col("level") > last["level"]) | ((F.col("level") == last["level"]) & (F.col("part") <= last["part"])))
    found = chosen.select("shingle", "n").toArrow()
    hashes, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _looked_up(found: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each hash found; 0 for those that have none."""
    if not len(hashes):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return np.where(hashes[at] == found, values[at], 0)


_ENTRIES = "shingle long, id long, component long, place int, size int"


def _prefixes(common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, component, text): the prefix of each set in the order of (frequency, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = common.value
        for batch in batches:
            ids, components = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, offsets = as_bytes(batch.column(2))
            for i, j, b, o in chunks(buf, offsets):
                found, sizes = shingle_sets(b, o)
                owner = np.repeat(np.arange(j - i), sizes)
                order = np.argsort((owner << 32) + np.minimum(_looked_up(found, hashes, counts), 2**32 - 1), kind="stable")  # a text's hashes are sorted
                place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place < (sizes - (sizes * THRESHOLD + 99) // 100 + 1)[owner]
                shingle, owner, place = found[order][keep], owner[keep], place[keep]
                columns = shingle.view(np.int64), ids[i:j][owner], components[i:j][owner], place.astype(np.int32), sizes[owner].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "id", "component", "place", "size"])

    return run


def in_cells(entries: DataFrame) -> DataFrame:
    """(shingle, cell, id, component, place, size): entries in cells, so that any two of one shingle and two components share a cell.

    The entries of a shingle's largest component need not meet each other: they are
    dealt to blocks of about BLOCK, and so are those of all others; each block of
    the former meets each of the latter, and those meet each other. So the entries
    of a shingle that one component has alone are not written at all, and those
    of a component that nearly has it alone about once.
    """
    by_component = entries.groupBy("shingle", "component").count()
    heavy = by_component.groupBy("shingle").agg(F.sum("count").alias("n"), F.max_by("component", "count").alias("first"), F.max("count").alias("most")).where(F.col("n") > BLOCK)
    heavy = stored(heavy.select("shingle", "first", F.ceil(F.col("most") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("others")), "heavy")
    if heavy.count() <= BROADCAST_IDS:
        heavy = F.broadcast(heavy)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    blocks, others = F.col("blocks"), F.col("others")
    of_first, own = F.pmod(F.xxhash64("id"), blocks), F.pmod(F.xxhash64("id"), F.greatest(others, F.lit(1)))
    # cells of a block of the first component and one of others, then cells of two blocks of others
    with_first = lambda first, other: first * others + other
    among = lambda x: blocks * others + F.least(own, x) * others + F.greatest(own, x)
    cells = F.when(F.col("first").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("component") == F.col("first"), F.transform(up_to(others), lambda o: with_first(of_first, o)))
    cells = cells.otherwise(F.concat(F.transform(up_to(blocks), lambda b: with_first(b, own)), F.transform(up_to(others), among)))
    return entries.join(heavy, "shingle", "left").select("shingle", F.explode(cells).alias("cell"), "id", "component", "place", "size")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries in the order of (shingle, cell): the pairs (a, b) of one cell and two components that may be similar."""
    held: list[np.ndarray] = []

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingle, cell, ids, component, place, size = rows
        begins = np.flatnonzero(np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (cell[1:] != cell[:-1]))))
        mixed = np.minimum.reduceat(component, begins) != np.maximum.reduceat(component, begins)
        lengths = np.diff(np.append(begins, len(ids)))
        group = np.repeat(np.arange(len(begins)), lengths)[keep := np.repeat(mixed, lengths)]
        ids, component, place, size = ids[keep], component[keep], place[keep].astype(np.int64), size[keep].astype(np.int64)
        row, step, found, many = np.arange(len(ids)), 0, [], 0
        while len(row):
            step += 1
            row = row[row + step < len(ids)]
            row = row[group[row] == group[row + step]]
            other = row + step
            # at the first shingle that both have, they share no more than what either has from there on
            room = np.minimum(size[row] - place[row], size[other] - place[other]) * (100 + THRESHOLD) >= (size[row] + size[other]) * THRESHOLD
            near = room & (component[row] != component[other])
            a, b = ids[row[near]], ids[other[near]]
            found.append(np.stack((np.minimum(a, b), np.maximum(a, b))))
            many += len(a)
            if many > 500_000 or not len(row):
                one = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1])], ["a", "b"])
                found, many = [], 0

    for batch in batches:
        if not len(batch):
            continue
        rows = [c.to_numpy() for c in batch.columns]
        rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].sum() + 1) if rows[0][0] != rows[0][-1] or rows[1][0] != rows[1][-1] else 0
        held = [c[last:] for c in rows]
        if last:
            yield from pairs([c[:last] for c in rows])
    if held:
        yield from pairs(held)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, bits): a bit for each residue of the set's hashes by a power of two of at least its size, set where their number is odd."""
    for batch in batches:
        buf, offsets = as_bytes(batch.column(1))
        for i, j, b, o in chunks(buf, offsets):
            found, sizes = shingle_sets(b, o)
            width = 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
            ends, owner = np.cumsum(width), np.repeat(np.arange(j - i), sizes)
            at = (ends - width)[owner] + (found & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
            bits = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8))
            cuts = np.concatenate(([0], ends // 8)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(bits)])], ["id", "size", "bits"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        odd = np.zeros(len(batch), np.int64)  # no more than the shingles that just one of the two has
        for k, (x, y) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            n = min(len(x), len(y))
            odd[k] = np.bitwise_count(np.bitwise_xor.reduce(np.concatenate((x, y)).reshape(-1, n))).sum()
        keep = odd * (100 + THRESHOLD) <= sizes * (100 - THRESHOLD)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def possible(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs (a, b) without those whose bitmaps differ in more places than a link's sets can."""
    left, right = (bitmaps.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("size"), "bits_a", "bits_b")
    return both.mapInArrow(_possible, "a long, b long").distinct()


def with_remainder(texts: DataFrame, classes: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """labels (node, component), joined by all links between different components. total: the elements of all sets."""
    heads = classes.where("id is not null").join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component")).distinct()
    heads = stored(heads, "heads")
    if heads.count() <= BROADCAST_IDS:
        heads = F.broadcast(heads)
    named = texts.join(heads, F.col("doc_id") == F.col("id")).select("id", "component", "text")
    common = texts.sparkSession.sparkContext.broadcast(frequent(stored(shingle_counts(texts, total), "counts")))
    entries = stored(named.mapInArrow(_prefixes(common), _ENTRIES), "entries")
    dealt = in_cells(entries).repartition("shingle", "cell").sortWithinPartitions("shingle", "cell")
    pairs = stored(dealt.mapInArrow(_meet, "a long, b long").distinct(), "remainder")
    if pairs.isEmpty():
        return labels
    pairs = stored(possible(pairs, full_sets(texts, pairs, _bitmaps, "id long, size long, bits binary")), "possible")
    links = stored(confirmed(pairs, full_sets(texts, pairs)), "links")
    return connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def full_sets(texts: DataFrame, pairs: DataFrame, form=_sets, schema: str = "id long, shingles binary") -> DataFrame:
    """(id, shingles) of the texts in pairs, or another form of their sets."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stored(texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(form, schema), "sets")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: one row for each row of docs."""
    texts = id_and_text(docs, doc_id, text)
    rows = stored(sketches(texts.withColumn("text_hash", F.xxhash64("text"))), "sketches")
    classes = stored(rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    pairs = stored(candidates(classes.where("id is not null")), "pairs")
    links = stored(confirmed(pairs, full_sets(texts, pairs)), "links")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    labels = with_remainder(texts, classes, stored(connected_components(links), "labels"), total)
    heads = stored(classes.join(labels, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("component", "id").alias("component")), "components")
    # both sides of this join are plain shuffles, so that adaptive execution divides a large group of equal sets; empty sets don't take part
    named = rows.where("n_shingles > 0").join(heads, "set_key", "left").select("doc_id", "n_shingles", "component", "text_hash")
    every = named.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long"), "text_hash"))
    component = F.coalesce("component", "doc_id")
    return every.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those whose component has a smaller doc_id."""
    ident, own = free_names(docs, "gone_id", "gone_hash")  # any other column may be called anything
    gone = near_duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias(ident), F.col("text_hash").alias(own)).distinct()
    same = docs[doc_id].cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == F.col(own))
    return docs.join(gone, same, "left_anti")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
