"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import CACHES, WordHashes, byte_words, durable, groups, mix, rows_of, use
from reapline.llm.components import components

SIGNATURE = 384  # coordinates of a signature, at most
SKETCH = 192  # coordinates kept, one byte each, to look at pairs of crowded buckets
UNIVERSE = 1 << 22  # length of the two permutations
BLOCK = 1024  # members of a crowded bucket that meet in one group
FILTER_BITS = 1 << 24  # of the bitmap that keeps most texts not needed out of the shuffle
BLOCK_SHINGLES = 1 << 21  # shingles of the left members of such a group, about
STAR = 256  # texts compared with one hub in one group

_HASHES = WordHashes()
CACHES.append(_HASHES)


def banding(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """(rows of a band, bands): the longest bands, and as few, that miss a pair at the threshold at most so often."""
    t = percent / 100
    fitting = [(r, max(1, math.ceil(math.log(miss) / math.log1p(-(t**r))) if t < 1 else 1)) for r in range(1, 17)]
    return max((f for f in fitting if f[0] * f[1] <= SIGNATURE), default=(1, SIGNATURE))


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, no word none."""
    found = byte_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes = _HASHES.of(found)
    width = min(words, len(hashes))
    rolled = np.full(len(hashes) - width + 1, width, np.uint64)
    for j in range(width):
        rolled = (rolled ^ hashes[j : len(hashes) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    return np.unique(mix(rolled))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all windows of the second one laid out on a circle.

    The window that starts at a place holds the values of all circular shifts there, so
    one read of neighbouring values gives a shingle's contribution to every coordinate.
    """
    rng = np.random.default_rng(20240229)
    first = rng.permutation(UNIVERSE).astype(np.uint32)
    second = rng.permutation(UNIVERSE).astype(np.uint32)
    circle = np.concatenate([second, second[: SIGNATURE - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, SIGNATURE)


def signature(shingles: np.ndarray, width: int = SIGNATURE) -> np.ndarray:
    first, shifts = _permutations()
    places = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(width, UNIVERSE, np.uint32)
    for start in range(0, len(places), 512):
        np.minimum(least, shifts[places[start : start + 512], :width].min(axis=0), out=least)
    return least


def _bands(signatures: np.ndarray, rows: int, count: int) -> np.ndarray:
    """One 64-bit bucket key per document and band; the band's number is part of the key."""
    parts = signatures[:, : count * rows].reshape(len(signatures), count, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


SKETCHED = "doc_id long, text_key long, n_shingles long, uid long, fp long, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch], words: int, rows: int, count: int) -> Iterator[pa.RecordBatch]:
    use(_HASHES)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("uid", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, ids, signatures = [], [], []
            for text in part.column(1):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                if len(found):
                    ids.append(fingerprint(found))
                    signatures.append(signature(found, max(rows * count, SKETCH)))
            keys = _bands(np.array(signatures), rows, count) if signatures else np.zeros((0, count), np.int64)
            sketches = [s[:SKETCH].astype(np.uint8).tobytes() for s in signatures]
            full = np.array(sizes) > 0
            place = np.cumsum(full) - 1
            yield pa.record_batch([
                part.column(0), part.column(2), pa.array(sizes, pa.int64()),
                pa.array([ids[p][0] if f else None for f, p in zip(full, place)], pa.int64()),
                pa.array([ids[p][1] if f else None for f, p in zip(full, place)], pa.int64()),
                pa.array([keys[p] if f else None for f, p in zip(full, place)], pa.list_(pa.int64())),
                pa.array([sketches[p] if f else None for f, p in zip(full, place)], pa.binary()),
            ], schema=schema)


def _filter_bits(ids: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` bits with two bits set for each id: of fixed size, however many ids there are."""
    places = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(2)))).alias("place"))
    words = places.groupBy(F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.tobytes()


def _needed(batches: Iterator[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
    """Rows whose bits are set, their texts compressed for the shuffles to come."""
    bits = np.frombuffer(bitmap.value, np.int64)
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        held = np.ones(batch.num_rows, bool)
        for c in (2, 3):
            place = batch.column(c).to_numpy()
            held &= bits[place >> 6] >> (place & 63) & 1 == 1
        kept = batch.filter(pa.array(held))
        for start in range(0, kept.num_rows, 256):
            part = kept.slice(start, 256)
            packed = [packer.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _verified(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Streams (hub, texts linked with it?) groups, the hub's own text first; emits the links."""
    current, hub, a, b = None, None, [], []
    use(_HASHES)
    unpacker = zstandard.ZstdDecompressor()
    for key, chunk, member, packed in rows_of(batches, ("a", "chunk", "b", "packed")):
        shingles = shingle_set(unpacker.decompress(packed), words)
        own = fingerprint(shingles)[0]
        if (key, chunk) != current:
            current, hub = (key, chunk), None
        if member is None:
            if own == key:
                hub = shingles
        elif hub is not None and own == member:
            small, large = sorted((len(hub), len(shingles)))
            if 100 * small >= percent * large:
                shared = len(np.intersect1d(hub, shingles, assume_unique=True))
                if 100 * shared >= percent * (small + large - shared):
                    a.append(key)
                    b.append(member)
        if len(a) >= 10_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _texts(ids: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """(uid, packed) of the wanted nodes' texts; only they, and few others, leave the scan, compressed."""
    wanted = durable(ids.join(nodes.select("uid", "doc_id"), "uid"))
    bitmap = source.sparkSession.sparkContext.broadcast(_filter_bits(wanted))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(FILTER_BITS)).alias(f"place{i}") for i in range(2)]
    packed = source.where("doc_id is not null").select("doc_id", "text", *places).mapInArrow(partial(_needed, bitmap=bitmap), "doc_id long, packed binary")
    return packed.join(wanted, "doc_id").select("uid", "packed")


def _verify(pairs: DataFrame, nodes: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Pairs with one hub are dealt into chunks of about ``STAR`` texts; the hub's text goes
    once to each chunk.  A hub with any number of partners is thus spread over tasks.
    """
    texts = _texts(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct(), nodes, source)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("chunks"))
    first = hubs.withColumnRenamed("a", "uid").join(texts, "uid").select(
        F.col("uid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "packed")
    others = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.col("b").alias("uid"))
    rest = others.join(texts, "uid").select("a", "chunk", F.col("uid").alias("b"), "packed")
    return first.unionByName(rest).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first()).mapInArrow(
        partial(_verified, words=words, percent=percent), "a long, b long")


PLAUSIBLE = "bucket long, left_block int, right_block int, side int, uid long, comp long"


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of each group that some member of the other side, of another component, may be similar to, by sketch; each at most once."""
    t = percent / 100
    share = t + (1 - t) / 256
    least = SKETCH * share - 5.2 * np.sqrt(SKETCH * share * (1 - share))
    for _, rows in groups(batches, ("bucket", "left_block", "right_block")):
        side, uid, comp, n = (rows[c].to_numpy() for c in ("side", "uid", "comp", "n_shingles"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(uid), SKETCH)
        right, wanted = np.flatnonzero(side == 1), np.zeros(len(uid), bool)
        for i in np.flatnonzero(side == 0):
            r = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            r = r[(sketch[r] == sketch[i]).sum(axis=1) >= least]
            wanted[r] = True
            wanted[i] = len(r) > 0
        kept = rows.select([c.split()[0] for c in PLAUSIBLE.split(", ")]).filter(pa.array(wanted))
        yield from kept.combine_chunks().to_batches()


def _open(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members of crowded buckets that may be linked with a component that no star has joined them with yet, by block.

    Members of a bucket's commonest component need no comparison among themselves; every
    other member (left) meets all members (right), block by block.  Buckets of the same
    members count once.
    """
    own = members.where("size > 2 and uid <> hub").join(labels.withColumnRenamed("node", "uid"), "uid", "left").select(
        "bucket", "uid", F.coalesce("component", "uid").alias("comp"))
    own = own.join(nodes.select("uid", "n_shingles", "sketch"), "uid")
    per = own.groupBy("bucket", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.bit_xor(F.xxhash64("uid")).alias("one"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("two"))
    crowded = per.groupBy("bucket").agg(
        F.max(F.struct("n", "comp", "shingles")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"), F.sum("shingles").alias("shingles"),
        F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"),
    ).where("comps > 1")
    blocks = F.greatest((F.col("size") - F.col("most.n")) / BLOCK, (F.col("shingles") - F.col("most.shingles")) / BLOCK_SHINGLES)
    crowded = crowded.groupBy("one", "two", "size").agg(F.min_by(F.struct("bucket", F.col("most.comp").alias("major"), F.ceil(blocks).cast("int").alias("lefts"), F.ceil(F.col("size") / BLOCK).cast("int").alias("rights")), "bucket").alias("b")).select("b.*")
    rows = own.join(crowded, "bucket")
    rows = rows.withColumns({"lb": F.pmod(F.xxhash64("uid"), "lefts").cast("int"), "rb": F.pmod(F.xxhash64("uid"), "rights").cast("int")})
    kept = ["bucket", "uid", "comp", "n_shingles", "sketch"]
    left = rows.where("comp <> major").select(*kept, F.lit(0).alias("side"), F.col("lb").alias("left_block"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right_block"))
    right = rows.select(*kept, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left_block"), F.col("rb").alias("right_block"))
    keys = ["bucket", "left_block", "right_block"]
    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_plausible, percent=percent), PLAUSIBLE)


def _met(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Streams groups, left members first; compares full sets and emits a link where it joins two components not yet joined in the group.

    So a group emits fewer links than it has components, however many of its pairs are similar.
    """
    use(_HASHES)
    unpacker = zstandard.ZstdDecompressor()
    current, left, sets, index, joined, a, b = None, [], [], None, {}, [], []

    def root(comp: int) -> int:
        while comp != (above := joined.get(comp, comp)):
            joined[comp] = joined.get(above, above)
            comp = above
        return comp

    for *group, side, uid, comp, packed in rows_of(batches, ("bucket", "left_block", "right_block", "side", "uid", "comp", "packed")):
        shingles = shingle_set(unpacker.decompress(packed), words)
        if fingerprint(shingles)[0] != uid:
            continue  # another text under the same document id
        if group != current:
            current, left, sets, index, joined = group, [], [], None, {}
        if side == 0:
            left.append((uid, comp))
            sets.append(shingles)
            continue
        if not sets:
            continue
        if index is None:
            sizes = np.array([len(x) for x in sets])
            every = np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            index = every[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
        values, owners, sizes = index
        starts, ends = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
        counts = ends - starts
        places = np.repeat(ends - np.cumsum(counts), counts) + np.arange(counts.sum())
        shared = np.bincount(owners[places], minlength=len(sizes))
        for k in np.flatnonzero(100 * shared >= percent * (sizes + len(shingles) - shared)).tolist():
            other, its = left[k]
            one, two = root(comp), root(its)
            if one != two:
                joined[max(one, two)] = min(one, two)
                a.append(uid)
                b.append(other)
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify_members(plausible: DataFrame, nodes: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of different components of a bucket, on full sets."""
    texts = _texts(plausible.select("uid").distinct(), nodes, source)
    keys = ["bucket", "left_block", "right_block"]
    return plausible.join(texts.hint("merge"), "uid").repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(partial(_met, words=words, percent=percent), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of word
    shingles; a component is everything linked directly or through others, its id the
    smallest document id in it.

    1. Each text becomes its shingle set, a fingerprint of the set and a circulant MinHash
       signature (two permutations, the second shifted around for each coordinate).
    2. Equal sets become one node, so copies never meet one another.
    3. Bands of the signature name buckets.  Each bucket's members are compared with one
       member, its hub, on their full sets; links give components.
    4. In buckets that still hold several components, members outside the commonest one
       meet all others in blocks.  Members with a sketch that agrees enough with one of
       another component meet again in the same blocks with their full sets; a block emits
       a link only where it joins two components.  No bucket is capped.

    A pair at the threshold escapes all bands with a chance below 1e-6.  Null, empty and
    blank texts have no shingle and are linked with nothing.  Rows repeating a document id
    with the same text get the same result each; with other texts they are separate
    nodes.  A null id is reported with a null component and is not kept.  Other columns
    are ignored; an empty table gives no row.
    """
    labelled = _labelled(documents, words, percent, doc_id, text)
    component = F.when(F.col("uid").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _labelled(documents: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Every row's id, hash of its text, set size, node (uid, fp), component and the smallest id in it."""
    rows, count = banding(percent)
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketched = durable(source.withColumn("text_key", F.xxhash64("text")).mapInArrow(partial(_sketch, words=words, rows=rows, count=count), SKETCHED))
    nodes = durable(
        sketched.where("uid is not null and doc_id is not null").groupBy("uid", "fp")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    )
    buckets = nodes.select("uid", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = durable(buckets.join(shared, "bucket"))
    stars = members.where("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct()
    links = durable(_verify(stars, nodes, source, words, percent))
    labels = components(links)
    unsettled = durable(_open(members, labels, nodes, percent))
    if not unsettled.isEmpty():
        more = durable(_verify_members(unsettled, nodes, source, words, percent))
        labels = labels if more.isEmpty() else components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = nodes.select("uid", "fp", "doc_id").join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("uid", "fp", "component", "component_id")
    return sketched.select("doc_id", "text_key", "n_shingles", "uid", "fp").join(named, ["uid", "fp"], "left")


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each component: of its smallest id and, where that has several texts, of one of them.

    Rows without an id, and rows whose text has no word, belong to no component and all stay.  Exact
    repeats of the row that stays go.  All columns pass through, whatever their names.
    """
    labelled = durable(_labelled(documents, words, percent, doc_id, text))
    mark = "_"
    while any(c.startswith(mark) for c in documents.columns):
        mark += "_"
    names = [f"{mark}id", f"{mark}key"]
    chosen = labelled.where("doc_id is not null and uid is not null").groupBy("component").agg(F.min(F.struct("doc_id", "uid", "fp", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    chosen = chosen.select(F.col("first.doc_id").alias(names[0]), F.col("first.text_key").alias(names[1]), "n")
    blank = labelled.where("doc_id is not null and uid is null").select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1])).distinct()
    repeated = chosen.where("n > 1").select(*names).join(
        labelled.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1])).groupBy(*names).count().where("count > 1"), names, "left_semi")
    repeated = durable(repeated)
    once = chosen.select(*names)
    rows = documents.withColumns({names[0]: F.col(doc_id).cast("long"), names[1]: F.xxhash64(F.col(text).cast("string"))})
    if repeated.isEmpty():
        wanted = once.unionByName(blank)
        return rows.where(F.col(names[0]).isNull()).select(*documents.columns).unionByName(rows.join(wanted, names, "left_semi").select(*documents.columns))
    one = rows.join(repeated, names, "left_semi").groupBy(*names).agg(F.any_value(F.struct(*documents.columns)).alias(f"{mark}row")).select(f"{mark}row.*")
    single = once.join(repeated, names, "left_anti").unionByName(blank)
    kept = rows.join(single, names, "left_semi").select(*documents.columns)
    return rows.where(F.col(names[0]).isNull()).select(*documents.columns).unionByName(kept).unionByName(one)
