"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, shuffled_join, stage_table

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 values of the word shingles of one text in order; fewer words: of the whole sequence; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the rows of ``values`` (unsigned 64-bit, rows x words) have each bit, the highest bit first."""
    out = np.zeros(64 * values.shape[1], np.int64)
    for at in range(0, len(values), 255 * 64):
        bits = np.unpackbits(values[at : at + 255 * 64].astype(">u8").view(np.uint8).reshape(-1, 8 * values.shape[1]), axis=1)
        whole = len(bits) // 255 * 255  # 255 ones still fit a byte
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out += bits[whole:].sum(axis=0, dtype=np.uint8)
    return out


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of one text: majority bit over the XXH64 values of its word shingles, repeats included."""
    values = shingle_hashes(text, shingle)
    return int.from_bytes(np.packbits(2 * bit_counts(values[:, None]) > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` for every row. Null, empty and white-space texts have fingerprint zero; null ids stay null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """Masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _variants(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``key, fp``: all variants of each block of a fingerprint within half of the block's share of the radius.

    The number of the block stands above the bits of the block in the key.
    """
    width = 64 // blocks
    masks = ball(width, ceil((radius // blocks) / 2))
    low = (1 << width) - 1 if width < 64 else -1
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    mask = F.explode(F.expr("array(" + ",".join(f"{m}L" if m > -(1 << 63) else "shiftleft(1L, 63)" for m in signed) + ")")).alias("mask")
    parts = []
    for block in range(blocks):
        part = F.shiftrightunsigned("fp", width * block).bitwiseAND(F.lit(low)) if blocks > 1 else F.col("fp")
        key = part.bitwiseXOR(F.col("mask")).bitwiseOR(F.lit(block << width).cast("long")) if blocks > 1 else part.bitwiseXOR(F.col("mask"))
        parts.append(fps.select("fp", mask).select(key.alias("key"), "fp"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _stars(radius: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def stars(members: pd.Series) -> pd.Series:
        out = []
        for group in members:
            x = np.unique(np.asarray(group, np.int64)).view(np.uint64)
            label = np.arange(len(x))
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            while True:
                low = np.where(near, label[None, :], len(x)).min(axis=1)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            y = x.view(np.int64)
            out.append([{"a": int(y[label[i]]), "b": int(y[i])} for i in range(len(x)) if label[i] != i])
        return pd.Series(out)

    return stars


def links(fps: DataFrame, radius: int = 4, blocks: int = 2, small: int = 512) -> DataFrame:
    """``a, b``: links that connect exactly what the pairs of distinct fingerprints within ``radius`` bits connect.

    ``fps`` has one row per distinct ``fp``. With ``blocks=1`` every fingerprint emits its whole ball of half the
    radius; two members of one variant's bucket are then within the radius, so a star replaces the pairs. With
    ``blocks=2`` the radius is first dealt over two halves of the bits (one half has at most half of the differing
    bits), and each half emits its own ball, 66 variants rather than 2,081; members of a bucket are verified. A
    bucket with more than ``small`` members is never expanded into pairs: its members emit the whole 64-bit ball.
    """
    if blocks == 1:
        return _ball_stars(fps, radius)
    keyed = _variants(fps, radius, blocks).repartition("key")
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stage_table(shuffled_join(keyed, size, "key"), "ball-crowded")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = crowded.where("n = 2").groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where(near).select("a", "b")
    few = crowded.where((F.col("n") > 2) & (F.col("n") <= small)).groupBy("key").agg(F.collect_list("fp").alias("members"))
    few = few.select(F.explode(_stars(radius)("members")).alias("e")).select("e.a", "e.b")
    many = crowded.where(F.col("n") > small).select("fp").distinct()
    return pairs.union(few).union(_ball_stars(many, radius)).distinct()


def _ball_stars(fps: DataFrame, radius: int) -> DataFrame:
    """Stars over buckets of whole variants: members differ in at most ``radius`` bits (an even radius) by construction."""
    keyed = _variants(fps, radius, 1).select("key", "fp")
    first = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("key", "a")
    found = shuffled_join(keyed, first, "key").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int = 2, small: int = 512
) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``docs``.

    Fingerprints of at most ``radius`` differing bits are linked; ``component_id`` is the smallest id reachable.
    Rows with equal fingerprints are one node, so copies cost one row in the shuffle. ``n_links`` counts the
    linking fingerprints kept for connectivity. Null, empty and blank texts share fingerprint zero; rows with a
    null id keep it and take the smallest non-null id of their component; repeated rows each appear; an empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = stage_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    edges = stage_table(links(nodes.select("fp"), radius, blocks, small), "simhash-links")
    labels = connected_components(edges, "simhash-cc")
    known = nodes.join(labels, F.col("fp") == F.col("node")).select("fp", "label", "low")
    lowest = known.groupBy("label").agg(F.min("low").alias("reach"))
    reach = stage_table(known.join(lowest, "label").select("fp", "reach"), "simhash-reach")
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    of_fp = nodes.join(reach, "fp", "left").join(degree, "fp", "left")
    of_fp = of_fp.select("fp", F.coalesce("reach", "low").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_fp = stage_table(of_fp, "simhash-class")
    out = rows.join(of_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


class _WordHashes(dict):
    """Hash of each word, remembered; emptied when it holds half a million words, which changes speed only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return value


_words = _WordHashes()
#: Odd multipliers, one for each further hash of a 64-bit value.
_ODD = np.array([xxhash.xxh3_64_intdigest(b"%d" % k, SEED) | 1 for k in range(64)], np.uint64)


def _remixed(values: np.ndarray, k: int | slice) -> np.ndarray:
    x = values * _ODD[k]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """64-bit hashes of the ``n``-grams of a sequence of words in order; fewer words: of the whole sequence; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(each))
    out = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        out += _remixed(each[k : k + len(out)], k)
    return _remixed(out + np.uint64(size), n)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text, see :func:`gram_hashes`."""
    return np.unique(gram_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle))


#: Bits of a segment of the near fingerprint that an anchor selects, and the balls its variants fill.
SEGMENT_BITS = 16


def near_print_of(text: str | None, shingle: int, segments: int, words: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """``name, n, prints, bases, values`` of the set of word shingles of one text.

    ``name``: 64 bits that name the set, 0 for the empty one; ``n``: its size; ``prints``: ``words`` times 64 SimHash bits
    over the set; ``bases``: for each segment its 16 SimHash bits below 48 bits of its anchor, the shingle that is least
    under the segment's own hash (two sets of similarity J have an anchor in common with probability J).
    """
    values = shingle_set(text, shingle)
    if not len(values):
        return 0, 0, np.zeros(words, np.uint64), np.zeros(segments, np.uint64), values
    ones = bit_counts(_remixed(values[:, None], slice(16, 16 + words)))
    prints = np.packbits(2 * ones > len(values)).view(">u8").astype(np.uint64)
    per, low = 64 // SEGMENT_BITS, np.uint64((1 << SEGMENT_BITS) - 1)
    anchors = (values[:, None] * _ODD[32 : 32 + segments]).min(axis=0)
    cut = np.array([prints[k // per] >> np.uint64(SEGMENT_BITS * (k % per)) for k in range(segments)], np.uint64)
    bases = _remixed(anchors, slice(32, 32 + segments)) & ~low | cut & low
    return xxhash.xxh3_64_intdigest(values.tobytes(), SEED) or 1, len(values), prints, bases, values


def near_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, segments: int, words: int) -> DataFrame:
    """``doc_id, node, n, w0, w1, ..., bases`` for every row, see :func:`near_print_of`."""
    names = ["doc_id", "node", "n", *(f"w{k}" for k in range(words)), "bases"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                node, n, prints, bases, _ = zip(*(near_print_of(t, shingle, segments, words) for t in batch.column(1).to_pylist()), strict=True)
                prints = np.stack(prints).view(np.int64)
                ends = pa.array(np.arange(0, (len(node) + 1) * segments, segments, dtype=np.int32))
                bases = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bases).view(np.int64)))
                columns = (pa.array(np.ascontiguousarray(prints[:, k])) for k in range(words))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), *columns, bases], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, ", ".join(["doc_id long, node long, n long", *(f"w{k} long" for k in range(words)), "bases array<long>"]))


def closed(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The least member each of ``count`` members reaches. ``near(i, others)`` tells which others ``i`` is linked to.

    A member meets only those no one has reached yet: every pair across two groups is compared, and a dense group takes
    about one comparison a member.
    """
    label, free = np.arange(count), np.arange(count)
    while len(free):
        first, free = free[0], free[1:]
        turn = [first]
        while turn and len(free):
            hit = near(turn.pop(), free)
            label[free[hit]] = first
            turn += free[hit].tolist()
            free = free[~hit]
    return label


def print_groups(starts: np.ndarray, prints: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first row its bucket links it to, by at most ``limit`` differing bits; buckets begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(prints)))
    label = np.repeat(starts, sizes)
    apart = np.bitwise_count(prints ^ prints[label]).sum(axis=1, dtype=np.int64) > limit
    if apart.any():
        for g in np.flatnonzero(np.add.reduceat(apart, starts)).tolist():
            begin, n = int(starts[g]), int(sizes[g])
            own = prints[begin : begin + n]
            label[begin : begin + n] = begin + closed(n, lambda i, others, own=own: np.bitwise_count(own[others] ^ own[i]).sum(axis=1) <= limit)
    return label


def set_groups(prints: np.ndarray, values: list[np.ndarray], limit: int, percent: int) -> np.ndarray:
    """The least member each set reaches by links of ``percent`` Jaccard similarity (and ``limit`` bits) or better."""
    sizes = np.array([len(v) for v in values])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        n, out = sizes[others], np.zeros(len(others), bool)
        fits = (100 * n >= percent * sizes[i]) & (100 * sizes[i] >= percent * n)
        fits = np.flatnonzero(fits & (np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1) <= limit))
        for begin in range(0, len(fits), 4096):
            some = fits[begin : begin + 4096]
            flat = np.concatenate([values[k] for k in others[some]])
            found = values[i][np.minimum(np.searchsorted(values[i], flat), len(values[i]) - 1)] == flat
            both = np.add.reduceat(found, np.concatenate(([0], np.cumsum(n[some])[:-1])), dtype=np.int64)
            out[some] = 100 * both >= percent * (n[some] + sizes[i] - both)
        return out

    return closed(len(values), near)


def dealt(rows: DataFrame, group: str, weight: str, most: int, *columns: str) -> DataFrame:
    """``sub, node, columns``: the rows of each ``group`` by subgroups that stream through in order.

    A group whose ``weight`` exceeds ``most`` is dealt into blocks of about that weight by node, and each pair of its blocks
    is a subgroup of its own: all members still meet, no task holds more than two blocks, and no group goes to one task.
    """
    blocks = F.ceil(F.col(weight) / most).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    subs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: (o != F.col("_mine")) | (F.col("_blocks") == 1)),
        lambda o: F.xxhash64(F.col(group), F.least(o, F.col("_mine")), F.greatest(o, F.col("_mine"))),
    )
    cut = rows.withColumn("_blocks", blocks).withColumn("_mine", mine)
    return cut.select(F.explode(subs).alias("sub"), "node", *columns).repartition("sub").sortWithinPartitions("sub", "node")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole subgroups (column 0, sorted) from a stream of batches; the last subgroup of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != int(keys[0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _star(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    kept = label != np.arange(len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[label[kept]]), pa.array(node[kept])], names=["a", "b"])


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, segments: int = 6, words: int = 4, limit: int = 60,
    block_rows: int = 50_000, block_shingles: int = 4_000_000,
) -> DataFrame:
    """``doc_id, component_id`` for every row: texts whose ``shingle``-word shingles are ``percent`` alike or more, linked.

    Ball hashing over a fingerprint of ``64 * words`` SimHash bits of the set of shingles. At 0.8 similarity 15 % of the
    bits differ, too many for a ball over all of them, so each of ``segments`` 16-bit segments emits its own ball of one bit
    (two meet at up to two differing bits) under the anchor of the segment; without the anchor, 16 bits would meet by chance.
    A pair of similarity 0.8 meets in a segment with probability 0.44, in one of six with 0.97. Members of a variant's
    bucket that differ in at most ``limit`` bits (3.7 standard deviations over the mean at 0.8) are linked loosely, and the
    components of these links are split by exact similarity of their sets (64-bit hashes of shingles). Buckets over
    ``block_rows`` rows and components over ``block_shingles`` shingles are compared in pairs of blocks, see :func:`dealt`.

    ``component_id`` is the smallest id reachable. Equal sets are one node, so copies cost one row in a shuffle. Null,
    empty and blank texts are one node. Rows of a null id keep it, link nothing, and take the component of an equal set,
    else null. Repeated rows each appear; an id that comes with several texts has a row for each. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    names = [f"w{k}" for k in range(words)]
    rows = stage_table(near_prints(docs, id_col, text_col, shingle, segments, words), "near")
    first = [F.first(c).alias(c) for c in ("n", *names, "bases")]
    nodes = stage_table(rows.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *first), "near-nodes")

    masks = F.explode(F.array(*(F.lit(m).cast("long") for m in ball(SEGMENT_BITS, 1)))).alias("mask")
    keyed = nodes.where("n > 0").select("node", F.explode("bases").alias("base")).select("node", "base", masks)
    keyed = keyed.select(F.col("base").bitwiseXOR(F.col("mask")).alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stage_table(shuffled_join(keyed, shared, "key"), "near-met")

    def loosely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            keys, node, *prints = (c.to_numpy() for c in table.columns)
            yield _star(node, print_groups(_starts(keys), np.stack(prints, axis=1).view(np.uint64), limit))

    bucketed = dealt(met.join(nodes.select("node", *names), "node"), "key", "size", block_rows, *names)
    # A node's centres (at most one a bucket) are tied to the least of them, which many nodes repeat.
    stars = bucketed.mapInArrow(loosely, "a long, b long").groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("centres"))
    stars = stars.select("a", F.explode(F.array_append("centres", F.col("b"))).alias("b")).where("a <> b").distinct()
    loose = connected_components(stage_table(stars, "near-loose"), "near-cc")

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            keys = table.column(0).to_numpy()
            cuts = [*_starts(keys).tolist(), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                node, prints, values = [], [], []
                for own, text in zip(table.column(1)[begin:end], table.column(2)[begin:end], strict=True):
                    name, _, bits, _, body = near_print_of(text.as_py(), shingle, 0, words)
                    if np.uint64(name).view(np.int64) == own.as_py() and (not node or node[-1] != own.as_py()):  # not another text of a repeated id
                        node.append(own.as_py())
                        prints.append(bits)
                        values.append(body)
                if node:
                    yield _star(np.array(node, np.int64), set_groups(np.stack(prints), values, limit, percent))

    members = loose.join(nodes.select("node", "doc_id", "n"), "node")
    sizes = members.groupBy("label").agg(F.sum("n").alias("weight"))
    members = stage_table(members.join(sizes, "label").select("node", "label", "weight", F.col("doc_id").alias("id")), "near-members")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bodies = dealt(texts.join(members, "id"), "label", "weight", block_shingles, "text")
    near = connected_components(stage_table(bodies.mapInArrow(exactly, "a long, b long").distinct(), "near-exact"), "near-exact-cc")

    label = nodes.select("node", "doc_id").join(near, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = stage_table(label.join(least, "label").select("node", "component_id"), "near-class")
    return rows.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: int) -> DataFrame:
    """``docs`` without the members of a near component other than the one with the smallest id.

    Rows of a null id stay. An id that comes with several texts stays whole if one of them stays. Repeated rows of an id
    that stays all stay; an empty table stays empty. Columns pass through, whatever their names.
    """
    groups = near_components(docs, id_col, text_col, **parameters)
    gone = free_name(docs, "gone")
    out = groups.groupBy(F.col("doc_id").alias(gone)).agg(F.min(F.col("component_id") < F.col("doc_id")).alias("all")).where("all").select(gone)
    return docs.join(out, F.col(id_col).cast("long") == F.col(gone), "left_anti")
