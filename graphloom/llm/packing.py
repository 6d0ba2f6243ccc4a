"""Best-fit packing of token sequences with the linear grouping scheme.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. The plan made
from it is a list of runs "the pieces of this length with ranks lo..hi go to sequences s, s+1, ... at this offset", so
it is bounded by the capacity too; ranks of pieces and the look-up of runs are distributed.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

CAPACITY = 2048
#: Fixed value: the split pattern of byte-level pre-tokenizers.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts as ``tokenizers`` gives them with ``add_special_tokens=False``.

    A plain byte-level BPE whose merges are in the order of their ids is run by ``tiktoken`` on the vocabulary of the same
    file, which gives the same ids about four times as fast; any other tokenizer runs as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._fast(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
        plain = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and spec.get("normalizer") is None
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        )
        if not plain:
            return None
        special = {t["content"]: t["id"] for t in added}
        of, vocab = _byte_level(), model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab["".join(m)] for m in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        ranks = {bytes(of[c] for c in token): k for token, k in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text."""
        for text in texts:
            if self.fast is not None:
                yield self.fast.encode_to_numpy(text, allowed_special="all")
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of ``n`` tokens: all full but the first, which may be shorter."""
    count = -(-n // capacity)
    first = n - capacity * (count - 1)
    return [(0, first)] + [(first + capacity * k, capacity) for k in range(count - 1)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token pieces of every row: ids of its text and ``end_id``, cut to at most ``capacity`` tokens. Null text: empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary or default_vocabulary())
        tail = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_batch(texts), strict=True):
                    ids = np.concatenate((ids.astype("<u4"), tail))
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length])))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, PIECES)


class _Plan:
    """Bins as groups ``residual -> [(first sequence, count)]``; runs ``(length, lo, hi, sequence, offset)``."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.rank: dict[int, int] = {}
        self.bins: dict[int, list[tuple[int, int]]] = {}
        self.levels: list[int] = []

    def _put(self, residual: int, first: int, count: int) -> None:
        if residual and count:
            if not self.bins.get(residual):
                insort(self.levels, residual)
            self.bins.setdefault(residual, []).append((first, count))

    def _place(self, length: int, first: int, count: int, offset: int) -> None:
        lo = self.rank.get(length, 0)
        self.runs.append((length, lo, lo + count, first, offset))
        self.rank[length] = lo + count

    def open(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences that each hold one piece of each of ``lengths``."""
        at = 0
        for length in lengths:
            self._place(length, self.sequences, count, at)
            at += length
        self._put(self.capacity - at, self.sequences, count)
        self.sequences += count

    def best_fit(self, length: int, count: int) -> None:
        """Place pieces of one length, each where the least room stays."""
        while count:
            k = bisect_left(self.levels, length)
            if k == len(self.levels):
                each = self.capacity // length
                full, rest = divmod(count, each)
                if full:
                    self.open([length] * each, full)
                if rest:
                    self.open([length] * rest, 1)
                return
            residual = self.levels[k]
            first, n = self.bins[residual].pop()
            if not self.bins[residual]:
                self.levels.pop(k)
            m = min(n, count)
            if m < n:
                self._put(residual, first + m, n - m)
            self._place(length, first, m, self.capacity - residual)
            self._put(residual - length, first, m)
            count -= m


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> list[int]:
    """Sizes (by number, with repeats) that fit the capacity and are worth most; as many rounds as of the least size fit."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more = np.full((len(sizes) + 1, capacity + 1), -np.inf)
        more[-1] = best  # nothing more
        for k, n in enumerate(sizes.tolist()):
            more[k, n:] = best[: capacity + 1 - n] + values[k]
        picks.append(more.argmax(axis=0))
        best = more.max(axis=0)
    out, room = [], capacity
    for pick in reversed(picks):
        if pick[room] < len(sizes):
            out.append(int(pick[room]))
            room -= int(sizes[out[-1]])
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], int]]:
    """Fillings ``(sizes by number, times)`` of few sizes that use up ``counts`` in few bins: column generation.

    The linear relaxation starts from one filling a size; a filling worth more than one bin at the present prices enters
    the basis, until there is none (or after ``rounds``, from a valid basis all the same). Whole multiples of its fillings
    are taken; what the fractions leave, fewer items than there are sizes times a bin's, is filled largest first, each bin
    with the filling of the items left that leaves least room.
    """
    n, size, due = len(sizes), np.array(sizes), np.array(counts, float)
    basis = [[k] * (capacity // sizes[k]) for k in range(n)]
    inverse = np.diag([1.0 / len(b) for b in basis])
    times = inverse @ due
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        enter = best_pattern(size, prices, capacity)
        if not enter or prices[enter].sum() <= 1 + 1e-7:
            break
        change = inverse @ np.bincount(enter, minlength=n)
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        times = np.maximum(times - step * change, 0)
        times[leave] = step
        inverse[leave] /= change[leave]
        others = np.arange(n) != leave
        inverse[others] -= np.outer(change[others], inverse[leave])
        basis[leave] = enter
    left, out = list(counts), []
    for pattern, t in zip(basis, np.floor(times + 1e-6).astype(int).tolist(), strict=True):
        t = min([t, *(left[k] // pattern.count(k) for k in set(pattern))])
        if t:
            out.append((pattern, t))
            for k in pattern:
                left[k] -= t
    for k in range(n):
        while left[k]:
            room, pattern = capacity - sizes[k], [k]
            left[k] -= 1
            have = [j for j in range(k, n) if left[j] and sizes[j] <= room]
            if have:
                worth = np.array([float(sizes[j]) for j in have])
                for j in (have[x] for x in best_pattern(size[have], worth, room)):
                    if left[j]:
                        left[j] -= 1
                        pattern.append(j)
            out.append((pattern, 1))
    return out


def linear_grouping(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 256, large: float = 1 / 3) -> _Plan:
    """Plan of a histogram of lengths (1 to capacity).

    Lengths over ``large`` of the capacity are sorted and dealt into ``groups`` groups of equal cardinality; each group
    counts as its largest length while configurations of those few sizes are optimised; the actual lengths then take the
    places, so real room is at least the planned room; the small lengths go in by best fit, largest first.
    """
    plan = _Plan(capacity)
    plan_of = sorted(((n, c) for n, c in histogram.items() if n > large * capacity and n < capacity), reverse=True)
    if histogram.get(capacity):
        plan.open([capacity], histogram[capacity])
    total = sum(c for _, c in plan_of)
    members: list[list[list[int]]] = []  # per group: [length, count] in descending order
    if total:
        share, have = -(-total // groups), 0
        for length, count in plan_of:
            while count:
                if not members or have == share:
                    members.append([])
                    have = 0
                take = min(count, share - have)
                members[-1].append([length, take])
                have += take
                count -= take
        # Groups of one length are one size.
        sizes = sorted({m[0][0] for m in members}, reverse=True)
        queues = [[x for m in members if m[0][0] == n for x in m] for n in sizes]
        for config, times in configurations(sizes, [sum(c for _, c in q) for q in queues], capacity):
            while times:
                heads, need = [], {}
                for j in config:
                    need[j] = need.get(j, 0) + 1
                step = times
                for j, k in need.items():  # as many bins as have one length in each place
                    step = min(step, max(1, queues[j][0][1] // k))
                for j in config:
                    queue = queues[j]
                    heads.append(queue[0][0])
                    queue[0][1] -= step if queue[0][1] >= step else queue[0][1]
                    if not queue[0][1]:
                        queue.pop(0)
                plan.open(heads, step)
                times -= step
    for length, count in sorted(((n, c) for n, c in histogram.items() if n <= large * capacity), reverse=True):
        plan.best_fit(length, count)
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row.

    Sequences hold at most ``capacity`` tokens without gaps. A null or empty text is one piece of the end id alone;
    repeated rows are packed each; null ids pass through; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cutup = stage_table(pieces(docs, id_col, text_col, vocabulary, capacity), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = linear_grouping(histogram, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)

    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cutup.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    before = stage_table(before, "pack-ranks")
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("place", place).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            run = runs[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(each, f"{PIECES}, sequence_id long, offset long")
