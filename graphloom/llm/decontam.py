"""Benchmark decontamination: rare n-gram seeds, then word-level Smith-Waterman alignment.

The benchmark is the stated query set. It is taken in blocks of a bounded number of n-grams (some ten thousand items), each
small enough to send to every executor; corpus texts are only scanned, twice a block, never shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .license import words_of
from .simhash import gram_hashes

GRAM, RUN, THRESHOLD = 3, 4, 0.6
MISMATCH, GAP = 0.5, 0.5
#: n-grams of one block: bounds what each task holds (some 200 bytes a gram).
BLOCK_GRAMS = 400_000
RESULT = "doc_id long, item_id long, score double, n_seeds int, doc_begin int, doc_end int, item_begin int, item_end int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())] + [(c, pa.int32()) for c in ("n_seeds", "doc_begin", "doc_end", "item_begin", "item_end")])


def _words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


def _grams(words: list[bytes], n: int) -> list[bytes]:
    """The n-grams of a text in order; a shorter text is one gram."""
    return [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []


def smith_waterman(doc: list, item: list, mismatch: float = MISMATCH, gap: float = GAP) -> tuple[float, int, int]:
    """Best local alignment: score (a match counts one), and the ends (exclusive) in ``doc`` and ``item``."""
    if not doc or not item:
        return 0.0, 0, 0
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    b = np.array([code[w] for w in item])
    steps = gap * np.arange(len(b) + 1)
    row, best, at = np.zeros(len(b) + 1), 0.0, (0, 0)
    gain = {k: np.where(b == k, 1.0, -mismatch) for k in code.values()}
    miss = np.full(len(b), -mismatch)
    for i, w in enumerate(doc):
        up = row - gap
        up[1:] = np.maximum(up[1:], row[:-1] + gain.get(code.get(w, -1), miss))
        row = np.maximum(np.maximum.accumulate(np.maximum(up, 0.0) + steps) - steps, 0.0)
        j = int(row.argmax())
        if row[j] > best + 1e-9:
            best, at = float(row[j]), (i + 1, j)
    return best, *at


def align(doc: list, item: list) -> tuple[float, int, int, int, int]:
    """Score and spans ``doc_begin, doc_end, item_begin, item_end`` of the best local alignment."""
    score, de, ie = smith_waterman(doc, item)
    _, db, ib = smith_waterman(doc[:de][::-1], item[:ie][::-1])
    return score, de - db, de, ie - ib, ie


class Matcher:
    """All places of a set of grams in a text of words, by sorted 64-bit hashes."""

    def __init__(self, grams: Iterable[bytes]):
        words = [g.split(b" ") for g in grams]
        keys = np.array([gram_hashes(w, len(w))[0] for w in words], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.sizes = sorted({len(w) for w in words})

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Gram numbers and the places of their first words."""
        grams, spots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.sizes:
            if len(words) >= size:
                own = gram_hashes(words, size)
                at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == own)
                grams.append(self.order[at[hit]])
                spots.append(hit)
        return np.concatenate(grams), np.concatenate(spots)


def document_frequency(docs: DataFrame, grams: list[bytes], text_col: str = "text") -> Counter:
    """Documents of the whole corpus that hold each gram (by number): counted per task, then summed."""

    shared = docs.sparkSession.sparkContext.broadcast(grams)  # one block's, so bounded

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(shared.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(np.unique(matcher.places(_words(text))[0]).tolist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(each, "gram int, n long")
    return Counter({r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()})  # at most the block's grams


def choose_seeds(items: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], n: int = GRAM, run: int = RUN) -> dict[bytes, list[tuple[int, int]]]:
    """Rare seeds: of every ``run`` successive grams of an item, the one in the fewest documents.

    Rarity ranks grams within a stretch and is no cap: an intact stretch of ``n + run - 1`` words always holds a seed,
    however many documents repeat it. Seed -> places ``(item number, gram place)``.
    """
    seeds: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for number, words in items:
        grams = _grams(words, n)
        chosen = {min(range(k, k + min(run, len(grams))), key=lambda j: (frequency.get(grams[j], 0), grams[j], j)) for k in range(max(1, len(grams) - run + 1))} if grams else ()
        for k in chosen:
            seeds[grams[k]].append((number, k))
    return dict(seeds)


def _blocks(items: list[tuple[int, str]], n: int, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    now, held = [], 0
    for item_id, text in items:
        words = _words(text)
        if held and held + len(words) > most:
            yield now
            now, held = [], 0
        now.append((item_id, words))
        held += len(words)
    if now:
        yield now


def windows(hits: list[tuple[int, int]], size: int, length: int) -> list[tuple[int, int, int]]:
    """Merge seed hits ``(doc word, item word)`` of one item into windows ``begin, end, distinct seeds``."""
    pad = size // 4 + 5
    out: list[list] = []
    for d, i in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        begin, end = max(0, d - i - pad), min(length, d - i + size + pad)
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].add(i)
        else:
            out.append([begin, end, {i}])
    return [(b, e, len(s)) for b, e, s in out]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = GRAM, least_seeds: int = 1) -> DataFrame:
    """``doc_id, item_id, score, ...`` of every document and item whose best alignment scores ``threshold`` or more.

    The score is the local alignment's (match 1, mismatch and gap -0.5) over the item's words, so 1 is the whole item
    verbatim. An item's window needs ``least_seeds`` distinct seeds (one where the item has fewer). An item edited so that
    no seed of it is left is missed: with one seed less than 0.5 % of those that still score 0.6, see the README. Spans
    count words. Null and empty texts on either side match nothing; null ids on either side pass through; repeated rows
    give repeated results (repeated items one); texts of any length are aligned around their seeds; empty tables give an
    empty result; other columns are ignored.
    """
    items = [(r["item_id"], r["text"] or "") for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator()]
    out = None
    for block in _blocks(items, n, BLOCK_GRAMS):
        found = _leaks_of_block(docs, block, id_col, text_col, threshold, n, least_seeds)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def _leaks_of_block(docs: DataFrame, block, id_col: str, text_col: str, threshold: float, n: int, least_seeds: int) -> DataFrame:
    numbered = [(k, words) for k, (_, words) in enumerate(block)]
    grams = sorted({g for _, words in numbered for g in _grams(words, n)})
    count = document_frequency(docs, grams, text_col)
    seeds = choose_seeds(numbered, {g: count[k] for k, g in enumerate(grams)}, n)
    names = sorted(seeds)
    places = [seeds[g] for g in names]
    need = Counter(number for p in places for number, _ in p)

    shared = docs.sparkSession.sparkContext.broadcast((names, places, need, block))  # bounded by the block

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places, need, block = shared.value
        matcher = Matcher(names)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(text)
                found, spots = matcher.places(words)
                if not len(found):
                    continue
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for g, d in zip(found.tolist(), spots.tolist(), strict=True):
                    for number, i in places[g]:
                        hits[number].append((d, i))
                for number, where in hits.items():
                    least = min(least_seeds, need[number])
                    if len({i for _, i in where}) < least:
                        continue
                    item_id, item = block[number]
                    best = None
                    for begin, end, distinct in windows(where, len(item), len(words)):
                        if distinct < least:
                            continue
                        score, db, de, ib, ie = align(words[begin:end], item)
                        if best is None or score > best["score"]:
                            best = {"doc_id": doc_id, "item_id": item_id, "score": score, "n_seeds": distinct,
                                    "doc_begin": begin + db, "doc_end": begin + de, "item_begin": ib, "item_end": ie}
                    if best and best["score"] / len(item) >= threshold:
                        rows.append(best | {"score": best["score"] / len(item)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, RESULT)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that leak an item.

    Rows of a null id stay; an id that leaks in one of its rows goes with all of them. Null and empty texts and an empty
    benchmark remove nothing; columns pass through, whatever their names.
    """
    gone = free_name(docs, "gone")
    out = leaks(docs, benchmark, id_col, text_col, threshold).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col(id_col).cast("long") == F.col(gone), "left_anti")
