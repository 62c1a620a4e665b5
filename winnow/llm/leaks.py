"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.lineage import cut
from winnow.functions.partitions import spread
from winnow.functions.workers import Shipped
from winnow.llm.wikitext import plain, words

K1, B = 1.2, 0.75
#: Items and characters of one index; a larger table is searched index by index.
INDEX_ITEMS, INDEX_CHARACTERS = 20_000, 20_000_000
#: Postings of one block.
BLOCK = 16


@dataclass
class Index:
    """A BM25 inverted index of the test items with the largest impact of each list and block.

    An item's threshold is the least score that a text can have that holds one of its passages, the sum
    over the distinct words of the passage.  Scores of texts only add up such impacts, so no text that
    holds a passage stays below it.
    """

    ids: list[int]
    grams: list[set[str]]
    lengths: list[int]
    answers: list[str]
    thresholds: list[float]
    least: float = np.inf
    items: dict[str, list[int]] = field(default_factory=dict)
    impacts: dict[str, list[float]] = field(default_factory=dict)
    highest: dict[str, float] = field(default_factory=dict)
    ends: dict[str, list[int]] = field(default_factory=dict)
    peaks: dict[str, list[float]] = field(default_factory=dict)


def build_index(rows: list[tuple[int, str | None, str | None]], passage: int) -> Index:
    """Index of (id, text, answer); an item without words can't be found and is left out."""
    kept = [(i, words(t or ""), words(a or "")) for i, t, a in sorted(rows, key=lambda r: r[0])]
    kept = [(i, w, a) for i, w, a in kept if w]
    n = len(kept)
    average = sum(len(w) for _, w, _ in kept) / n if n else 1.0
    found: dict[str, list[tuple[int, float]]] = {}
    for place, (_, w, _) in enumerate(kept):
        counts: dict[str, int] = {}
        for x in w:
            counts[x] = counts.get(x, 0) + 1
        for x, f in counts.items():
            found.setdefault(x, []).append((place, f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / average))))
    weights: list[dict[str, float]] = [{} for _ in kept]
    index = Index([i for i, _, _ in kept], [], [], [" ".join(a) for _, _, a in kept], [])
    for x, postings in found.items():
        idf = log(1 + (n - len(postings) + 0.5) / (len(postings) + 0.5))
        places, impact = [p for p, _ in postings], [idf * f for _, f in postings]
        for p, v in zip(places, impact, strict=True):
            weights[p][x] = v
        blocks = [slice(at, at + BLOCK) for at in range(0, len(places), BLOCK)]
        index.items[x], index.impacts[x], index.highest[x] = places, impact, max(impact)
        index.ends[x] = [places[b][-1] for b in blocks]
        index.peaks[x] = [max(impact[b]) for b in blocks]
    for place, (_, w, _) in enumerate(kept):
        size = min(passage, len(w))
        windows = [w[at : at + size] for at in range(len(w) - size + 1)]
        index.grams.append({f" {' '.join(g)} " for g in windows})
        index.lengths.append(size)
        index.thresholds.append(min(sum(weights[place][x] for x in set(g)) for g in windows) - 1e-9)
    index.least = min(index.thresholds, default=np.inf)
    return index


def passages(index: Index, found: list[str]) -> Iterator[set[str]]:
    """The passages of a text that may reach a threshold: runs of windows as long as the longest gram
    whose words' largest impacts add up to the least threshold."""
    highest = index.highest
    bounds = np.array([highest.get(w, 0.0) for w in found])
    size = max(index.lengths, default=1)
    if not len(bounds) or bounds.sum() < index.least:
        return
    total = np.r_[0.0, np.cumsum(bounds)]
    last = max(1, len(bounds) - size + 1)
    window = total[np.minimum(np.arange(last) + size, len(bounds))] - total[:last]
    starts = np.flatnonzero(window >= index.least - 1e-6)
    if not len(starts):
        return
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    for run in np.split(starts, cuts):
        yield {w for w in found[run[0] : run[-1] + size] if w in highest}


def retrieve(index: Index, query: set[str]) -> list[int]:
    """Places of the items whose score for the query reaches their threshold, by block-max WAND."""
    least = index.least
    if sum(map(index.highest.__getitem__, query)) < least:
        return []
    none = len(index.ids)
    # [next item, place in the list, list, impacts, ends of blocks, peaks of blocks, largest impact]
    lists = [[index.items[x][0], 0, index.items[x], index.impacts[x], index.ends[x], index.peaks[x], index.highest[x]] for x in query]

    def skip(x: list, item: int) -> None:
        x[1] = bisect_left(x[2], item, x[1])
        x[0] = x[2][x[1]] if x[1] < len(x[2]) else none

    hits = []
    while True:
        lists.sort(key=itemgetter(0))
        bound, pivot = 0.0, none
        for x in lists:
            bound += x[6]
            if bound >= least:
                pivot = x[0]
                break
        if pivot == none:
            return hits
        front = [x for x in lists if x[0] <= pivot]
        following = min((x[0] for x in lists if x[0] > pivot), default=none)
        peak, until = 0.0, none
        for x in front:
            block = bisect_left(x[4], pivot)
            if block < len(x[4]):
                peak += x[5][block]
                until = min(until, x[4][block] + 1)
        if peak < least:  # no item up to the end of the nearest block reaches any threshold
            for x in front:
                skip(x, max(pivot + 1, min(until, following)))
            continue
        score = 0.0
        for x in front:
            skip(x, pivot)
            if x[0] == pivot:
                score += x[3][x[1]]
                skip(x, pivot + 1)
        if score >= index.thresholds[pivot]:
            hits.append(pivot)


def leaks(
    df: DataFrame,
    items: DataFrame,
    passage: int = 13,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    item_answer: str = "answer",
) -> DataFrame:
    """(key, item_id, passages, share, answer_found) of every document that holds a passage of an item.

    A passage is ``passage`` consecutive words of the item, or all of its words if it has fewer; passages
    counts those in the document, share is their part of the item's passages, and answer_found tells
    whether the item's answer occurs in the document too (null for an item without one).  Words are the
    longest runs of letters or digits, compared without case and with composed letters; markup neither
    is a word nor interrupts a passage (:mod:`winnow.llm.wikitext`).

    Method: a BM25 index of the items travels to the documents.  Every window of ``passage`` words of a
    document is bounded by its words' largest impacts; what may reach a threshold is a query that
    retrieves, by block-max WAND, the items whose threshold it reaches, and these are verified word by
    word.  Nothing is shuffled.

    Defined cases: null and empty texts hold nothing; items with a null or wordless text can't leak;
    items or documents given twice are reported once for each row of the document; an empty table gives
    an empty result; texts are searched whole; other columns are ignored.  More than ``INDEX_ITEMS`` items or
    ``INDEX_CHARACTERS`` are searched in several indexes, so no index outgrows an executor; the words of the
    documents are taken from the markup once then, and kept in a checkpoint.
    """
    slim = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t"), F.col(item_answer).alias("a"))
    slim = slim.where("i is not null and t is not null").dropDuplicates(["i"])
    n, characters = slim.agg(F.count("*"), F.sum(F.length("t"))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-int(characters or 0) // INDEX_CHARACTERS))
    kind = df.schema[key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {item_kind}, passages int, share double, answer_found boolean"
    texts = spread(df.select(key, text))
    if parts > 1:
        texts = cut(texts.mapInArrow(_worded(key), f"`{key}` {kind}, words string"))
    out = None
    for part in range(parts):
        own = slim if parts == 1 else slim.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)
        index = build_index([tuple(r) for r in own.collect()], passage)
        shared = Shipped(df.sparkSession, index)
        found = texts.mapInArrow(_search(shared, key, item_kind, parts > 1), schema)
        out = found if out is None else out.unionAll(found)
    return out


def _worded(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(words(plain(t))) if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "words"])

    return run


def _search(shared, key: str, item_kind: str, worded: bool):
    numbers = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, item, count, share, answer = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                found = text.split(" ") if worded else words(plain(text))
                places = {p for query in passages(index, found) for p in retrieve(index, query)}
                if not places:
                    continue
                whole = f" {' '.join(found)} "
                for place in sorted(places):
                    hits = sum(g in whole for g in index.grams[place])
                    if hits:
                        rows.append(row)
                        item.append(index.ids[place])
                        count.append(hits)
                        share.append(hits / len(index.grams[place]))
                        answer.append(f" {index.answers[place]} " in whole if index.answers[place] else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(item, numbers),
                    pa.array(count, pa.int32()),
                    pa.array(share, pa.float64()),
                    pa.array(answer, pa.bool_()),
                ],
                names=[key, "item_id", "passages", "share", "answer_found"],
            )

    return run
