"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

Texts are compared as letters and digits in lower case; whatever stands between words counts as one blank. A benchmark
item is looked for by windows of WINDOW characters that overlap by half (a shorter item is one window), and if it is over
SHORT characters by windows of SHORT that start at every SHORT_STEP and at the end, so that each passage of at least
SHORT + SHORT_STEP - 1 characters holds one. A region within
k edits of a window of m characters shares at least m - q + 1 - k * q of its q-grams with it (q-gram lemma), and they lie
on diagonals that differ by at most k. So

1. hits: q-grams of the text that any window has; stretches with too few of them for any window are dropped;
2. bands: the remaining hits are counted by window and diagonal band; bands of width 2 (k + 1) overlap by half, so that
   every range of k + 1 diagonals lies within one; bands that meet the lemma's bound are kept;
3. alignment: a banded edit distance with free ends in the text decides.

The items are read into blocks of at most BLOCK_CHARS characters; a task holds one block's index. Benchmarks of more
characters take several passes over the documents. Texts are read whole, in pieces that overlap.

Null texts count as empty and match nothing, as do items of fewer than LEAST characters, which are too unspecific; ids
may be null or repeated (rows are looked at one by one). Other columns may have any names. An empty documents or
benchmark table gives no leaks and drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, stored, tidy

#: Items under Q characters have no q-gram; from Q to 2 * Q - 1 the budget is 0.
Q, ERRORS, WINDOW, LEAST = 8, 0.08, 128, 8
SHORT, SHORT_STEP = 64, 16
BLOCK_CHARS, PIECE = 1_500_000, 1 << 18
_BITS, _CELLS = 22, 21
_MULT = 0x9E3779B97F4A7C15


def _folding() -> np.ndarray:
    """Lower-case letter or digit of each BMP code point, or a blank."""
    table = np.full(0x10000, 32, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_FOLD: list[np.ndarray] = []


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Compared characters and the code-point offset of each; line feeds of U+0000 separate texts and stay."""
    if not _FOLD:
        _FOLD.append(_folding())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(raw < 0x10000, _FOLD[0][np.minimum(raw, 0xFFFF)], raw)
    c[raw == 0] = 0
    blank = c == 32
    keep = np.flatnonzero(~(blank & np.r_[True, blank[:-1] | (c[:-1] == 0)])) if len(c) else np.empty(0, np.int64)
    return c[keep], keep


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 characters from each position, by doubling."""
    h = c.astype(np.uint64) + np.uint64(1)
    m, size = _MULT, 1
    while size < Q:
        h = h[:-size] * np.uint64(m) + h[size:]
        m, size = m * m % 2**64, size * 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MULT)
    return h ^ (h >> np.uint64(29))


def budget(m: int) -> int:
    """Edits allowed for a window of m characters: the share ERRORS, as far as the lemma's bound stays positive."""
    return max(0, min(int(ERRORS * m), (m - Q) // Q))


def placed(n: int, width: int, step: int) -> list[int]:
    """Starts of the windows over n characters: every step, and the last place."""
    return [*range(0, n - width, step), n - width] if n > width else [0]


class Index:
    """Windows of a block of items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.chars = [], []
        for item_id, text in items:
            c, _ = normalised(text)
            c = c[: len(c) - 1] if len(c) and c[-1] == 32 else c
            if len(c) < LEAST:
                continue
            cut = [c[s : s + WINDOW] for s in placed(len(c), WINDOW, WINDOW // 2)]
            if len(c) > SHORT:
                cut += [c[s : s + SHORT] for s in placed(len(c), SHORT, SHORT_STEP)]
            self.item += [item_id] * len(cut)
            self.chars += cut
        size = np.array([len(c) for c in self.chars], np.int64)
        self.budget = np.array([budget(m) for m in size], np.int64)
        self.need = size - Q + 1 - self.budget * Q
        grams = [gram_hashes(c) for c in self.chars]
        key = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.r_[first, len(key)]
        self.window, self.offset = window[order], offset[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = int(self.need.min()) if len(grams) else 0
        self.span = int(size.max() + self.budget.max()) if len(grams) else 0


def edits(pattern: np.ndarray, text: np.ndarray, band: int) -> tuple[int, int, int]:
    """Least edit distance of pattern to a stretch of text (free ends), and the stretch; only diagonals within 0..band."""
    if len(text) >= len(pattern):  # most regions are plain copies
        plain = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(text, len(pattern)) == pattern).all(1))
        if len(plain):
            return 0, int(plain[0]), int(plain[0]) + len(pattern)
    width = band + 1
    at = np.arange(width)
    pad = np.full(len(pattern) + width, 0xFFFFFFFF, np.uint32)
    pad[: min(len(text), len(pad))] = text[: len(pad)]
    cost, begin = np.zeros(width, np.int64), at.copy()
    far = len(pattern) + width
    up, up_begin = np.full(width, far), np.zeros(width, np.int64)
    for i, ch in enumerate(pattern):
        best = cost + (pad[i : i + width] != ch)
        up[:-1], up_begin[:-1] = cost[1:] + 1, begin[1:]
        better = up < best
        best, start = np.where(better, up, best), np.where(better, up_begin, begin)
        reach = best - at
        low = np.minimum.accumulate(reach)
        cost, begin = low + at, start[np.maximum.accumulate(np.where(reach == low, at, 0))]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), min(end + len(pattern), len(text))


def find(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(offset of the match in text, its end, window, edits) of every window's best region, texts separated by U+0000."""
    c, offset = normalised(text)
    if len(c) < Q or not len(index.keys):
        return []
    h = gram_hashes(c)
    hit = index.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
    p = np.flatnonzero(hit)
    if len(p) < index.least:
        return []
    # hits with fewer than the least bound in any stretch around them cannot count
    if index.least > 1:
        ok = np.zeros(len(p), bool)
        n = index.least
        close = np.flatnonzero(p[n - 1 :] - p[: len(p) - n + 1] <= index.span)
        mark = np.zeros(len(p) + 1, np.int64)
        np.add.at(mark, close, 1)
        np.add.at(mark, close + n, -1)
        ok = np.cumsum(mark)[:-1] > 0
        p = p[ok]
    k = np.searchsorted(index.keys, h[p])
    k = np.minimum(k, len(index.keys) - 1)
    own = index.keys[k] == h[p]
    p, k = p[own], k[own]
    if not len(p):
        return []
    times = index.first[k + 1] - index.first[k]
    total = int(times.sum())
    step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    post = np.repeat(index.first[k], times) + step
    window, diagonal = index.window[post], np.repeat(p, times) - index.offset[post]
    half = index.budget[window] + 1
    low = diagonal // half
    found = {}
    # band b covers diagonals of halves b and b + 1; a gram counts once for each place in the window
    key = np.concatenate([window << np.int64(40) | (low + 1), window << np.int64(40) | low])
    # counted in hashed cells first: a cell counts at least as many as each of its bands
    cell = (key.astype(np.uint64) * np.uint64(_MULT) >> np.uint64(64 - _CELLS)).astype(np.int64)
    full = np.flatnonzero(np.bincount(cell, minlength=1 << _CELLS)[cell] >= np.tile(index.need[window], 2))
    key, place = key[full], np.tile(index.offset[post], 2)[full]
    if not len(key):
        return []
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])]
    bands, count = np.unique(key[fresh], return_counts=True)
    owner = bands >> np.int64(40)
    for band, w in zip(bands[count >= index.need[owner]], owner[count >= index.need[owner]]):
        w = int(w)
        start = (int(band) & ((1 << 40) - 1)) - 1
        size, allowed = len(index.chars[w]), int(index.budget[w])
        lo = max(0, start * (allowed + 1) - allowed)
        stretch = c[lo : lo + size + 4 * (allowed + 1)]
        cost, a, b = edits(index.chars[w], stretch, 4 * (allowed + 1))
        if cost <= allowed and 0 not in stretch[a:b]:
            best = found.get((w, lo + a))
            if best is None or cost < best[1]:
                found[w, lo + a] = (lo + b, cost)
    return [(int(offset[a]), int(offset[max(b - 1, a)]) + 1, w, cost) for (w, a), (b, cost) in found.items()]


def _search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """One row for each document and item: doc row number is kept by position, so repeated ids stay apart."""
    lap = 4 * (WINDOW + 64)
    for batch in batches:
        rows: dict[tuple[int, int], list] = {}

        def add(row: int, base: int, a: int, b: int, w: int, cost: int) -> None:
            own = rows.setdefault((row, index.item[w]), [a + base, b + base, cost, set()])
            own[0], own[1], own[2] = min(own[0], a + base), max(own[1], b + base), min(own[2], cost)
            own[3].add(w)

        texts = batch.column(1).to_pylist()
        group: list[int] = []
        held = 0

        def flush() -> None:
            if not group:
                return
            starts = np.cumsum([0, *(len(texts[i]) + 1 for i in group)])
            for a, b, w, cost in find("\0".join(texts[i].replace("\0", " ") for i in group), index):
                j = int(np.searchsorted(starts, a, side="right")) - 1
                add(group[j], -int(starts[j]), a, b, w, cost)
            group.clear()

        for i, text in enumerate(texts):
            if len(text) > PIECE:
                for lo in range(0, len(text), PIECE):
                    for a, b, w, cost in find(text[lo : lo + PIECE + lap].replace("\0", " "), index):
                        add(i, lo, a, b, w, cost)
                continue
            if held + len(text) > PIECE:
                flush()
                held = 0
            group.append(i)
            held += len(text)
        flush()
        held = 0
        keys = list(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())),
                pa.array([item for _, item in keys], pa.int64()),
                *(pa.array([rows[k][j] for k in keys], pa.int64()) for j in range(3)),
                pa.array([len(rows[k][3]) for k in keys], pa.int64()),
            ],
            names=["doc_id", "item_id", "match_start", "match_end", "edits", "windows"],
        )


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items with a text, in lists of at most ``limit`` characters (longer single items alone)."""
    own, size = [], 0
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & (F.length("text") >= LEAST)).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if own and size + len(r["text"]) > limit:
            yield own
            own, size = [], 0
        own.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if own:
        yield own


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, match_start, match_end, edits, windows) for each row and item that it holds a passage of.

    match_start and match_end (code points) enclose all of the item's regions in the text; edits: of the closest window.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, match_start long, match_end long, edits long, windows long"
    out = held = None
    for items in blocks(benchmark):
        if held is not None:  # so that the tasks hold one block's index at a time, the pass before is written out
            out = stored(out, "leaks")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(Index(items))  # bounded by BLOCK_CHARS
        part = rows.mapInArrow(lambda it, index=held: tidy(_search(it, index.value)), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean_only(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(1)], names=["doc_id", "text"])
        bad = {x for out in _search(iter([numbered]), index) for x in out.column(0).to_pylist()}
        yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())).select([0, 1])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark passage; other rows and all columns are unchanged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), clean_text(F.col(text_col)).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"
    held = None
    for items in blocks(benchmark):
        if held is not None:
            rows = stored(rows, "clean")
            held.unpersist()
        held = index = docs.sparkSession.sparkContext.broadcast(Index(items))
        rows = rows.mapInArrow(lambda it, index=index: tidy(_clean_only(it, index.value)), schema)
    return rows.select("row.*")
