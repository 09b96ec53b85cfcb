"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, exact, with components of the links.

A document is its set of word n-grams. Two sets of sizes a and b with Jaccard similarity >= num/den differ in at most
D(a, b) = floor((a + b) * (den - num) / (den + num)) n-grams.

Candidates
  Hashing deals the n-gram universe into segments; how many depends on the size band (bands grow by half). Take any
  Dmax(a) + 1 segments of a set, Dmax being the bound for its largest admissible partner: a partner differs in at most
  Dmax n-grams, so one of those segments is equal in both. Which segments are indexed is decided by content alone (the
  fullest first, ties by content hash), so that of two partners the one with the higher cut-off names a segment that the
  other has indexed too. In bands where the cost model prefers it (few, thin segments; see ``allocation``), half as many
  segments are indexed with their one-deletion neighbourhoods instead: one of them then differs in at most one n-gram.
  A set is filed in its own band and in every later one in which a larger partner may lie.

Skew
  Copies (equal sets) are combined in each task before they are filed, and each task sends one row per key. A key's
  members are compared with one leader, the member found in most shared keys (in a family of edited copies that is the
  original), not with each other. Only where a member is still apart from its leader's component are the remaining
  pairs of that key looked at, in tiles of bounded size (first by sketches that bound the difference, then by whole sets). Links are verified on the whole sets of n-grams (64-bit hashes of them).

Rows
  Null or blank texts have no n-grams and link with nothing; texts of fewer words than n count as one n-gram, the whole
  sequence. Rows with a null id get component null; rows that repeat an id count as one document with several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, free, stored, stored_parts, tidy
from kolumna.llm.components import components

WORDS, NUM, DEN = 5, 4, 5
#: Ratio of a band's largest size to its smallest.
BAND = 1.5
#: A task sends its keys off after so many rows.
FLUSH = 250_000
#: Rows of either side of a tile in which remaining pairs are compared.
TILE = 256
#: Rows of either side of a tile in which sketches are compared; what is left of it is parted into tiles of TILE.
WIDE = 1024
#: Joins with columns of texts are not parted into turns of fewer bytes than this.
TURN = 256 << 20
SALTS = 16
#: Keys are sorted by so many slices of the key space in turn, which bounds the shuffle files and spills on disk.
SLICES = 4
#: More ids than this are not broadcast but joined by a shuffle.
BROADCAST_IDS = 1_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray, by: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x + np.uint64(by * int(_A) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * _A + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def differences(a: int, b: int, num: int, den: int) -> int:
    return (a + b) * (den - num) // (den + num)


def most_differences(a: int, num: int, den: int) -> int:
    """The bound for a set of a n-grams and its largest admissible partner."""
    return differences(a, a * den // num, num, den)


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def band_top(band: int) -> int:
    """The largest size in a band."""
    top = int(BAND ** (band + 1)) + 1
    while band_of(top) > band:
        top -= 1
    return top


@lru_cache(maxsize=None)
def allocation(band: int, num: int, den: int, documents: int, share: float = 0.02) -> tuple[str, int]:
    """("exact" or "deletion", segments) for a band, whichever costs less among so many documents.

    Cost of a set: the rows it files, and the unrelated sets it meets, taking each n-gram to be common with probability
    ``share``, so that a key of t n-grams meets documents * share**t of them: the larger the table, the fuller the keys
    must be, which the one-deletion neighbourhoods buy with more rows. Either allocation finds every link.
    """
    top = band_top(band)
    bound = most_differences(top, num, den)
    fill = 0.85 * num / (den - num)  # n-grams in a segment that leave enough segments filled
    exact = max(bound + 1, math.ceil(top / fill))
    halved = (bound + 2) // 2
    cost_exact = (bound + 1) * (1 + documents * share ** (top / exact))
    cost_deletion = (top + halved) * (1 + documents * share ** max(top / halved - 1, 0))
    return ("exact", exact) if cost_exact <= cost_deletion else ("deletion", halved)


def segments(h: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A set's m segments in a band: (content sum and n-gram count of each; mixed hashes and their segments, in order)."""
    x = mixed(h, band * 8 + 1)
    segment = (x % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    x, at = mixed(x[order], 5), segment[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sums = np.zeros(m, np.uint64)
    sums[at[starts]] = np.add.reduceat(x, starts)
    return sums, np.bincount(at, minlength=m), x, at


def bands_of(size: int, num: int, den: int) -> set[int]:
    return set(range(band_of(size), band_of(max(size, size * den // num)) + 1))


def keys_of(h: np.ndarray, num: int, den: int, documents: int) -> np.ndarray:
    """The keys under which a set (sorted distinct hashes, not empty) is filed."""
    size, out = len(h), []
    for band in bands_of(size, num, den):
        how, m = allocation(band, num, den, documents)
        sums, count, x, at = segments(h, band, m)
        label = mixed(np.arange(m, dtype=np.uint64) + np.uint64(band * 8 + 1 << 32), 3)
        keys = mixed(sums ^ label)
        need = most_differences(size, num, den) + 1
        if how == "deletion":
            out.append(keys)  # equal, or the other set has one more
            out.append(mixed((sums[at] - x) ^ label[at]))  # one deleted
        elif need < m:  # the fullest segments; ties are broken by content, so both partners cut alike
            out.append(keys[np.lexsort((keys, -count))[:need]])
        else:
            out.append(keys)
    return np.unique(np.concatenate(out))


def sketch_bytes(band: int) -> int:
    """Size of a band's sketches: four bits for each n-gram of its largest set."""
    return 8 * math.ceil(4 * band_top(band) / 64)


def sketches_of(h: np.ndarray, num: int, den: int) -> bytes:
    """For each band a set is filed in: the band, and a bit for each of many parcels, whether its n-grams are odd in number.

    Of two sets of a band, no more bits differ than n-grams do, and hardly fewer.
    """
    out = []
    for band in sorted(bands_of(len(h), num, den)):
        size = sketch_bytes(band)
        parcel = (mixed(h, band * 8 + 2) % np.uint64(8 * size)).astype(np.int64)
        odd = (np.bincount(parcel, minlength=8 * size) & 1).astype(np.uint8)
        out.append(np.array([band], np.uint32).tobytes() + np.packbits(odd).tobytes())
    return b"".join(out)


def sketch_in(sketches: bytes, band: int) -> np.ndarray | None:
    """A set's sketch in a band, or None."""
    at = 0
    while at < len(sketches):
        own = int(np.frombuffer(sketches, np.uint32, 1, at)[0])
        size = sketch_bytes(own)
        if own == band:
            return np.frombuffer(sketches, np.uint8, size, at + 4)
        at += 4 + size
    return None


def _file(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, documents: int) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds (see SCHEMA); what: set (one for each document), key (one for each key), member (others)."""
    cache = WordHashes()
    sets: dict[bytes, list] = {}
    filed = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal filed
        ids, sizes, f1, f2, local = [], [], [], [], []
        owners, keys = [], []
        for print_, (members, size, own) in sets.items():
            a, b = np.frombuffer(print_, np.int64) if print_ else (0, 0)
            known = [i for i in members if i is not None]
            first = min(known, default=None)
            ids += members
            sizes += [size] * len(members)
            f1 += [int(a)] * len(members)
            f2 += [int(b)] * len(members)
            local += [first] * len(members)
            if own is not None and first is not None:
                owners.append(np.full(len(own), first, np.int64))
                keys.append(own)
        yield _batch("set", f1, ids, sizes, f2, local)
        if keys:
            key, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
            key, owner = key[fresh], owner[fresh]
            first = np.r_[True, key[1:] != key[:-1]]
            company = np.r_[first[1:] == False, False] & first  # noqa: E712
            for lo in range(0, len(key), 100_000):
                s = slice(lo, lo + 100_000)
                lead = first[s]
                yield _batch("key", key[s][lead], owner[s][lead], company[s][lead].astype(np.int32), None, None)
                if not lead.all():
                    yield _batch("member", key[s][~lead], owner[s][~lead], None, None, None)
        sets.clear()
        filed = 0

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.lower().split()
            h = shingle_hashes(words, n, cache)
            print_ = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else b""
            if print_ in sets:
                sets[print_][0].append(doc_id)
                filed += 1
                continue
            own = keys_of(h, num, den, documents) if len(h) else None
            sets[print_] = [[doc_id], len(h), own]
            filed += 1 + (len(own) if own is not None else 0)
            if filed > FLUSH:
                yield from flush()
    yield from flush()


SCHEMA = "key long, id long, n int, f2 long, local long, what string"
ARROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("f2", pa.int64()), ("local", pa.int64()), ("what", pa.string())])


def _batch(what: str, key, id_, n, f2, local) -> pa.RecordBatch:
    size = len(key)
    column = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [column(key, pa.int64()), column(id_, pa.int64()), column(n, pa.int32()), column(f2, pa.int64()), column(local, pa.int64()), pa.array([what] * size, pa.string())],
        schema=ARROW,
    )


def _sketched(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(id, its sketches, its size)."""
    cache = WordHashes()
    for batch in batches:
        sets = [shingle_hashes(t.lower().split(), n, cache) for t in batch.column(1).to_pylist()]
        sketches = [sketches_of(h, num, den) if len(h) else b"" for h in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary()), pa.array([len(h) for h in sets], pa.int32())], names=["id", "sketches", "size"])


def _hashed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(id, its set as bytes of sorted 64-bit hashes)."""
    cache = WordHashes()
    for batch in batches:
        sets = [shingle_hashes(t.lower().split(), n, cache).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "h"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs of ids whose sizes and sketches allow a link (columns: two ids, two sketches, two sizes)."""
    for batch in batches:
        keep = []
        for x, y, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            lo, hi = min(a, b), max(a, b)
            ok = 0 < den * lo and den * lo >= num * hi
            if ok:
                p, q = sketch_in(x, band_of(hi)), sketch_in(y, band_of(hi))
                ok = int(np.bitwise_count(p ^ q).sum()) <= differences(lo, hi, num, den)
            keep.append(ok)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["id", "other"])


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = common(x, y) if den * min(len(x), len(y)) >= num * max(len(x), len(y)) else 0
            keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def tile_links(ids: list, labels: list, roles: list, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between the apart (role 0) and others (role 1) under different labels, at most one for each row and label."""
    role, label, size = np.array(roles), np.array(labels), np.array([len(h) for h in sets])
    left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    if not len(left) or not len(right):
        return []
    lo, hi = np.minimum(size[left][:, None], size[right]), np.maximum(size[left][:, None], size[right])
    may = (label[left][:, None] != label[right]) & (den * lo >= num * hi)
    left, may = left[may.any(1)], may[may.any(1)]
    right, may = right[may.any(0)], may[:, may.any(0)]
    if not may.any():
        return []
    rows = np.r_[left, right]
    owner = np.repeat(np.arange(len(rows)), size[rows])
    _, token, times = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # hashes that only one set has cannot meet
    owner, token = owner[times[token] > 1], number[token[times[token] > 1]]
    both, step = np.zeros(may.shape, np.int64), 4096
    for at in range(0, int((times > 1).sum()), step):  # in slices, so that memory is bounded
        m = np.zeros((len(rows), step), np.float32)
        own = (token >= at) & (token < at + step)
        m[owner[own], token[own] - at] = 1
        both += np.rint(m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    hit = may & (both > 0) & (den * both >= num * (size[left][:, None] + size[right] - both))
    out = []
    for i in np.flatnonzero(hit.any(1)):
        js = right[hit[i]]
        _, one = np.unique(label[js], return_index=True)
        out += [(ids[left[i]], ids[j]) for j in js[one]]
    return out


def tile_hopeful(labels: list, roles: list, sizes: list, sketches: list[bytes], num: int, den: int) -> tuple:
    """(left rows, right rows, matrix): which pairs of a tile have sizes and sketches that allow a link."""
    role, label, size = np.array(roles), np.array(labels), np.array(sizes, np.int64)
    left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    lo, hi = np.minimum(size[left][:, None], size[right]), np.maximum(size[left][:, None], size[right])
    may = (label[left][:, None] != label[right]) & (den * lo >= num * hi)
    bound = (lo + hi) * (den - num) // (den + num)
    top = [band_of(max(int(x), 1)) for x in size]
    for band in set(top):  # a pair is compared in the larger set's band, in which the smaller one has a sketch too
        own = {i: x for i in range(len(size)) if (x := sketch_in(sketches[i], band)) is not None}
        ls, rs = [k for k, i in enumerate(left) if i in own], [k for k, i in enumerate(right) if i in own]
        if ls and rs:
            r = np.stack([own[right[k]] for k in rs])
            for k in ls:
                may[k, rs] &= np.bitwise_count(r ^ own[left[k]]).sum(1, dtype=np.int64) <= bound[k, rs]
    return left, right, may


def _by_tile(batches: Iterator[pa.RecordBatch], of_tile) -> Iterator[list]:
    """of_tile(rows) for each run of rows of one tile (the first three columns); rows come sorted, so one tile is held."""
    tile, rows = None, []
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != tile:
                out += of_tile(rows) if rows else []
                tile, rows = row[:3], []
            rows.append(row)
        yield out
    yield of_tile(rows) if rows else []


#: A tile with more hopeful pairs for each of its rows than this is checked as a whole; others list their pairs.
DENSE = 4


def _hopeful(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (id, other) that may have a link, or, of tiles with many, the rows concerned (other: null)."""

    def of_tile(rows: list) -> list:
        *_, ids, labels, roles, sizes, sketches = zip(*rows)
        left, right, may = tile_hopeful(labels, roles, sizes, sketches, num, den)
        if may.sum() <= DENSE * len(rows):
            return [(None, None, None, ids[left[i]], None, None, ids[right[j]]) for i, j in np.argwhere(may)]
        key, u, v = rows[0][:3]
        wide, out = 2 * WIDE // TILE, []  # a side is dealt by hash and holds somewhat more or fewer rows than WIDE
        for i in range(0, len(left), TILE):
            for j in range(0, len(right), TILE):
                own = may[i : i + TILE, j : j + TILE]
                at = (key, u * wide + i // TILE, v * wide + j // TILE)
                out += [(*at, *rows[k][3:6], None) for k in np.r_[left[i : i + TILE][own.any(1)], right[j : j + TILE][own.any(0)]]]
        return out

    names = ["key", "u", "v", "id", "label", "role", "other"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for out in _by_tile(batches, of_tile):
        columns = zip(*out) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _tiles(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    def of_tile(rows: list) -> list:
        *_, ids, labels, roles, sets = zip(*rows)
        return tile_links(ids, labels, roles, [np.frombuffer(h, np.uint64) for h in sets], num, den)

    for out in _by_tile(batches, of_tile):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids: a broadcast of the ids if their number, checked here, is small, else a shuffle join."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def jaccard_components(
    docs: DataFrame,
    n: int = WORDS,
    num: int = NUM,
    den: int = DEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    documents: int | None = None,
) -> DataFrame:
    """Each row's doc_id, n_shingles (size of its set) and component_id (smallest id reachable by links).

    documents: the table size that the cost model reckons with (default: the number of rows). It decides which segments
    are indexed, never which links are found.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).cast("binary").alias("text"))
    documents = rows.count() if documents is None else documents
    filed = stored(rows.mapInArrow(lambda it: tidy(_file(it, n, num, den, documents)), SCHEMA), "filed", "what")
    sets = filed.where("what = 'set'").select(F.col("key").alias("f1"), "f2", F.col("id").alias("doc_id"), "n", "local")
    classes = (
        sets.where("n > 0 and doc_id is not null")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )

    # keys with company: what each task has combined meets here, at most a row for each key and task
    mine = Window.partitionBy("key")

    def met(s: int) -> DataFrame:
        own = filed.where(F.pmod("key", F.lit(SLICES)) == s)
        sent = own.where("what = 'key'").select("key", "id", "n", F.count(F.lit(1)).over(mine).alias("c"))
        return sent.where("c > 1 or n = 1").select("key", "id").unionByName(own.where("what = 'member'").select("key", "id"))

    members = met_members = stored_parts([met(s) for s in range(SLICES)], "members")
    free(filed, "what=key")
    free(filed, "what=member")
    # many keys of a family have the same members: one of them is enough
    low = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).bitwiseAND(0xFFFFFFFF))
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), low(1).alias("s1"), low(2).alias("s2"))
    kept = groups.groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key", "c")
    weight = members.groupBy("id").agg(F.count(F.lit(1)).alias("w"))
    members = members.join(kept, "key").join(weight, "id")
    members = stored(members, "members")
    free(met_members)
    best = members.groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("best"))
    led = stored(members.join(best.select("key", (-F.col("best.i")).alias("leader")), "key").select("key", "c", "id", "leader"), "led")
    free(members)
    pairs = stored(led.where("id <> leader").select("id", F.col("leader").alias("other")).distinct(), "pairs")
    sketched = _texts_of(rows, _ids_of(pairs)).mapInArrow(lambda it: tidy(_sketched(it, n, num, den)), "id long, sketches binary, size int")
    sketched = stored(sketched, "sketched")
    # a larger table has more unrelated sets in a key, so these pairs grow faster than it: they meet their sketches in turn
    near = stored_parts(
        [
            _with_both(some, sketched, "sketches", "size").mapInArrow(lambda it: tidy(_near(it, num, den)), "id long, other long")
            for some in _in_turn(pairs, sketched)
        ],
        "near",
    )
    free(pairs)
    links = _checked(near, rows, n, num, den)

    # copies that different tasks have combined, and ids with several texts
    spread = classes.where("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    alike = sets.where("n > 0 and doc_id is not null").withColumn("salt", salt).join(spread, ["f1", "f2", "salt"])
    same = alike.where("doc_id = local and doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    again = (
        sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    )
    several = alike.join(again, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(links.unionByName(same).unionByName(several).distinct(), "links")
    label = components(links)

    more = _remaining(led, sketched, rows, label, n, num, den)
    if more is not None:
        label = components(links.unionByName(more))
    label = stored(label, "label")
    for dead in (led, near, sketched, links):
        free(dead)

    # each class's component goes back to its rows; rows alone in class and component need none
    found = (
        classes.join(label.select(F.col("node").alias("rep"), F.col("component").alias("to")), "rep", "left")
        .withColumn("to", F.coalesce("to", "rep"))
        .where("copies > 1 or to <> rep")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .select("f1", "f2", "salt", "to")
    )
    return (
        sets.withColumn("salt", salt)
        .join(found, ["f1", "f2", "salt"], "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("to", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def _with_both(pairs: DataFrame, hashed: DataFrame, *columns: str) -> DataFrame:
    """Pairs (id, other) with columns of both."""
    one = hashed.select("id", *[F.col(c).alias(f"{c}_1") for c in columns])
    two = hashed.select(F.col("id").alias("other"), *[F.col(c).alias(f"{c}_2") for c in columns])
    both = pairs.select("id", "other").join(one, "id").join(two, "other")
    return both.select("id", "other", *[f"{c}_{i}" for c in columns for i in (1, 2)])


def _ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id").alias("doc_id")).unionByName(pairs.select(F.col("other").alias("doc_id"))).distinct()


def _turns(rows: int, table: DataFrame, column: str) -> int:
    """In how many turns so many rows meet the column of a table, so that a turn sends no more than about the column."""
    total, own = table.agg(F.sum(F.length(column)), F.count(F.lit(1))).first()
    return max(1, math.ceil(rows * ((total or 0) / max(own, 1)) / max(total or 0, TURN)))


def _in_turn(pairs: DataFrame, table: DataFrame, column: str = "sketches") -> list[DataFrame]:
    """The pairs in parts whose joins with the table's column take a bounded multiple of its bytes on disk at a time."""
    k = _turns(pairs.count(), table, column)
    return [pairs.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(k)) == i) for i in range(k)]


def _checked(pairs: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those stored pairs (id, other) whose whole sets are similar enough; only the sets of their texts are written."""
    hashed = stored(_texts_of(rows, _ids_of(pairs)).mapInArrow(lambda it: tidy(_hashed(it, n)), "id long, h binary"), "hashed")
    parts = [_with_both(some, hashed, "h").mapInArrow(lambda it: tidy(_verify(it, num, den)), "a long, b long") for some in _in_turn(pairs, hashed, "h")]
    links = stored_parts(parts, "checked")
    free(hashed)
    return links


def _remaining(led: DataFrame, sketched: DataFrame, rows: DataFrame, label: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """Links among members of a key that are not yet in one component, beyond those with the leader; None if none."""
    own = label.select(F.col("node").alias("id"), F.col("component").alias("label"))
    lead = label.select(F.col("node").alias("leader"), F.col("component").alias("lead_label"))
    now = (
        led.where("c > 2")
        .join(own, "id", "left")
        .join(lead, "leader", "left")
        .select("key", "id", "leader", F.coalesce("label", "id").alias("label"), F.coalesce("lead_label", "leader").alias("lead_label"))
        .withColumn("apart", (F.col("label") != F.col("lead_label")).cast("int"))
    )
    now = stored(now, "now")
    open_ = now.groupBy("key").agg(F.sum("apart").alias("apart_n"), F.count(F.lit(1)).alias("all_n")).where("apart_n > 0")
    if open_.isEmpty():
        return None
    open_ = open_.select(
        "key", "apart_n", "all_n", F.ceil(F.col("apart_n") / WIDE).cast("int").alias("us"), F.ceil(F.col("all_n") / WIDE).cast("int").alias("vs")
    )
    dealt = open_.agg(F.sum(F.expr("apart_n * vs + all_n * us"))).first()[0]
    open_ = open_.select("key", "us", "vs")
    # a key may have very many members: they are dealt out before they meet its line
    salt = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)).cast("int")
    spread = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = now.where("id <> leader").withColumn("salt", salt).join(spread, ["key", "salt"]).drop("salt")
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rest.where("apart = 1").select("key", deal("us").alias("u"), all_of("vs").alias("v"), "id", "label", F.lit(0).alias("role"))
    right = rest.select("key", all_of("us").alias("u"), deal("vs").alias("v"), "id", "label", F.lit(1).alias("role"))
    sort = lambda df: df.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")
    # first by the short sketches, which clear away nearly all pairs that are no links, then by whole sets
    # rows of tiles grow with the square of a key's members: whole tiles take their turn, so that few are on disk at a time
    turns = _turns(dealt, sketched, "sketches")
    tile = "key long, u int, v int, id long, label long, role int, other long"

    def hopeful(turn: int) -> DataFrame:
        own = left.unionByName(right).where(F.pmod(F.xxhash64("key", "u", "v"), F.lit(turns)) == turn)
        tiles = own.join(sketched, "id").select("key", "u", "v", "id", "label", "role", "size", "sketches")
        return sort(tiles).mapInArrow(lambda it: tidy(_hopeful(it, num, den)), tile)

    hope = stored_parts([hopeful(i) for i in range(turns)], "hope")
    pairs = hope.where("other is not null").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    links = _checked(stored(pairs.distinct(), "pairs"), rows, n, num, den)
    dense = hope.where("other is null")
    hashed = _texts_of(rows, dense.select(F.col("id").alias("doc_id")).distinct()).mapInArrow(lambda it: tidy(_hashed(it, n)), "id long, h binary")
    hashed = stored(hashed, "hashed")
    of_turn = lambda k, i: dense.where(F.pmod(F.xxhash64("key", "u", "v"), F.lit(k)) == i).join(hashed, "id").select("key", "u", "v", "id", "label", "role", "h")
    k = _turns(dense.count(), hashed, "h")
    more = stored_parts([sort(of_turn(k, i)).mapInArrow(lambda it: tidy(_tiles(it, num, den)), "a long, b long") for i in range(k)], "tiles")
    links = stored(links.unionByName(more).distinct(), "more")
    return None if links.isEmpty() else links


def drop_near_copies(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id. Rows with a null id stay."""
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    name = next(x for x in (f"dropped_{i}" for i in range(len(docs.columns) + 1)) if x not in {c.lower() for c in docs.columns})
    dropped = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, F.col(f"`{id_col}`") == F.col(name), "left_anti")
