"""SentencePiece encoding and decoding by a max-plus scan over the lattice of pieces.

The pieces and scores of a model file span a lattice over the text (blanks become U+2581, one is put in front). The best
path maximises the sum of scores; in (max, +) algebra a stretch of text is a matrix from the states at its left edge to
those at its right edge, a state being the number of characters by which a piece reaches over the edge. Such matrices
combine associatively, so

* a text of more than GIANT characters is cut into chunks of CHUNK characters, wherever the cuts fall. Each chunk yields
  its transfer matrix; prefix products, by halving, give the best score of every state at every cut; from these each
  chunk is solved and traced back on its own (``best_chunked``). GROUP chunks are held at a time;
* in a shorter text a word, between edges that no piece crosses, is a 1x1 matrix: words are solved independently (all
  distinct words of a batch at once, as array operations) and remembered. Unbroken runs over RUN are cut, too.

Both give the path of a recurrence over the whole text: scores are whole numbers added exactly; of equally good paths
the one whose last piece is longest wins, and so on towards the front. Characters without a piece cost less than any
piece and become byte pieces.

The model file at hand orders its pieces by rank (a BPE vocabulary, whose scores are negative ranks, not likelihoods). A
piece of rank r is taken to have the probability 1 / (r + RANK_SHIFT) of Zipf's law, up to a constant; log-probabilities
of a unigram file are taken as they are. Nothing is trained.

Rows: a null text counts as empty; the empty text has no ids. Rows are encoded one by one, so ids may be null or
repeated; other columns may have any names; an empty table gives an empty result. decode() inverts encode() exactly,
except that a U+2581 that stood in the text comes back as a blank (round_trip is false there), as in the library.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, tidy

SPACE = "▁"
CHUNK, GROUP, GIANT, RUN = 256, 1024, 32_768, 2048
#: Words remembered before the older ones go that have not been met since.
REMEMBERED = 100_000
#: Log-probabilities are kept as whole multiples of 1 / UNIT.
UNIT, RANK_SHIFT = 1e6, 10
#: An unknown character costs this much more than the worst piece (fixed value of the library).
UNKNOWN = 10.0
_NEVER = -1e300


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model file for look-up by hash, and by id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = {self.pieces[i]: sp.get_score(i) for i in plain}
        if all(x == int(x) for x in raw.values()):  # negative ranks
            raw = {p: -math.log(RANK_SHIFT - x) for p, x in raw.items()}
        self.score = {p: float(round(x * UNIT)) for p, x in raw.items()}
        self.id = {self.pieces[i]: i for i in plain}
        self.longest = max(map(len, self.id))
        self.unknown = min(self.score.values()) - UNKNOWN * UNIT
        inner = {c for p in self.id if len(p) > 1 for c in p}
        #: A blank starts a word unless a piece has a blank after something else; lone characters stand for themselves.
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        alone = "\n" if "\n" not in inner else ""
        self.words = re.compile(r"(?s).+" if crossing else rf"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._table()

    def _table(self) -> None:
        """Hash table of pieces: slot -> (check hash, id, score), for whole arrays of substrings."""
        rng = np.random.default_rng(5)
        self.mult = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        hashes = np.array([self._hash(p) for p in self.id], np.uint64)
        if len(set(hashes.tolist())) < len(hashes):
            raise ValueError("pieces collide")
        order = np.argsort(hashes)
        self.hashes, ids = hashes[order], np.fromiter(self.id.values(), np.int64)[order]
        self.ids, self.scores = ids, np.array([self.score[self.pieces[i]] for i in ids])
        bits = 20
        self.shift = np.uint64(64 - bits)
        slot = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange(2**bits + 1))
        self.depth = int(np.diff(self.first).max())

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(self.mult)) % 2**64
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index into ids and scores for each hash, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int64)
        for d in range(self.depth):
            live = np.flatnonzero(at + d < end)
            if not len(live):
                break
            k = at[live] + d
            hit = self.hashes[k] == h[live]
            out[live[hit]] = k[hit]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def edges(codes: np.ndarray, length: np.ndarray, v: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """For piece lengths 1, 2, ...: score and index of the piece that starts at each position of each row (padded)."""
    n, width = codes.shape
    h = np.zeros((n, width), np.uint64)
    out = []
    for size in range(1, min(v.longest, width) + 1):
        m = width - size + 1
        h = (h[:, :m] + codes[:, size - 1 :] + np.uint64(1)) * v.mult
        inside = np.arange(m) + size <= length[:, None]
        k = np.full(h.shape, -1, np.int64)
        k[inside] = v.lookup(h[inside])
        score = np.where(k >= 0, v.scores[k], v.unknown if size == 1 else _NEVER)
        out.append((np.where(inside, score, _NEVER), k))
    return out


def best_words(words: list[str], v: Vocabulary) -> list[tuple[int, ...]]:
    """Ids of the best path of each word: the max-plus recurrence over all words at once, then the way back."""
    out: list[tuple[int, ...]] = [()] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > RUN:
            out[i] = best_chunked(w, v)
        else:
            by_width.setdefault(1 << max(2, (len(w) - 1).bit_length()), []).append(i)
    for width, members in by_width.items():
        step = max(1, 200_000 // width)
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            length = np.array([len(words[i]) for i in part])
            text = "".join(words[i].ljust(width, "\0") for i in part)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), width).astype(np.uint64)
            e = edges(codes, length, v)
            best = np.full((width + 1, len(part)), _NEVER)
            back = np.zeros((width + 1, len(part)), np.int16)
            best[0] = 0
            for end in range(1, width + 1):
                for size in range(min(len(e), end), 0, -1):  # the longest first: it wins ties
                    score = best[end - size] + e[size - 1][0][:, end - size]
                    better = score > best[end]
                    best[end][better], back[end][better] = score[better], size
            for r, (i, ids) in enumerate(zip(part, trace_all(back, length, e, v))):
                out[i] = ids if ids is not None else trace(words[i], back[:, r], e, r, v)
    return out


def trace_all(back: np.ndarray, length: np.ndarray, e: list, v: Vocabulary) -> list[tuple[int, ...] | None]:
    """The ids on every row's way back, a step for all rows at a time; None where a character has no piece."""
    n = len(length)
    row, end, steps, known = np.arange(n), length.astype(np.int64), [], np.ones(n, bool)
    k_of = np.full((len(e), n, back.shape[0] - 1), -1, np.int64)
    for size, (_, k) in enumerate(e):
        k_of[size, :, : k.shape[1]] = k
    while (live := end > 0).any():
        size = np.where(live, back[end, row], 1).astype(np.int64)
        k = k_of[size - 1, row, np.maximum(end - size, 0)]
        known &= ~live | (k >= 0)
        steps.append(np.where(live & (k >= 0), v.ids[k], -1))
        end = np.where(live, end - size, 0)
    ids = np.stack(steps[::-1], 1)
    at = np.r_[0, np.cumsum((ids >= 0).sum(1))].tolist()
    flat = ids[ids >= 0].tolist()
    return [tuple(flat[a:b]) if ok else None for a, b, ok in zip(at, at[1:], known.tolist())]


def trace(word: str, back: np.ndarray, e: list, row: int, v: Vocabulary, end: int | None = None) -> tuple[int, ...]:
    ids: list[int] = []
    end = len(word) if end is None else end
    while end > 0:
        size = int(back[end])
        k = e[size - 1][1][row, end - size]
        if k >= 0:
            ids.append(int(v.ids[k]))
        else:
            ids += [v.byte[b] for b in reversed(word[end - size : end].encode("utf-8", "surrogatepass"))]
        end -= size
    return tuple(reversed(ids))


def ending(codes: np.ndarray, length: np.ndarray, v: Vocabulary, chunk: int) -> np.ndarray:
    """Scores of the pieces that start within ``chunk`` characters: (end, longest - size, chunk row)."""
    out = np.full((chunk + v.longest, v.longest, len(codes)), _NEVER)
    for size, (score, _) in enumerate(edges(codes, length, v), 1):
        m = min(chunk, score.shape[1])
        out[size : size + m, v.longest - size] = score[:, :m].T
    return out


def solved(pieces: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores at every position of each chunk from those of its states, and the size of the last piece (0: none).

    pieces: ending(); start: (states, rows). The longest piece is looked at first, so it wins ties, and a piece that
    reaches in from the left is longer than any that starts inside.
    """
    ends, longest, rows = pieces.shape
    best = np.full((longest + ends, rows), _NEVER)  # position p is at p + longest
    best[longest : 2 * longest] = start
    size = np.zeros((ends, rows), np.int16)
    for end in range(1, ends):
        score = best[end : end + longest] + pieces[end]
        k = score.argmax(0)
        top = np.take_along_axis(score, k[None], 0)[0]
        better = top > best[longest + end]
        best[longest + end][better] = top[better]
        size[end][better] = longest - k[better]
    return best[longest:], size


def transfer(pieces: np.ndarray, chunk: int) -> np.ndarray:
    """The chunks' transfer matrices (row, left state, right state).

    Left state i: a piece reaches i characters into the chunk. Right state j: one reaches j characters behind it.
    """
    ends, longest, rows = pieces.shape
    best = np.full((longest + ends, rows, longest), _NEVER)
    for i in range(longest):
        best[longest + i, :, i] = 0.0
    for end in range(1, ends):
        np.maximum(best[longest + end], (best[end : end + longest] + pieces[end][:, :, None]).max(0), out=best[longest + end])
    return best[longest + chunk : 2 * longest + chunk].transpose(1, 2, 0)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product (of two matrices, or of two stacks of them, one by one)."""
    return np.stack([(a[..., i, :, None] + b).max(-2) for i in range(a.shape[-2])], -2)


def prefixes(matrices: np.ndarray) -> np.ndarray:
    """The product of each matrix with all before it, by halving: those of pairs give every second one, a product more the rest."""
    if len(matrices) < 2:
        return matrices
    out = matrices.copy()
    out[1::2] = prefixes(np.maximum(combine(matrices[:-1:2], matrices[1::2]), _NEVER))
    rest = matrices[2::2]
    out[2::2] = np.maximum(combine(out[1::2][: len(rest)], rest), _NEVER)
    return out


def best_chunked(text: str, v: Vocabulary, chunk: int = CHUNK, group: int = GROUP) -> tuple[int, ...]:
    """Ids of the best path of a long text: transfer matrices by chunk, prefix products, each chunk's own way back."""
    longest, n = v.longest, len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.arange(0, n, chunk)
    reach = chunk + longest
    state = np.full(longest, _NEVER)
    state[0] = 0.0
    sizes, origins = [], []
    for lo in range(0, len(cuts), group):
        at = cuts[lo : lo + group]
        length = np.minimum(n - at, reach)
        own = np.zeros(int(at[-1] - at[0]) + reach, np.uint64)
        piece_of = codes[at[0] : at[0] + len(own)]
        own[: len(piece_of)] = piece_of
        pieces = ending(np.lib.stride_tricks.sliding_window_view(own, reach)[::chunk][: len(at)], length, v, chunk)
        states = combine(state[None, None, :], prefixes(transfer(pieces, chunk)))[:, 0]
        start = np.concatenate([state[None], states[:-1]])
        state = states[-1]
        _, size = solved(pieces, start.T)
        # where the way back from each position behind the chunk's right edge enters the chunk
        end = np.repeat(np.arange(chunk, reach)[:, None], len(at), 1)
        column = np.arange(len(at))[None, :]
        while (back := size[end, column]).any():
            end = end - back
        sizes.append(size), origins.append(end.T)
    size, origin = np.concatenate(sizes, 1).T, np.concatenate(origins)
    goal, last = np.zeros(len(cuts), np.int64), n - int(cuts[-1])
    goal[-1] = last
    for i in range(len(cuts) - 2, -1, -1):  # the state at each cut, from the right
        if i == len(cuts) - 2:
            end = last
            while size[i + 1, end]:
                end -= int(size[i + 1, end])
        else:
            end = int(origin[i + 1, goal[i + 1] - chunk])
        goal[i] = chunk + end
    edge = np.zeros(n + reach, bool)  # ends of pieces
    end, row = goal.copy(), np.arange(len(cuts))
    while (back := size[row, end]).any():
        live = back > 0
        edge[(cuts + end)[live]] = True
        end = end - back
    ends = np.flatnonzero(edge[: n + 1]).tolist()
    ids: list[int] = []
    for a, b in zip([0, *ends], ends):
        i = v.id.get(text[a:b])
        if i is None:
            ids += [v.byte[x] for x in text[a:b].encode("utf-8", "surrogatepass")]
        else:
            ids.append(i)
    return tuple(ids)


class Encoder:
    """Encodes texts, remembering the words it has solved."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        #: The ids of each word solved, packed as 32-bit numbers; and the words that decoding would not give again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def split(self, text: str) -> list[str]:
        return self.v.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x, _ in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """The ids of each text as 32-bit numbers, and whether decoding them gives the text again.

        Words are decoded when they are solved: a text comes back if its words, joined, are the text and each comes back.
        """
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        parts = [None if len(t) > GIANT else self.split(t) for t in texts]
        known, older, lossy = self.known, self.older, self.lossy
        new = list({w for p in parts if p for w in p if w not in known})
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older]
        found = best_words(new, self.v)
        known.update((w, array("i", ids).tobytes()) for w, ids in zip(new, found))
        if surface(list(chain.from_iterable(found)), self.v) != "".join(new):
            lossy.update(w for w, ids in zip(new, found) if surface(ids, self.v) != w)
        out = []
        for p, t in zip(parts, texts):
            if p is None:
                ids = best_chunked(SPACE + t.replace(" ", SPACE), self.v)
                out.append((np.array(ids, np.int32).tobytes(), decode(ids, self.v) == t))
            else:
                back = SPACE not in t and (not t or sum(map(len, p)) == len(t) + 1) and (not lossy or lossy.isdisjoint(p))
                out.append((b"".join(map(known.__getitem__, p)), back))
        return out


def surface(ids, v: Vocabulary) -> str:
    """Pieces joined, byte pieces as UTF-8."""
    if v.value.keys().isdisjoint(ids):
        return "".join([v.pieces[i] for i in ids])
    out = bytearray()
    for i in ids:
        out += bytes([v.value[i]]) if i in v.value else v.pieces[i].encode()
    return out.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that words are remembered from task to task."""
    return Encoder(path)


def decode(ids, v: Vocabulary) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, marks as blanks, the first of which is dropped."""
    text = surface(ids, v).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _encode(batches: Iterator[pa.RecordBatch], path: str, at: int, check: bool) -> Iterator[pa.RecordBatch]:
    """The columns (without the text at ``at`` if check), then ids, n_tokens and, if check, whether decoding gives the text."""
    own = encoder(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [t.decode("utf-8", "replace") for t in part.column(at).to_pylist()]
            ids = own.packed(texts)
            size = np.array([len(x) // 4 for x, _ in ids], np.int32)
            flat = pa.array(np.frombuffer(b"".join([x for x, _ in ids]), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), flat)
            rest = [i for i in range(batch.num_columns) if i != at]
            columns = [*(part.column(i) for i in rest), lists, pa.array(size.astype(np.int64))]
            names = [*(batch.schema.names[i] for i in rest), "ids", "n_tokens"]
            if check:
                columns.append(pa.array([back for _, back in ids], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (decoding gave the text again) of every row."""
    path = model or default_model()
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: tidy(_encode(it, path, 1, True)), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def with_tokens(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with two more columns, token_ids and n_tokens (numbered on if the table has such names already)."""
    path = model or default_model()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), clean_text(F.col(text_col)).cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: tidy(_encode(it, path, 1, False)), f"row {kind}, ids array<int>, n_tokens long")

    def free_name(name: str) -> str:
        taken = {c.lower() for c in docs.columns}
        return next(x for x in (name, *(f"{name}_{i}" for i in range(2, 1000))) if x not in taken)

    return out.select("row.*", F.col("ids").alias(free_name("token_ids")), F.col("n_tokens").alias(free_name("n_tokens")))
