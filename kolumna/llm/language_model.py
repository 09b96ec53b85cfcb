"""Brown class-based bigram model: exchange clustering, class transitions, word emissions, smoothed log probabilities.

Training counts (all training rows; each text ends with an end token):
1. words, added up per task and then by word; the table of counts stays distributed;
2. pairs of neighbours among the CLUSTERED most frequent words (all others stand for their class of rare words, by
   length): at most (CLUSTERED + RARE + 1)**2 counts, whatever the corpus, which the driver clusters: each word in turn
   moves to the class that raises the likelihood of class pairs most, until a round moves few;
3. classes before and after every other word of the corpus, added up by word; each is exchanged into the class that
   raises the likelihood most, given those of step 2 (on executors, word by word; a neighbour beyond the REMEMBERED most
   frequent words stands for its length there);
4. class transitions of the whole corpus under all these classes. A word that occurs once and is not remembered also
   counts as one of its length, which is what words never seen are taken for.

Texts are taken apart twice: for step 1, and to be coded. Codes are kept as numbers of remembered words, and a text's other
words beside them, each with its neighbours of step 2; steps 2 to 4 and the scores are taken from that. Such a word's
rows, one a text, meet once: there it gets its count and its class, and its rows take them back to their texts. It has no more
training tokens than the last remembered word, so that its rows are few beside those of a task.

P(text) = product over tokens of P(class | previous class) * P(word | class), both with additive smoothing; unseen words,
with count 0, have the class of rare words of their length. The counts and classes of the REMEMBERED most frequent words
go to every task.

Rows: a null text counts as empty (its one token is the end). Ids may be null or repeated: rows are kept apart by
position. Other columns, whatever their names, are not looked at. Without training rows all counts are 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, fold, free, stored

CLUSTERED, CLASSES, RARE, REMEMBERED, ROUNDS = 1500, 48, 16, 65_536, 8
#: Additive smoothing of words and of class transitions.
WORD_PRIOR, CLASS_PRIOR = 0.1, 0.5
END = b""
#: Bytes of texts or codes that are looked at at a time, distinct words that are counted before they go on, rows at a time.
PIECE, HELD, ROWS = 2 << 20, 400_000, 20_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()
    for batch in chain(batches, [None]):
        for text in batch.column(0).to_pylist() if batch else ():
            c.update(words_of(text))
            c[END] += 1
        if c and (batch is None or len(c) > HELD):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])
            c.clear()


class Ids(dict):
    """Word -> its number. Words that are not held get the next ones, until forget()."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.n = len(words)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i

    def forget(self) -> list[bytes]:
        return [self.popitem()[0] for _ in range(len(self) - self.n)][::-1]


def _length(words: list[bytes]) -> np.ndarray:
    """The class of rare words of each word, from 0."""
    return np.minimum(np.fromiter(map(len, words), np.int64, len(words)), RARE) - 1


def _flat(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, one row after the other, and how many each row has (null: none)."""
    dtype = np.dtype(dtype)
    column = column.cast(pa.large_binary())
    n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not n.sum():
        return np.empty(0, dtype), n
    first = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype, int(n.sum()) // dtype.itemsize, first), n // dtype.itemsize


def _packed(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """The reverse of _flat."""
    offsets = np.r_[0, np.cumsum(n)] * values.dtype.itemsize
    if offsets[-1] >= 2**31:
        raise ValueError("the codes of one text, or of PIECE bytes of texts, take 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _between(values: np.ndarray, text: np.ndarray, texts: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' values with an end before the first text and after each, and where each token is there."""
    at = np.arange(len(values)) + text + 1
    out = np.full(len(values) + texts + 1, end, np.int64)
    out[at] = values
    return out, at


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE bytes in the column, one row at least."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.columns[column]).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.r_[0, np.flatnonzero(np.diff(total // PIECE)) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _coded(batches: Iterator[pa.RecordBatch], words: list[bytes], clustered: int) -> Iterator[pa.RecordBatch]:
    """A row for each text (doc_id, text, learn): its tokens' numbers among ``words``, and its distinct other words.

    The text's other word number k stands as -1 - k among the codes; lengths has the class of its length, words the word
    and, where learn is set, the units before and after each of its tokens: number among the first ``clustered`` words, or
    clustered + class of the length, or clustered + RARE for an end.
    """
    ids = Ids(words)
    unit = np.r_[np.arange(clustered), clustered + _length(words[clustered:])]
    end = clustered + RARE
    row = TaskContext.get().partitionId() << 40
    for part in _pieces(batches, 1):
        m = part.num_rows
        split = [words_of(x) for x in part.column(1).to_pylist()]
        n = np.fromiter(map(len, split), np.int64, m)
        code = np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        new = ids.forget()
        length = _length(new)
        text = np.repeat(np.arange(m), n)
        rare = np.flatnonzero(code >= ids.n)
        key, hole = np.unique(text[rare] * (len(new) + 1) + code[rare] - ids.n, return_inverse=True)
        of, word = np.divmod(key, len(new) + 1)
        start = np.searchsorted(of, np.arange(m + 1))
        units, at = _between(np.r_[unit, clustered + length][code], text, m, end)
        code[rare] = start[text[rare]] - hole - 1
        learn = part.column(2).to_numpy(zero_copy_only=False).astype(bool)[text[rare]]
        by_hole = np.argsort(hole[learn], kind="stable")
        at = at[rare[learn]][by_hole]
        near = np.stack([units[at - 1], units[at + 1]], 1).ravel().astype(np.min_scalar_type(end))
        of_word = [pa.array(new, pa.binary()).take(pa.array(word)), _packed(near, 2 * np.bincount(hole[learn], minlength=len(key)))]
        others = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.StructArray.from_arrays(of_word, names=["word", "near"]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + m)), part.column(0), _packed(code.astype(np.int32), n), _packed(length[word].astype(np.uint8), np.diff(start)),
             others, part.column(2)], names=["row", "doc_id", "codes", "lengths", "words", "learn"],
        )
        row += m


def _decoded(codes: pa.Array, lengths: pa.Array, unit: np.ndarray, clustered: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units with ends between the texts, the tokens' codes, and where each token is among the units. unit: of the words."""
    code, n = _flat(codes, np.int32)
    length, holes = _flat(lengths, np.uint8)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(holes) - holes
    units = np.empty(len(code), np.int64)
    rare = code < 0
    units[~rare] = unit[code[~rare]]
    units[rare] = clustered + length[first[text[rare]] - 1 - code[rare]].astype(np.int64)
    units, at = _between(units, text, len(n), clustered + RARE)
    return units, code, at


def _pairs(batches: Iterator[pa.RecordBatch], unit: np.ndarray, clustered: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring units, as left * size + right."""
    size = clustered + RARE + 1
    total = np.zeros(size * size, np.int64)
    for batch in _pieces(batches, 0):
        units, _, _ = _decoded(batch.column(0), batch.column(1), unit, clustered)
        total += np.bincount(units[:-1] * size + units[1:], minlength=size * size)
    (pair,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])


def _contexts(batches: Iterator[pa.RecordBatch], unit: np.ndarray, clustered: int, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For the words from number ``clustered`` on: how often each class stands before (from 0) and after (from size on).

    own: the class of each unit.
    """
    size = int(own.max()) + 1
    for batch in _pieces(batches, 0):
        units, code, at = _decoded(batch.column(0), batch.column(1), unit, clustered)
        x = np.flatnonzero(code >= clustered)
        word = code[x].astype(np.int64) * 2 * size
        key, n = np.unique(np.r_[word + own[units[at[x] - 1]], word + size + own[units[at[x] + 1]]], return_counts=True)
        word, first, many = np.unique(key // (2 * size), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word), _packed(key % (2 * size), many), _packed(n.astype(np.int64), many)], names=["word", "context", "n"])


def _best(x: np.ndarray, log_share: np.ndarray, log_size: np.ndarray) -> np.ndarray:
    """The best class of each word; its row has counts of the classes before it and after it.

    log_share[c, k]: log of the share of class k after class c. A word in class k also pays the logarithm of the class's
    size for each of its tokens.
    """
    t, classes = len(log_share), len(log_size)
    gain = x[:, :t] @ log_share[:, :classes] + x[:, t:] @ log_share[:classes].T - x[:, :t].sum(1, keepdims=True) * log_size
    return np.round(gain, 6).argmax(1)  # the first of equal ones, in whatever order they were added up


def _classed(batches: Iterator[pa.RecordBatch], log_share: np.ndarray, log_size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The best class of each word from rows of _contexts; all of a word's rows are here."""
    size = 2 * len(log_share)
    key, n = np.empty(0, np.int64), np.empty(0, np.int64)  # bounded by the words and the classes
    for batch in batches:
        context, many = _flat(batch.column(1), np.int64)
        word = np.repeat(batch.column(0).to_numpy(), many)
        key, at = np.unique(np.r_[key, word * size + context], return_inverse=True)
        n = np.bincount(at, np.r_[n, _flat(batch.column(2), np.int64)[0]]).astype(np.int64)
    words, at = np.unique(key // size, return_inverse=True)
    for lo in range(0, len(words), ROWS):
        i, j = np.searchsorted(at, [lo, lo + ROWS])
        m = min(ROWS, len(words) - lo)
        x = np.bincount((at[i:j] - lo) * size + key[i:j] % size, n[i:j], m * size).reshape(m, size)
        yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + m]), pa.array(_best(x, log_share, log_size).astype(np.int32))], names=["word", "class"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, which stand in order of the first column, in batches that end where one of its values does."""
    held: list[pa.RecordBatch] = []
    rows, size = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1]
        cut = batch.num_rows - pc.sum(pc.equal(batch.column(0), last)).as_py()
        whole = cut or (held and held[-1].column(0)[-1] != last)
        if whole and (rows + cut >= ROWS or size + batch.nbytes >= PIECE):
            yield _joined([*held, batch.slice(0, cut)])
            held, rows, size, batch = [], 0, 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _placed(batches: Iterator[pa.RecordBatch], own: np.ndarray, log_share: np.ndarray, log_size: np.ndarray, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """For each row of a word that is not remembered (word, row, hole, near), in order of words: what belongs there.

    c: the word's tokens in training texts; value: class + t * length for a word that occurs once, else its class, which
    is that of its length if it does not occur or there are no classes (log_size is empty). The first row of a word has
    the word itself, too.
    """
    t, classes = len(log_share), len(log_size)
    for batch in _runs(batches):
        word = batch.column(0)
        first = np.r_[True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]
        group = np.cumsum(first) - 1
        words = int(group[-1]) + 1
        near, many = _flat(batch.column(3), kind)
        at = np.repeat(group, many // 2) * 2 * t
        x = np.bincount(np.r_[at + own[near[::2]], at + t + own[near[1::2]]], minlength=words * 2 * t).reshape(words, 2 * t).astype(np.float64)
        c = x[:, :t].sum(1).astype(np.int64)
        length = np.minimum(pc.binary_length(word.filter(pa.array(first))).to_numpy(zero_copy_only=False).astype(np.int64), RARE)
        value = length + t - RARE - 2
        if classes:
            value = np.where(c > 0, _best(x, log_share, log_size) + (c == 1) * length * t, value)
        names = ["row", "hole", "value", "c", "word"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(value[group].astype(np.int32)), pa.array(c[group]),
             word.take(pa.array(np.arange(len(word)), mask=~first))], names=names,
        )


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, words: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each of the first ``words`` units of a pair-count list (left unit, right unit, count).

    Units beyond them have a class of their own each, classes, classes + 1, ... and do not move.
    """
    units = int(max(left.max(initial=-1), right.max(initial=-1), words - 1)) + 1
    own = np.concatenate([np.arange(words) % classes, classes + np.arange(units - words)])
    t = classes + units - words
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    l_at, r_at = np.searchsorted(left[by_left], np.arange(units + 1)), np.searchsorted(right[by_right], np.arange(units + 1))
    g = np.zeros((t, t))
    np.add.at(g, (own[left], own[right]), n)
    count = np.zeros(units)
    np.add.at(count, left, n)
    size = np.bincount(own, count, t)
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            out, into = by_left[l_at[w] : l_at[w + 1]], by_right[r_at[w] : r_at[w + 1]]
            self_n = n[out][right[out] == w].sum()
            r = np.bincount(own[right[out]], n[out] * (right[out] != w), t)
            c = np.bincount(own[left[into]], n[into] * (left[into] != w), t)
            a = own[w]
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= self_n
            size[a] -= count[w]
            fg = f(g)
            rows = (f(g + r) - fg)[:classes]
            cols = (f(g + c[:, None]) - fg)[:, :classes]
            k = np.arange(classes)
            gain = rows.sum(1) - rows[k, k] + cols.sum(0) - cols[k, k]
            gain += f(g[k, k] + r[:classes] + c[:classes] + self_n) - fg[k, k]
            gain -= 2 * (f(size[:classes] + count[w]) - f(size[:classes]))
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9 if a < classes else False:
                b = a
            g[b] += r
            g[:, b] += c
            g[b, b] += self_n
            size[b] += count[w]
            own[w] = b
            moved += b != a
        if moved <= words // 200:
            break
    return own


class Model:
    """What every task needs: the remembered words' counts, classes and the smoothed log10 tables."""

    def __init__(self, remembered: dict[bytes, int], words: list[bytes], own: np.ndarray, n: np.ndarray, v: np.ndarray, ends: int, tokens: int, distinct: int):
        """words: the remembered ones without the end; own: their classes, those of rare words by length, and the end's."""
        self.remembered = list(remembered)
        number = {w: i for i, w in enumerate(words)}
        self.unit_class = own
        self.end_class = int(own[-1])
        self.word_class = np.array([own[number[w]] if w in number else self.end_class for w in self.remembered], np.int64)
        self.log_count = np.log10(np.array([remembered[w] for w in words], np.float64) + WORD_PRIOR)
        self.ends, self.log_end = ends, math.log10(ends + WORD_PRIOR)
        self.log_class = np.log10(n + WORD_PRIOR * (v + 1))  # emission: log10(c + prior) - this
        self.tokens, self.distinct = tokens, distinct
        self.log_all = math.log10(tokens + WORD_PRIOR * (distinct + 1))
        self.transition = np.zeros((len(n), len(n)))

    def learn(self, g: np.ndarray) -> None:
        """Takes the counts of class pairs."""
        self.transition = np.log10((g + CLASS_PRIOR) / (g.sum(1, keepdims=True) + CLASS_PRIOR * len(g)))


def _gathered(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, n_known, logs, codes, holes, values of each text (see _fill).

    The rows (row, hole, doc_id, codes, value, c) stand in order of row and hole; hole -1 is the text, others are its words.
    """
    for batch in _runs(batches):
        hole = batch.column(1).to_numpy()
        texts = batch.filter(pa.array(hole < 0))
        words = batch.filter(pa.array(hole >= 0))
        m = texts.num_rows
        start = np.r_[np.flatnonzero(hole < 0) - np.arange(m), words.num_rows]
        code, n = _flat(texts.column(3), np.int32)
        text = np.repeat(np.arange(m), n)
        old = np.flatnonzero(code >= 0)
        new = np.flatnonzero(code < 0)
        c = words.column(5).to_numpy()[start[text[new]] - 1 - code[new]]
        log = np.empty(len(code))
        log[old] = model.log_count[code[old]]
        log[new] = np.log10(c + WORD_PRIOR)
        known = np.bincount(text[old], minlength=m) + np.bincount(text[new], c > 0, m).astype(np.int64) + (model.ends > 0)
        codes = code.copy()
        codes[old] = model.unit_class[code[old]]
        of = pa.array(start, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [texts.column(2), pa.array(n + 1), pa.array(known), pa.array(np.bincount(text, log, m) + model.log_end), _packed(codes, n),
             pa.ListArray.from_arrays(of, words.column(1)), pa.ListArray.from_arrays(of, words.column(4))],
            names=["doc_id", "n_tokens", "n_known", "logs", "codes", "holes", "values"],
        )


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last three columns (codes, holes, what belongs into each) as codes without holes."""
    for batch in batches:
        codes, n = _flat(batch.column(batch.num_columns - 3), np.int32)
        holes, values = batch.columns[-2:]
        many = pc.fill_null(pc.list_value_length(holes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(many) - many
        to = np.empty(int(many.sum()), np.int32)
        to[np.repeat(first, many) + holes.flatten().to_numpy()] = values.flatten().to_numpy()
        at = np.flatnonzero(codes < 0)
        out = codes.copy()
        out[at] = to[np.repeat(first, n)[at] - 1 - codes[at]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], _packed(out, n)], names=batch.schema.names[:-2])


def _class_pairs(batches: Iterator[pa.RecordBatch], t: int, end: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring classes (left * t + right) in filled codes, where c + l * t is class c, seen once, of length l."""
    total = np.zeros(t * t, np.int64)
    for batch in _pieces(batches, 0):
        codes, n = _flat(batch.column(0), np.int32)
        cls, at = _between(codes % t, np.repeat(np.arange(len(n)), n), len(n), end)
        once = np.flatnonzero(codes >= t)
        length = end - RARE + codes[once] // t - 1
        for left, right in ((cls[:-1], cls[1:]), (cls[at[once] - 1], length), (length, cls[at[once] + 1])):
            total += np.bincount(left * t + right, minlength=t * t)
    (pair,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])


def _paths(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The last column, filled codes, as the path: what class transitions and sizes add to the text's score."""
    t = len(model.log_class)
    for batch in _pieces(batches, -1):
        codes, n = _flat(batch.columns[-1], np.int32)
        text = np.repeat(np.arange(len(n)), n)
        cls, at = _between(codes % t, text, len(n), model.end_class)
        step = model.transition[cls[:-1], cls[1:]] - model.log_class[cls[1:]]  # into each token, and into each end
        ends = np.cumsum(n + 1) - 1
        path = np.bincount(text, step[at - 1], len(n)) + step[ends]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(path, pa.float64())], names=[*batch.schema.names[:-1], "path"])


def fit(training: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, remembered: int = REMEMBERED) -> tuple[Model, DataFrame]:
    """The model, and the table (word, c, class) of all training words. training: one binary column, text."""
    rows = training.select(F.lit(0).alias("doc_id"), "text", F.lit(True).alias("learn"))
    model, counts, coded, placed = classify(rows, clustered, classes, remembered)
    model.learn(transitions(filled(coded, placed, model), model))
    classed = placed.where("word is not null").select("word", (F.col("value") % len(model.log_class)).alias("class"))
    return model, counts.join(classed, "word", "left")


def filled(coded: DataFrame, placed: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, logs, codes of every text: its tokens' classes (see _class_pairs)."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters
    texts = coded.select("row", F.lit(-1).alias("hole"), "doc_id", "codes", F.lit(None).cast("int").alias("value"), F.lit(None).cast("long").alias("c"))
    words = placed.select("row", "hole", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("codes"), "value", "c")
    both = texts.unionAll(words).repartition("row").sortWithinPartitions("row", "hole")
    return stored(both.mapInArrow(lambda it: _fill(_gathered(it, shared.value)), f"doc_id {kind}, n_tokens long, n_known long, logs double, codes binary"), "filled")


def transitions(texts: DataFrame, model: Model) -> np.ndarray:
    """Counts of class pairs in filled texts."""
    t, end = len(model.log_class), model.end_class
    pairs = texts.select("codes").mapInArrow(lambda it: _class_pairs(it, t, end), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = pairs["pair"].to_numpy().astype(np.int64), pairs["n"].to_numpy().astype(np.float64)  # t**2 at most
    g = np.zeros((t, t))
    np.add.at(g, (pair // t, pair % t), n)
    return g


def classify(rows: DataFrame, clustered: int, classes: int, remembered: int) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model without class transitions, the counts (word, c), the coded texts, and what belongs into their holes.

    rows: doc_id, text (binary) and learn, whether it is a training text.
    """
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    counts = rows.where("learn").select("text").mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts, "words")
    length = F.least(F.octet_length("word"), F.lit(RARE))
    whole = counts.groupBy(length.alias("length")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    top = counts.orderBy(F.desc("c"), "word").limit(remembered).toArrow()  # bounded by the parameter
    kept = dict(zip(top["word"].to_pylist(), top["c"].to_pylist()))
    words = [w for w in kept if w != END]
    frequent = len(words[:clustered])
    held = spark.sparkContext.broadcast(words)
    schema = f"row long, doc_id {kind}, codes binary, lengths binary, words array<struct<word binary, near binary>>, learn boolean"
    coded = rows.select("doc_id", "text", "learn").mapInArrow(lambda it: _coded(it, held.value, frequent), schema)
    coded = stored(coded, "coded")
    unit = np.r_[np.arange(frequent), frequent + _length(words[frequent:])]
    training = coded.where("learn").select("codes", "lengths")
    pairs = training.mapInArrow(lambda it: _pairs(it, unit, frequent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    size = frequent + RARE + 1
    found = pairs.toArrow()  # bounded: size**2 pairs of units
    pair, n = found["pair"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)
    left, right = pair // size, pair % size
    k = max(1, min(classes, frequent))
    t = k + RARE + 1
    units = exchange(np.r_[left, size - 1], np.r_[right, size - 1], np.r_[n, 0.0], frequent, k)
    g = np.zeros((t, t))
    np.add.at(g, (units[left], units[right]), n)
    log_share = np.log((g + CLASS_PRIOR) / (g.sum(1, keepdims=True) + CLASS_PRIOR * t))
    log_size = np.log(np.maximum(g.sum(0)[: k if frequent else 0], 1.0))
    own = units[unit]
    if frequent < len(words):
        best = training.mapInArrow(lambda it: _contexts(it, unit, frequent, units), "word long, context binary, n binary")
        best = best.repartition("word").mapInArrow(lambda it: _classed(it, log_share, log_size), "word long, class int").toArrow()
        own[best["word"].to_numpy()] = best["class"].to_numpy()
    near = np.min_scalar_type(size - 1)
    others = coded.select("row", F.posexplode("words").alias("hole", "of")).select("of.word", "row", "hole", "of.near")
    others = others.repartition("word").sortWithinPartitions("word")
    placed = others.mapInArrow(lambda it: _placed(it, units, log_share, log_size, near), "row long, hole int, value int, c long, word binary")
    placed = stored(placed, "placed")
    n_class, v_class = np.zeros(t), np.zeros(t)
    for r in whole:
        c = k + r["length"] - 1 if r["length"] else k + RARE
        n_class[c] += r["n"]
        v_class[c] += r["v"]
    for w, c in zip(words, own):  # they are not in the rare class of their length
        rare = k + min(len(w), RARE) - 1
        n_class[rare] -= kept[w]
        v_class[rare] -= 1
        n_class[c] += kept[w]
        v_class[c] += 1
    if frequent:  # words that are not remembered leave the class of their length, but those seen once stand for unseen ones, too
        by_class = placed.where("word is not null and c > 0").groupBy(length.alias("length"), (F.col("value") % t).alias("class"))
        for r in by_class.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():
            rare = k + r["length"] - 1
            n_class[rare] += r["once"] - r["n"]
            v_class[rare] += r["once"] - r["v"]
            n_class[r["class"]] += r["n"]
            v_class[r["class"]] += r["v"]
    ends = sum(r["n"] for r in whole if not r["length"])
    tokens, distinct = sum(r["n"] for r in whole), sum(r["v"] for r in whole)
    model = Model(kept, words, np.r_[own, units[frequent:]], n_class, v_class, ends, tokens, distinct)
    return model, counts, coded, placed


def lm_scores(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod folds = 0), n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).cast("binary").alias("text"))
    held_out = fold(F.col("doc_id"), folds) == 0
    params = {"clustered": CLUSTERED, "classes": CLASSES, "remembered": REMEMBERED} | params
    model, _, coded, placed = classify(rows.withColumn("learn", ~held_out), **params)
    texts = filled(coded, placed, model)
    free(coded)
    free(placed)
    model.learn(transitions(texts.where(~held_out), model))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = texts.mapInArrow(lambda it: _paths(it, shared.value), f"doc_id {kind}, n_tokens long, n_known long, logs double, path double")
    return texts.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(model.log_all)).alias("base_score"),
        (F.col("logs") + F.col("path")).alias("score"),
    )
