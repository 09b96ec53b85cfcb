"""Personal data: fixed formats, and candidates that boosted trees accept by format and context.

Generators of high recall propose spans, which may overlap: obfuscated addresses, runs of digits and separators, dotted
numbers in brackets, colon-separated hexadecimal groups, bank account numbers. Their features are format (lengths,
groups, separators, check digit, range of the parts) and context (words before, characters around).

No table says which candidates are personal data, so the trees learn from made cases, at most MAX_CANDIDATES of each
label: positive is a span of the fixed formats, rewritten as people disguise or reformat it (``disguises``) and put back
in its own context; negative are the same rewritings with other digits (``spoilt``) and those of the corpus's own free
candidates that a first fit does not take for personal data.
Isotonic calibration on made cases kept out gives probabilities; a candidate that touches no fixed span is added where
its probability reaches ``least``. The fixed spans always stay.

Rows: a null text counts as empty; offsets are code points. Every row is looked at whole, and each on its own, so ids may
be null or repeated. Other columns, whatever their names, are not looked at. An empty table gives an empty result.
Without a span of the fixed formats in any row there is nothing to learn from, and nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, stored
from kolumna.llm.models import BoostedTrees, isotonic

# The order of kinds, the bounds of the formats.
KINDS = ("email", "ip", "card", "phone")
MAX_CANDIDATES, LEAST = 20_000, 0.9
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[^\s<>()\[\],;:\"']{1,64}\s?(?:@|[\[({]\s?at\s?[\])}]|\sat\s)\s?[^\s<>()\[\],;:\"'@]{1,80}?(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z]{2,12}\b")
_DIGITS = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\-/]{0,3}[0-9]){6,24}(?![0-9A-Za-z])")
_DOTTED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|[\[({]dot[\])}]|\sdot\s)\s?[0-9]{1,3}){3}(?![0-9A-Za-z])", re.I)
_V6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_CUES = tuple(re.compile(p, re.I) for p in (r"mail|contact|write|send", r"tel|phone|call|mobil|cell|fax", r"card|visa|master|amex|credit|payment", r"\bip\b|host|server|address|client", r"iban|account|bank|ssn|social|passport|licen[cs]e"))
_SOME, _AT_WORD = re.compile(r"[0-9@]"), re.compile(r"\bat\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats: each kind's leftmost non-overlapping matches that pass its test."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in _CHAIN.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                start = at + sum(len(p) + 1 for p in parts[:i])
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((1, start, start + sum(map(len, four)) + 3))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out)


def kind_of(s: str) -> int:
    """The kind that a run of digits and separators is proposed as."""
    n = sum(c.isdigit() for c in s)
    return 1 if s.count(".") == 3 and n <= 12 and not re.search(r"[ ()/-]", s) else 3 if n < 13 else 2


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) proposed by the generators; spans may overlap."""
    out = []
    if "@" in text or _AT_WORD.search(text):
        out += [(0, *m.span()) for m in _AT.finditer(text)]
    out += [(1, *m.span()) for m in _DOTTED.finditer(text)]
    out += [(kind_of(m.group()), *m.span()) for m in _DIGITS.finditer(text)]
    if ":" in text:
        out += [(1, *m.span()) for m in _V6.finditer(text)]
    out += [(2, *m.span()) for m in _IBAN.finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    return described(kind, text[start:end], text[max(0, start - 40) : start], text[end : end + 2])


def described(kind: int, s: str, before: str, after: str) -> list[float]:
    """The features of a candidate s of a kind between two stretches of text."""
    parts = re.findall(r"[0-9]+", s)
    groups = [len(g) for g in parts] or [0]
    digits, letters = sum(groups), sum(c.isalpha() for c in s)
    return [
        kind, len(s), digits, letters, len(groups), groups[0], groups[-1], max(groups), min(groups),
        s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"), s.count("/"), s.count(":"), s.count("@"),
        s[0] == "+", len(s.rpartition(".")[2]) if kind == 0 else 0,
        digits >= 12 and luhn("".join(parts)), len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts),
        s.count("["), " at " in s.lower() or "at]" in s.lower() or "at)" in s.lower(), " dot " in s.lower() or "dot]" in s.lower(),
        not before or before[-1].isspace(), not after or after[0].isspace() or after[0] in ".,;)",
        *(bool(c.search(before)) for c in _CUES),
    ]


WIDTH = 25 + len(_CUES)


def disguises(kind: int, s: str) -> list[str]:
    """A span of a fixed format as people write it to hide it, or in another layout."""
    digits = re.sub(r"[^0-9]", "", s)
    fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    if kind == 0:
        name, _, host = s.partition("@")
        return [f"{name} [at] {host}", f"{name}(at){host}", f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} @ {host}"]
    if kind == 1:
        return [s.replace(".", x) for x in ("[.]", "(.)", " dot ", "[dot]")]
    if kind == 2:
        return [x.join(fours) for x in (".", "/", " - ", "  ")]
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"00{digits[:-10]} {local[:3]} {local[3:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}"]


def spoilt(kind: int, s: str, forms: list[str]) -> list[str]:
    """What looks like a span s, or its disguises, and is none: another check digit, parts out of range, too few digits.

    Digits of the span also stand as a date and time, as a section number and in short groups.
    """
    digits = re.sub(r"[^0-9]", "", s)
    d = (digits * 12)[:12] if digits else ""
    out = [f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}", f"{d[:3]}.{d[3:6]}.{d[6:8]}", f"{d[:3]} {d[3:6]} {d[6:8]}", f"{d[:4]}/{d[4:6]}/{d[6:8]}", d[:9]] if d else []
    if kind == 1:
        out += [re.sub(r"^[0-9]+", lambda m: str(int(m.group()) % 600 + 300), x) for x in (s, *forms)]
    if kind == 2:
        for x in (s, *forms):
            at = max(i for i, c in enumerate(x) if c.isdigit())
            out.append(x[:at] + str((int(x[at]) + 3) % 10) + x[at + 1 :])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, fixed spans (flat), free candidates (flat, with features), and features of made cases, good and bad."""
    ints, reals = pa.list_(pa.int32()), pa.list_(pa.float32())
    for batch in batches:
        columns = [[] for _ in range(5)]
        for text in batch.column(1).to_pylist():
            b, f, x, good, bad = [], [], [], [], []
            if _SOME.search(text) or _AT_WORD.search(text):
                spans = base_spans(text)
                b = [v for s in spans for v in s]
                for k, s, e in spans:
                    before, after = text[max(0, s - 40) : s], text[e : e + 2]
                    forms = disguises(k, text[s:e])
                    for own in forms:
                        good += described(k, own, before, after)
                    for worse in spoilt(k, text[s:e], forms):
                        bad += described(1 if "[" in worse or " dot " in worse else kind_of(worse), worse, before, after)
                ordered = sorted((s, e) for _, s, e in spans)
                starts = [s for s, _ in ordered]
                reach = list(accumulate((e for _, e in ordered), max))
                for k, s, e in candidates(text):
                    i = bisect_left(starts, e)  # spans that start before e
                    if not i or reach[i - 1] <= s:
                        f += (k, s, e)
                        x += features(text, k, s, e)
            for column, value in zip(columns, (b, f, x, good, bad)):
                column.append(value)
        b, f, x, good, bad = columns
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(b, ints), pa.array(f, ints), pa.array(x, reals), pa.array(good, reals), pa.array(bad, reals)],
            names=["doc_id", "base", "free", "shape", "good", "bad"],
        )


def _sample(found: DataFrame, limit: int, column: str) -> np.ndarray:
    """At most ``limit`` cases of a column, those of smallest hash of their row's id and place in it."""
    starts = F.sequence(F.lit(1), F.size(column) - WIDTH + 1, F.lit(WIDTH))
    own = found.where(F.size(column) > 0).select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice(column, i, F.lit(WIDTH)))).alias("at", "x"))
    rows = own.orderBy(F.xxhash64("doc_id", "at"), "x").limit(limit).select("x").toArrow()["x"].to_pylist()
    return np.array(rows, np.float64).reshape(-1, WIDTH)


def fit(found: DataFrame, limit: int = MAX_CANDIDATES) -> tuple[BoostedTrees, np.ndarray, np.ndarray]:
    """Trees and calibration from at most ``limit`` cases of each label.

    Free candidates have no label: some may be personal data. Trees fitted on made cases alone look at them first; those
    on the negative side join the negative cases of the second fit.
    """
    good, bad, free = (_sample(found, limit, c) for c in ("good", "bad", "shape"))
    if not len(good):
        return BoostedTrees(), np.array([0.0]), np.array([0.0])
    first = BoostedTrees().fit(np.concatenate([good, bad]), np.r_[np.ones(len(good)), np.zeros(len(bad))])
    bad = np.concatenate([bad, free[first.raw(free) < 0]])
    x, y = np.concatenate([good, bad]), np.r_[np.ones(len(good)), np.zeros(len(bad))]
    learn = np.r_[np.arange(len(good)), np.arange(len(bad))] % 4 != 0
    trees = BoostedTrees().fit(x[learn], y[learn])
    return trees, *isotonic(trees.raw(x[~learn]), y[~learn], edges=True)


def _choose(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    trees, knots, values = model
    for batch in batches:
        doc, base, free, shape = (batch.column(i) for i in range(4))
        rows = [np.array(x, np.float64).reshape(-1, WIDTH) for x in shape.to_pylist()]
        p = np.interp(trees.raw(np.concatenate(rows)), knots, values) if rows else np.empty(0)  # one for each candidate
        at, counts, digests, all_spans, added = 0, [], [], [], []
        for b, f, x in zip(base.to_pylist(), free.to_pylist(), rows):
            fixed = [tuple(b[i : i + 3]) for i in range(0, len(b), 3)]
            more = {tuple(f[3 * i : 3 * i + 3]) for i in range(len(x)) if p[at + i] >= least}
            at += len(x)
            counts.append([sum(k == j for k, *_ in fixed) for j in range(4)])
            digests.append(hashlib.sha256(joined(fixed).encode()).hexdigest())
            all_spans.append(joined([*fixed, *more]))
            added.append(len(more))
        n = np.array(counts, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [doc, *(pa.array(n[:, j]) for j in range(4)), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(added, pa.int64())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
        )


def pii_report(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    rows = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cases = "shape array<float>, good array<float>, bad array<float>"
    found = rows.mapInArrow(_find, f"doc_id {kind}, base array<int>, free array<int>, {cases}")
    found = stored(found, "pii")
    model = fit(found)
    out = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return found.select("doc_id", "base", "free", "shape").mapInArrow(lambda it: _choose(it, model, least), out)


def redact(text: str, spans: str, mark: str = "[{}]") -> str:
    """text with the spans of a report replaced by their kinds; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])
