"""Secret scan in DataFrame functions: three fixed formats, and sliding-window entropy over candidate strings.

Positions come from splitting: the pieces between matches and the matches alternate, so running sums of their lengths
are the offsets (code points). Running sums go block by block, so that a text of very many matches stays near linear.

Entropy: every candidate (a long unbroken string of key characters) is classed by its alphabet (hex, or base64 with
letters and digits). A window of ``width`` characters slides over it; counts per character change by one entering and
one leaving character, and the sum of n*log2(n) changes by four table look-ups. The counts are the
characters of a short string, so a step costs the same for any width and rebuilds no array.
A candidate whose highest window entropy reaches its class's bound is a secret, unless the allow-list suppresses it.

Nulls count as the empty text, which has no spans. Other columns, whatever their names, are not looked at. Rows are
independent of each other, so ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text

# The three formats, their least lengths, and the order of kinds at equal starts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: Candidates for the entropy rule: whole runs of key characters with a digit (either class asks for one).
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Suppressed candidates: UUIDs, alphabets and digit rows written out, placeholders, one repeated unit, dated slugs.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]?(?:key|token|secret)|x{6,}",
    r"^(.{1,8})\1++$",
    r"^[0-9/_-]++$",
    r"^(?:[A-Za-z]{2,}+[_/-])++[A-Za-z]{2,}+$",
)
WIDTH, HEX_BITS, BASE64_BITS = 20, 3.0, 3.6
BLOCK = 256


def _with(value: Column, use) -> Column:
    """use(value), where value is computed once however often (or in whatever lambda) it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start,kind,end>> of the pattern's leftmost non-overlapping matches for which keep(match) holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _with(
        matches,
        lambda found: F.zip_with(
            F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
            found,
            lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), keep(m).alias("ok")),
        ),
    )
    in_blocks = lambda pairs: F.transform(
        F.sequence(F.lit(0), (F.size(pairs) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))
    )
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"])
    starts = lambda blocks: F.aggregate(
        F.transform(blocks, total),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    span = "array<struct<start:int,kind:int,end:int>>"

    def run(block: Column, first: Column) -> Column:
        empty = F.struct(first.alias("at"), F.array().cast(span).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end")))
            return F.struct((start + x["len"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, empty, step, lambda acc: acc["out"])

    whole = lambda blocks: F.flatten(F.zip_with(blocks, F.slice(starts(blocks), F.lit(1), F.size(blocks)), run))
    return _with(pairs, lambda pairs: _with(in_blocks(pairs), whole))


def _found(text: Column, pattern: str, kind: int, keep) -> Column:
    """_spans, computed only where the text has a match at all."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), _spans(text, pattern, kind, keep)).otherwise(none)


def max_window_entropy(word: Column, width: int = WIDTH, alphabet: str = ALPHABET) -> Column:
    """The highest Shannon entropy (bits) of the characters of any ``width`` consecutive characters of word.

    Counts start from the first window; each step lets one character in and one out and changes the sum of n*log2(n)
    by the two counts concerned. Characters outside the alphabet count as one. Words shorter than the width count as
    one window.
    """
    size, zero = len(alphabet) + 1, 65  # a count n is kept as the character zero + n
    place = lambda c: _with(F.position(c, F.lit(alphabet)), lambda i: F.when(i > 0, i).otherwise(F.lit(size)))
    nlogn = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])
    f = lambda n: F.element_at(nlogn, n + 1)
    count = lambda acc, at: F.ascii(acc["counts"].substr(at, F.lit(1))) - zero

    def changed(acc: Column, x: Column, n_in: Column, n_out: Column) -> Column:
        moved = acc["sum"] + f(n_in + 1) - f(n_in) + f(n_out - 1) - f(n_out)
        now = F.overlay(F.overlay(acc["counts"], F.char(n_in + zero + 1), x["come"], F.lit(1)), F.char(n_out + zero - 1), x["go"], F.lit(1))
        return _with(moved, lambda m: F.struct(now.alias("counts"), m.alias("sum"), F.least(acc["least"], m).alias("least")))

    step = lambda acc, x: _with(count(acc, x["come"]), lambda i: _with(count(acc, x["go"]), lambda o: changed(acc, x, i, o)))

    def highest(index: Column) -> Column:
        width_here = F.least(F.size(index), F.lit(width))
        rest = F.size(index) - width_here
        first = _with(
            F.slice(index, F.lit(1), width_here),
            lambda window: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda s: F.size(F.filter(window, lambda i: i == s))),
        )
        steps = F.zip_with(
            F.slice(index, width_here + 1, rest), F.slice(index, F.lit(1), rest), lambda come, go: F.struct(come.alias("come"), go.alias("go"))
        )
        steps = F.filter(steps, lambda x: x["come"] != x["go"])  # the others change nothing

        def all_steps(first: Column) -> Column:
            counts = F.array_join(F.transform(first, lambda n: F.char(n + zero)), "")
            total = F.aggregate(F.transform(first, f), F.lit(0.0), lambda a, x: a + x)
            start = F.struct(counts.alias("counts"), total.alias("sum"), total.alias("least"))
            return F.aggregate(steps, start, step, lambda acc: acc["least"])

        n = width_here.cast("double")
        return F.log2(n) - _with(first, all_steps) / n

    return F.when(F.length(word) == 0, F.lit(0.0)).otherwise(_with(F.transform(F.split(word, ""), place), highest))


def is_secret(word: Column, width: int = WIDTH, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS) -> Column:
    """Whether a candidate's class (hex, or letters of both cases or one case with digits) has a window over its bound."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    is_hex = word.rlike("^[0-9a-fA-F]+$") & word.rlike("[0-9]") & word.rlike("[a-fA-F]")
    mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    bound = F.when(is_hex, F.lit(hex_bits)).when(mixed, F.lit(base64_bits))
    return F.when(allowed | bound.isNull(), F.lit(False)).otherwise(max_window_entropy(word, width) >= bound)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text and spans: array<struct<start,kind,end>> sorted by start, kind (indices into KINDS)."""
    text = clean_text(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    body = F.col("text")
    rows = rows.select(
        "doc_id",
        "text",
        _found(body, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        _found(body, ACCESS, 1, lambda m: F.length(m) >= ACCESS_LEAST).alias("access"),
        _found(body, HEX, 2, lambda m: F.lit(True)).alias("hex"),
        _found(body, CANDIDATE, 3, lambda m: is_secret(m, width)).alias("entropy"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.withColumn("base", base)
    more = F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base", more)))


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    rows = scan(docs, id_col, text_col)
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return rows.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"),
        F.sha2(digest_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest_text(F.col("spans")).alias("spans"),
    )
