"""Long, deep and odd inputs within a time; disguised personal data; templates without structural rules."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kolumna.llm import decontaminate, exact_dedup, html_text, jaccard_join, pii, secrets, sentencepiece_scan
from kolumna.llm.common import shared_folder, stored
from kolumna.session import on_workers
from tests.llm.test_text_operators import brute_components

SECONDS = 30  # the machine may be shared


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("html", ["<div>" * 5000 + "x", "<b>" * 5000 + "x", '<a "' * 20000, "<" * 300_000, "<!" * 100_000, "</b>" * 100_000])
def test_deep_and_broken_pages(html):
    start = time.time()
    root = html_text.parse(html)
    html_text.hash_tree(root)
    html_text.candidates(root), html_text.text_of(root)
    assert time.time() - start < SECONDS


def test_pages_of_odd_kinds(spark):
    schema = "page_id long, url string, html string, host string, hashes string"
    rows = [(1, "http://h/a", "<p>one", "x", "y"), (1, "http://h/a", "<p>one", "x", "y"), (None, None, None, None, None), (3, "http://h/b", "<div>" * 3000 + "deep", "x", "y")]
    df = on_workers(spark).createDataFrame(rows, schema)
    got = html_text.main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, "one"), (1, "one"), (3, "deep")]
    assert html_text.main_text(df.limit(0)).isEmpty()


def test_templates_alone_remove_what_a_host_repeats(spark):
    """Without structural rules, recurrence decides; a brute-force count per host agrees."""
    rows = [(i, f"http://h{i % 2}/{i}", f"<body><nav><ul><li>Home {i % 2}</ul></nav><article><p>text {i}</article><div>Legal {i % 2}</div><footer>f{i}</footer>") for i in range(40)]
    df = on_workers(spark).createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df, structural=False).collect()}
    assert got == {i: f"text {i}\nf{i}" for i in range(40)}
    never = {r["page_id"]: r["text"] for r in html_text.main_text(df, min_pages=1000, structural=False).collect()}
    assert never[3] == "Home 1\ntext 3\nLegal 1\nf3"


def test_templates_matter_on_the_pages_table(spark):
    pages = on_workers(spark).read.parquet("/root/testdata/sf0.1/pages.parquet")
    on, off = (html_text.main_text(pages, min_pages=n, structural=False).select("page_id", F.col("text").alias(f"t{n}")) for n in (5, 10**6))
    changed = on.join(off, "page_id").where("t5 <> t1000000").count()
    assert changed > 0


def run_pii(text):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    return list(pii._find(iter([batch])))


@pytest.mark.parametrize("text", ["meet at the end of it dot and at " * 30_000, "a@b.co " * 30_000, "1 " * 200_000, "at" * 500_000])
def test_personal_data_in_long_texts(text):
    start = time.time()
    run_pii(text)
    assert time.time() - start < SECONDS


def test_disguised_personal_data_is_added_and_decoys_are_not(spark):
    rng = random.Random(4)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while True:
            d = num(16)
            if pii.luhn(d):
                return d

    around = lambda x: f"{prose(rng, 12)} {x} {prose(rng, 12)}"
    plain = [around(x) for _ in range(80) for x in (f"{prose(rng, 1)}{num(2)}@mail{num(1)}.example.com", f"+1 ({num(3)}) 555-0{num(3)}", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), card())]
    hidden, decoys = [], []
    for _ in range(25):
        d = card()
        hidden += [around(x) for x in (f"{prose(rng, 1)}{num(2)} [at] post.example.org", f"({num(3)}) {num(3)}-{num(4)}", "[.]".join(str(rng.randrange(1, 255)) for _ in range(4)), ".".join(d[i : i + 4] for i in range(0, 16, 4)))]
        wrong = card()
        decoys += [around(x) for x in (wrong[:-1] + str((int(wrong[-1]) + 1) % 10), f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 12:30", f"{num(3)}.{num(3)}.{num(2)}", f"{num(3)} {num(3)} {num(2)}")]
    texts = plain + hidden + decoys
    df = on_workers(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_added"] for r in pii.pii_report(df).collect()}
    found = sum(got[len(plain) + i] > 0 for i in range(len(hidden)))
    wrong = sum(got[len(plain) + len(hidden) + i] > 0 for i in range(len(decoys)))
    assert found >= 0.9 * len(hidden) and wrong <= 0.05 * len(decoys) and not any(got[i] for i in range(len(plain)))


def test_long_secrets_and_slugs(spark):
    rng = random.Random(1)
    run = "".join(rng.choice(secrets.ALPHABET) for _ in range(100_000))
    texts = [run, "ab-" * 20_000 + "1", "abc1" * 50_000, "token=abcdefghijkl " * 20_000]
    start = time.time()
    got = {r["doc_id"]: r for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert time.time() - start < 2 * SECONDS
    assert (got[0]["n_entropy"], got[1]["n_entropy"], got[3]["n_assign"]) == (1, 0, 20_000)


def test_allow_list_and_merge_of_spans(spark):
    """Suppressed candidates and candidates that touch a fixed span add nothing; the rest is a brute-force union."""
    key = "q9Zx7Kp2Lm4Nv8Rt3Wy6Bd1"
    texts = [f"token={key}", f"x {key} y", f"{key}example", "AKIA" + "Q7W8E9R1T2Y3U4I5", f"{key} {key}"]
    got = [r["spans"] for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    n = len(key)
    assert got == [f"assign:0:{6 + n}", f"entropy:2:{2 + n}", "", "access:0:20", f"entropy:0:{n},entropy:{n + 1}:{2 * n + 1}"]


def test_exact_copies_with_null_and_repeated_ids_and_odd_names(spark):
    rows = [(i, f"Text {i % 7}", 1, "a", "b") for i in range(70)] + [(None, "text 3", 1, "a", "b")] * 40 + [(69, "Text 6", 1, "a", "b")] * 5 + [(5, "other", 1, "a", "b")] + [(None, "lone", 2, "a", "b")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int, digest string, kept string").repartition(6)
    left = sorted((r["text"].lower(), r["doc_id"]) for r in exact_dedup.drop_exact(df, salts=4).collect())
    assert left == [("lone", None), ("other", 5), *((f"text {k}", 63 + k) for k in range(7))]


def test_near_copies_go_whatever_the_columns_are_called(spark):
    text = prose(random.Random(2), 60)
    rows = [(1, text, 7), (2, text + " more", 7), (3, "else", 7), (None, text, 7)]
    df = on_workers(spark).createDataFrame(rows, "doc_id long, text string, __dropped int")
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.drop_near_copies(df).collect()) == [0, 1, 3]


def whole_text_path(text, v):
    """A recurrence over the whole text, without chunks or words: the ids of the best path, the longest last piece first."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = [(best[end - k] + s, k) for k in range(min(end, v.longest), 0, -1) if (s := v.score.get(text[end - k : end], v.unknown if k == 1 else None)) is not None]
        top = max(s for s, _ in options)
        best.append(top), back.append(next(k for s, k in options if s == top))
    ids, end = [], len(text)
    while end:
        piece = text[end - back[end] : end]
        ids = ([v.id[piece]] if piece in v.id else [v.byte[b] for b in piece.encode()]) + ids
        end -= back[end]
    return ids


def test_chunks_words_and_whole_texts_give_one_path():
    v = sentencepiece_scan.vocabulary(sentencepiece_scan.default_model())
    rng = random.Random(5)
    texts = [prose(rng, n) + rng.choice(["", " 你好", "\n\n x", "  "]) + prose(rng, 9) for n in (1, 5, 60, 200)] + ["ab" * 300, "née 𝒳 " * 40]
    encode = sentencepiece_scan.Encoder(sentencepiece_scan.default_model())
    for text, ids in zip(texts, encode(texts)):
        marked = sentencepiece_scan.SPACE + text.replace(" ", sentencepiece_scan.SPACE)
        assert ids == whole_text_path(marked, v)
        for chunk, group in ((17, 3), (64, 1024), (256, 2)):
            assert list(sentencepiece_scan.best_chunked(marked, v, chunk, group)) == ids


def test_prefix_products_do_not_depend_on_the_order_of_combining():
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 0, (13, 5, 5)).astype(float)
    one_by_one = [m[0]]
    for x in m[1:]:
        one_by_one.append(sentencepiece_scan.combine(one_by_one[-1], x))
    assert np.array_equal(sentencepiece_scan.prefixes(m), np.stack(one_by_one))


def test_giant_documents_go_through_the_chunks(spark, monkeypatch):
    texts = [prose(random.Random(k), 8000) for k in range(2)] + ["x" * 40_000]
    assert all(len(t) > sentencepiece_scan.GIANT for t in texts)
    df = on_workers(spark).createDataFrame([*enumerate(texts), (0, None), (None, "a")], "doc_id long, text string")
    got = sentencepiece_scan.encode(df).collect()
    assert len(got) == 5 and all(r["round_trip"] for r in got)
    encode = sentencepiece_scan.Encoder(sentencepiece_scan.default_model())
    monkeypatch.setattr(sentencepiece_scan, "GIANT", 10**9)
    by_words = {i: encode([t])[0] for i, t in enumerate(texts[:2])}
    assert {r["doc_id"]: r["ids"] for r in got if r["n_tokens"] > 10_000 and r["doc_id"] in by_words} == by_words


def fits(pattern, text, budget):
    """Whether some stretch of text is within so many edits of pattern (the plain recurrence, free ends)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row) <= budget


def test_leaks_are_those_of_plain_alignment(spark):
    rng = random.Random(8)
    items = ["".join(rng.choices("abcdefghij ", k=n)).strip() for n in (10, 30, 64, 150)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    texts = [None, ""]
    for _ in range(60):
        item = rng.choice(items)
        cut = sorted(rng.sample(range(len(item)), 2)) if rng.random() < 0.5 else (0, len(item))
        part = list(item[cut[0] : cut[1]])
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            if part:
                k = rng.randrange(len(part))
                part[k : k + rng.randrange(2)] = rng.choice(["", "z", "yx"])
        texts.append("".join(rng.choices("klmnopqrst ", k=80)) + " " + "".join(part) + " " + "".join(rng.choices("klmnopqrst ", k=80)))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(on_workers(spark).createDataFrame([*enumerate(texts)], "doc_id long, text string"), bench).collect()}
    index = decontaminate.Index([*enumerate(items)])
    want = set()
    for i, text in enumerate(texts):
        c, _ = decontaminate.normalised(text or "")
        want |= {(i, index.item[w]) for w, p in enumerate(index.chars) if fits(p.tolist(), c.tolist(), int(index.budget[w]))}
    assert got == want


def test_leaks_over_several_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(3)
    items = [prose(rng, 20) for _ in range(6)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    df = on_workers(spark).createDataFrame([(i, t, "a", 1) for i, t in enumerate([*items, prose(rng, 30), None])], "doc_id long, text string, item_id string, row int")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (250,))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()} == {(i, i) for i in range(6)}
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [6, 7]
    assert decontaminate.leaks(df.limit(0), bench).isEmpty() and decontaminate.drop_contaminated(df.limit(0), bench).isEmpty()
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 8


@pytest.mark.parametrize("documents", [1000, 10**13])
def test_either_allocation_finds_the_same_components(spark, documents):
    """Sets filed whole, and by one-deletion neighbourhoods, as the cost model takes them for very large tables."""
    rng = random.Random(documents)
    texts = [None, "", "one"]
    for _ in range(10):
        base = prose(rng, rng.randrange(5, 120)).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    df = on_workers(spark).createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, 3, 4, 5, documents=documents).collect()}
    sizes, label = brute_components(texts, 3, 4, 5)
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, label))


def disk_files(spark, ending):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(ending)}


def test_tables_in_the_shared_folder_leave_no_shuffle_files(spark):
    before = disk_files(spark, ".data")
    df = spark.range(20_000).repartition(3).groupBy((F.col("id") % 1000).alias("k")).count()
    few = stored(df, "few")
    for _ in range(50):  # files go in the background
        if not (left := {f for f in disk_files(spark, ".data") - before if f.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    assert not left and len(few.collect()) == 1000


def test_keys_are_gone_once_near_copies_are_found(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(30)]
    df = on_workers(spark).createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])], "doc_id long, text string")
    old = set(Path(shared_folder(spark)).glob("kolumna/filed-*/what=*"))
    assert jaccard_join.drop_near_copies(df).count() == 30
    assert {p.name for p in set(Path(shared_folder(spark)).glob("kolumna/filed-*/what=*")) - old} == {"what=set"}


def test_texts_of_their_own_do_not_travel(spark):
    """Only rows whose digest's bit is set meet others; the result is that of whole contents, whatever the bitmap's size."""
    rows = [(i, f"Text {i if i >= 30 else i % 10}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    digests = exact_dedup._digests(df, "doc_id", "text")
    several, alone = exact_dedup._sorted_out(digests, exact_dedup._recurring(digests))
    met, apart = {r["doc_id"] for r in several.collect()}, {r["doc_id"] for r in alone.collect()}
    assert met | apart == set(range(400)) and not met & apart and set(range(30)) <= met and len(met) < 50
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df).collect()}
    assert groups == {i: (20 + i % 10, 3) if i < 30 else (i, 1) for i in range(400)}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(df).collect()) == list(range(20, 400))


def test_prefix_products_take_two_products_a_matrix(monkeypatch):
    m = np.random.default_rng(3).integers(-50, 0, (64, 4, 4)).astype(float)
    done, combine = [], sentencepiece_scan.combine
    monkeypatch.setattr(sentencepiece_scan, "combine", lambda a, b: done.append(len(a)) or combine(a, b))
    got = sentencepiece_scan.prefixes(m)
    want = [m[0]]
    for x in m[1:]:
        want.append(combine(want[-1], x))
    assert np.array_equal(got, np.stack(want)) and sum(done) < 2 * len(m)
