"""The text operators against brute force, on small frames with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kolumna.llm import decontaminate, exact_dedup, html_text, jaccard_join, language_model, pii, quality, secrets, toxicity
from kolumna.llm import sentencepiece_scan as sps
from kolumna.llm.components import components
from kolumna.llm.models import BoostedTrees, isotonic, linear_svm
from kolumna.session import on_workers

WORDS = "the of and reth inon erst thand oring lyea heti antion wh es ble".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs(spark, texts):
    """Clashing names on purpose: norm, digest, n, id and key are columns of the table."""
    rows = [(i, t, "x", i, "y", 1) for i, t in enumerate(texts)]
    return on_workers(spark).createDataFrame(rows, "doc_id long, text string, norm string, n int, key string, id int").repartition(3)


EDGE = [None, "", " ", "a", "A", "a", "\n\t", "word " * 3000, "é É", "é é"]


def test_secrets_match_brute_force(spark):
    rng = random.Random(5)
    parts = ['token="', "AKIA", "ABCDEFGHIJKLMNOP1", "0123456789abcdef0", "password: ", "é", " ", "q9Zx7Kp2Lm4Nv8Rt3Wy6", "api_key=", "deadbeef", '"', "hello"]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + ["x token=abcdefghijkl " * 700]
    got = {r["doc_id"]: r for r in secrets.secret_report(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assign = re.compile(secrets.ASSIGN)
    for i, t in enumerate(texts):
        t = t or ""
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 12]
        k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
        h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[q]}:{b}:{e}" for b, q, e in sorted(a + k + h))
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (len(a), len(k), len(h))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert {s for s in got[i]["spans"].split(",") if s and not s.startswith("entropy")} == {s for s in text.split(",") if s}


def test_window_entropy_is_exact(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcXYZ0189+/") for _ in range(rng.randrange(20, 60))) for _ in range(30)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.max_window_entropy(F.col("w")).alias("e"))

    def entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())

    for w, e in df.collect():
        assert e == pytest.approx(max(entropy(w[i : i + 20]) for i in range(len(w) - 19)))


def test_entropy_finds_keys_and_spares_prose_and_placeholders(spark):
    texts = ["key q9Zx7Kp2Lm4Nv8Rt3Wy6Bd1 end", "id 123e4567-e89b-12d3-a456-426614174000", "your_api_key_example_placeholder_1", "abcabcabcabcabcabcabcabcabc1 " * 2, prose(random.Random(1), 200)]
    got = [r["n_entropy"] for r in secrets.secret_report(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [1, 0, 0, 0, 0]


def test_exact_groups(spark):
    texts = EDGE + ["Same Text"] * 50 + ["same text"] * 3
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, texts), salts=4).collect()}
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_exact(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({max(j for j, u in enumerate(low) if u == t) for t in low})


def test_repeated_and_null_ids_leave_one_row(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, "b", 1), (None, "b", 2)], "doc_id long, text string, x int")
    assert sorted((r["doc_id"] or 0) for r in exact_dedup.drop_exact(df).collect()) == [0, 1]


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_components(spark, n, num, den):
    rng = random.Random(n)
    texts = list(EDGE)
    for _ in range(12):
        base = prose(rng, rng.randrange(4, 300)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs(spark, texts), n, num, den).collect()}
    sizes, label = brute_components(texts, n, num, den)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == list(zip(sizes, label))


def test_one_deletion_keys_meet_wherever_sets_are_linked():
    rng = np.random.default_rng(1)
    for size in (5, 20, 60):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.r_[a[: len(a) - size // 12], rng.integers(0, 2**63, size // 15, dtype=np.uint64)])
            both = jaccard_join.common(a, b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                for documents in (1000, 10**13):  # exact segments; one-deletion neighbourhoods
                    assert len(np.intersect1d(jaccard_join.keys_of(a, 4, 5, documents), jaccard_join.keys_of(b, 4, 5, documents)))
    assert jaccard_join.allocation(8, 4, 5, 10**13)[0] == "deletion" and jaccard_join.allocation(8, 9, 10, 1000)[0] == "exact"


def test_tiles_find_what_pairs_do():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[:74], rng.integers(0, 2**63, 4, dtype=np.uint64)]) for _ in range(30)]
    ids, roles = list(range(30)), [0] * 10 + [1] * 20
    pairs = {(i, j) for i in range(10) for j in range(10, 30) if 10 * jaccard_join.common(sets[i], sets[j]) >= 8 * (len(sets[i]) + len(sets[j]) - jaccard_join.common(sets[i], sets[j]))}
    assert set(jaccard_join.tile_links(ids, ids, roles, sets, 8, 10)) == pairs
    left, right, may = jaccard_join.tile_hopeful(ids, roles, [len(s) for s in sets], [jaccard_join.sketches_of(s, 8, 10) for s in sets], 8, 10)
    assert pairs <= {(left[i], right[j]) for i, j in np.argwhere(may)}


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_pii_base_matches_plain_patterns():
    def brute(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[ -]", "", m.group())
            if 16 <= len(d) <= 19 and pii.luhn(d):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(out)

    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a1@.. -+()9é%") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(t) == brute(t)


def test_pii_report_and_redaction(spark):
    texts = EDGE + ["mail me: a.b@c.example now", "call +1 (555) 123-4567 or 10.0.0.1", "card 4111 1111 1111 1111"]
    got = {r["doc_id"]: r for r in pii.pii_report(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    n = len(EDGE)
    assert (got[n]["n_email"], got[n + 1]["n_phone"], got[n + 1]["n_ip"], got[n + 2]["n_card"]) == (1, 1, 1, 1)
    assert pii.redact(texts[n], got[n]["spans"]) == "mail me: [email] now"


def test_quality_tells_good_from_bad(spark):
    rng = random.Random(9)
    good = [prose(rng, rng.randrange(30, 200)) for _ in range(250)]
    bad = [(prose(rng, 1) + " ") * rng.randrange(40, 200) for _ in range(250)]
    df = docs(spark, EDGE + good + bad)
    labels = spark.createDataFrame([(len(EDGE) + i, int(i < 250), 0) for i in range(500)] + [(None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(df, labels).collect()}
    assert len(got) == len(EDGE) + 500 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(len(EDGE), len(EDGE) + 500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["predicted"] == int(i < len(EDGE) + 250) for i in held) > 0.97 * len(held)
    assert quality.keep_good(df, labels).columns == df.columns
    assert len({r["score"] for r in quality.quality_scores(df, labels.limit(0)).collect()}) == 1


def test_toxicity_finds_gapped_insults(spark):
    rng = random.Random(11)
    insults = "grumblat vorpiksen zanfordel".split()
    texts, toxic = [], []
    for i in range(400):
        words = prose(rng, rng.randrange(20, 80)).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words) + ".")
        toxic.append(int(i % 4 == 0))
    gapped = ["grum.blat vorpik-sen zanfor*del grumb.lat vor.piksen zan-fordel " + prose(rng, 20)]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs(spark, texts + gapped + EDGE), labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == toxic[i] for i in held) > 0.95 * len(held)
    assert got[400]["predicted"] == 1 and got[401]["predicted"] == 0


def test_toxicity_sees_weakly_near_and_long_tokens():
    m = toxicity.Matcher([b"grumblat", b"stone"], 1)
    weak = b"grumxblaytzz"
    value = toxicity.kernel([weak], m.table)[0, 0] ** (1 / toxicity.POWER)
    assert 0.45 <= value < 0.5 and len(m.sentences(b"the " + weak + b" fell")) == 1
    spaced = b" ".join(bytes([c]) for c in b"wereallythinkthatthismanisagrumblatindeed")
    for text in (spaced, b"a" + b"bcdfe" * 9 + b"grumblat", b"grumblat" + b"bcdfe" * 9):
        assert len(m.sentences(text)) == 1, text
    assert not len(m.sentences(b"bcdfe" * 20))
    for n in range(25, 80):
        token = bytes(i % 250 for i in range(n))
        assert all(any(token[i : i + 9] in w for w in toxicity.windows(token) if len(w) <= 12) for i in range(n - 8))


def test_language_model_base_and_gain(spark):
    rng = random.Random(8)
    texts = EDGE + [prose(rng, rng.randrange(5, 60)) for _ in range(200)]
    got = {r["doc_id"]: r for r in language_model.lm_scores(docs(spark, texts), clustered=20, classes=4, remembered=30).collect()}
    split = [(t or "").encode().lower().split() + [b""] for t in texts]
    c = Counter(w for i, s in enumerate(split) if zlib.crc32(str(i).encode()) % 10 for w in s)
    total, distinct = sum(c.values()), len(c)
    for i, s in enumerate(split):
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in s)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(s), sum(c[w] > 0 for w in s), total)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] < 0


def test_language_model_clusters_1500_words(spark):
    words = [f"w{i:04d}" for i in range(1500)]
    rows = [(" ".join(words[i:] + words[:i]).encode(),) for i in range(0, 1500, 250)]
    model, _ = language_model.fit(spark.createDataFrame(rows, "text binary"))
    assert len(model.unit_class) == 1500 + language_model.RARE + 1
    assert set(model.word_class[[model.remembered.index(w.encode()) for w in words]]) <= set(range(language_model.CLASSES))


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = Counter((int(rng.integers(0, 5)) + 5 * (k % 2), int(rng.integers(0, 5)) + 5 * ((k + 1) % 2)) for k in range(5000))
    left, right = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    n = np.array(list(pairs.values()), float)
    own = language_model.exchange(np.r_[left, 10], np.r_[right, 10], np.r_[n, 0.0], 10, 2)
    assert len(set(own[:5])) == 1 and len(set(own[5:10])) == 1 and own[0] != own[5]


def test_main_text_of_pages(spark):
    page = "<html><head><title>t</title><script>if(a<b){'</p>'}</script></head><body><nav><a>Menu</a></nav><div class='box'>Site {k} box</div><div class=promo>Buy</div>{a}<footer>f</footer></body>"
    article = "<article><h1>Head &amp; {k}</h1><p><b>One\n two<br><p>Three &lt;x&gt;</p><div class='comments'><p>me</p></div><ul><li>a<li>b</ul></article>"
    rows = [(i, f"http://h/{i}", page.replace("{a}", article).replace("{k}", str(i)).replace(f"Site {i}", "Site")) for i in range(30)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://h2/", "<p>plain &copy; text<p>next")]
    got = {r["page_id"]: r for r in html_text.main_text(on_workers(spark).createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head & 3\nOne two\nThree <x>\na\nb" and got[3]["n_chars"] == len(got[3]["text"])
    assert (got[90]["text"], got[91]["text"], got[92]["text"]) == ("", "", "plain © text\nnext")


def test_templates_go_where_there_is_no_article(spark):
    rows = [(i, f"http://h/{i}", f"<body><div><a>x</a> same on all</div><p>own text {i}</p></body>") for i in range(40)]
    got = html_text.main_text(on_workers(spark).createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [f"own text {i}" for i in range(40)]


def brute_path(word, v):
    best = [(0.0, ())]
    for end in range(1, len(word) + 1):
        options = []
        for size in range(min(end, v.longest), 0, -1):
            piece = word[end - size : end]
            s = v.score.get(piece, v.unknown if size == 1 else None)
            if s is not None:
                options.append((best[end - size][0] + s, best[end - size][1] + (piece,)))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][0]


def value(ids, v):
    return sum(v.score[v.pieces[i]] for i in ids)


def test_best_paths_and_chunks():
    v = sps.vocabulary(sps.default_model())
    rng = random.Random(6)
    words = ["▁" + "".join(rng.choice("theandlyinorst") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for w, ids in zip(words, sps.best_words(words, v)):
        assert value(ids, v) == brute_path(w, v)
        for chunk in (16, 23):
            assert value(sps.best_chunked(w, v, chunk), v) == value(ids, v)
    a, b, c = (rng_matrix(v.longest, s) for s in (1, 2, 3))
    assert np.allclose(sps.combine(sps.combine(a, b), c), sps.combine(a, sps.combine(b, c)))


def rng_matrix(n, seed):
    return np.random.default_rng(seed).integers(-50, 0, (n, n)).astype(float)


def test_encoding_round_trip(spark):
    v = sps.vocabulary(sps.default_model())
    texts = EDGE + ["naïve 你好 \n\n\t𝒳 done", " lead", "trail ", "a" * 5000, "two  blanks", prose(random.Random(1), 50)]
    got = {r["doc_id"]: r for r in sps.encode(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["round_trip"] and sps.decode(got[i]["ids"], v) == (t or "") and got[i]["n_tokens"] == len(got[i]["ids"])
    assert sps.with_tokens(docs(spark, texts).withColumn("n_tokens", F.lit(0))).columns[-2:] == ["token_ids", "n_tokens_2"]


def test_decontamination(spark):
    rng = random.Random(21)
    items = [prose(rng, n) for n in (12, 20, 40)] + ["short"]
    bench = spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string")

    def edited(t, k):
        s = list(t)
        for _ in range(k):
            s[rng.randrange(len(s))] = rng.choice("xyz")
        return "".join(s)

    clean = [prose(random.Random(900 + k), 300) for k in range(10)]
    dirty = [clean[k][:400] + " " + edited(items[k % 3], k).upper() + "!\n" + clean[k][400:] for k in range(3)]
    long = [("pad " * 200_000) + items[1] + (" pad" * 1000)]
    texts = EDGE + clean + dirty + long
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    at = len(EDGE) + len(clean)
    assert got == {(at, 0), (at + 1, 1), (at + 2, 2), (at + 3, 1)}
    left = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == list(range(at)) and left.columns == docs(spark, texts).columns
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).isEmpty()


def test_decontamination_finds_passages_and_short_items(spark):
    rng = random.Random(22)
    items = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (400, 120, 20, 9, 5)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    pad = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    parts = [(0, items[0][a : a + 79]) for a in range(0, 322, 7)] + [(0, items[0][33:163]), (1, items[1][10:110])]
    parts += [(2, items[2]), (2, items[2][:7] + "0" + items[2][8:]), (3, items[3])]
    texts = [f"{pad} {part} {pad}" for _, part in parts] + [pad, f"{pad} {items[4]}", f"{pad} {items[3][:5]}0{items[3][6:]}"]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == {(i, item) for i, (item, _) in enumerate(parts)}
    left = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [len(parts), len(parts) + 1, len(parts) + 2]


def test_small_models():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((BoostedTrees(rounds=60).fit(x, y).raw(x) > 0) == (y > 0)).mean() > 0.95
    knots, values = isotonic(x[:, 0], (x[:, 0] > 0).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    w, b = linear_svm(x, np.where(x @ [1, 2, 0] > 0.1, 1.0, -1.0))
    assert (np.sign(x @ w + b) == np.where(x @ [1, 2, 0] > 0.1, 1, -1)).mean() > 0.97


def test_empty_tables(spark):
    none, labels = docs(spark, ["x"]).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        secrets.secret_report(none), exact_dedup.exact_groups(none), exact_dedup.drop_exact(none), jaccard_join.jaccard_components(none), jaccard_join.drop_near_copies(none),
        pii.pii_report(none), quality.quality_scores(none, labels), toxicity.toxicity_scores(none, labels), language_model.lm_scores(none), sps.encode(none),
    ):
        assert out.count() == 0


def test_every_training_word_has_a_class_by_its_neighbours(spark):
    """No word is left to its length for being beyond the remembered ones: classes follow contexts, scores a recount."""
    rng = random.Random(6)
    left, right = [f"l{i:02}" for i in range(20)], [f"r{i:02}" for i in range(20)]
    rows = [(" ".join(x for _ in range(8) for x in (rng.choice(left), rng.choice(right))).encode(),) for _ in range(80)]
    model, counts = language_model.fit(on_workers(spark).createDataFrame(rows, "text binary"), clustered=16, classes=2, remembered=20)
    table = {r["word"]: r["class"] for r in counts.collect()}
    assert {w for w, c in table.items() if c is None} == set(model.remembered)
    known = dict(zip(model.remembered, model.word_class.tolist())) | {w: c for w, c in table.items() if c is not None}
    assert len({known[w.encode()] for w in left}) == len({known[w.encode()] for w in right}) == 1
    assert known[b"l00"] != known[b"r00"]
    df = spark.createDataFrame([(i, t.decode()) for i, (t,) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.lm_scores(df, folds=10**6, clustered=16, classes=2, remembered=20).collect()}
    c = Counter(w for (t,) in rows for w in t.split())
    g = np.zeros((19, 19))
    paths = [[18, *(known[w] for w in t.split()), 18] for (t,) in rows]
    for p in paths:
        np.add.at(g, (p[:-1], p[1:]), 1)
    n, v = np.zeros(19), np.zeros(19)
    for w, x in [*c.items(), (b"", len(rows))]:
        k = known[w] if w else 18
        n[k] += x
        v[k] += 1
    move = np.log10((g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * 19))
    for i, ((t,), p) in enumerate(zip(rows, paths)):
        emit = sum(math.log10((x + 0.1) / (n[k] + 0.1 * (v[k] + 1))) for x, k in zip([*(c[w] for w in t.split()), len(rows)], p[1:]))
        assert math.isclose(got[i]["score"], emit + move[p[:-1], p[1:]].sum(), rel_tol=1e-9)


def test_holes_are_filled_beside_large_classes():
    codes = np.array([63, -1, 40, -2, -1], np.int32).tobytes()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "codes": [codes, b""], "holes": [[1, 0], None], "values": [[7, 5], None]})
    (out,) = language_model._fill(iter([batch]))
    assert [np.frombuffer(x, np.int32).tolist() for x in out["codes"].to_pylist()] == [[63, 5, 40, 7, 5], []]


def test_language_model_reads_texts_twice(spark):
    """Once for the counts of words (training texts), once for the codes that all other steps work on."""
    rng = random.Random(12)
    texts, read = [prose(rng, 40) for _ in range(60)], spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = docs(spark, texts).select("doc_id", "text").mapInArrow(seen, "doc_id long, text string")
    assert len(language_model.lm_scores(df, folds=10**6, clustered=8, classes=3, remembered=20).collect()) == 60
    assert read.value == 120


def test_language_model_scores_rare_and_unseen_words(spark):
    """Words seen once, several times and never, beside a model that remembers few: scores by a recount."""
    rng = random.Random(13)
    texts = [" ".join([*prose(rng, rng.randrange(0, 30)).split(), *(f"{'x' * rng.randrange(1, 20)}{rng.randrange(60)}" for _ in range(rng.randrange(6)))]) for _ in range(90)] + EDGE
    split = [(t or "").encode().lower().split() for t in texts]
    learn = [zlib.crc32(str(i).encode()) % 3 != 0 for i in range(len(texts))]
    kinds = {"clustered": 10, "classes": 3, "remembered": 40}
    rows = [((t or "").encode(),) for t, x in zip(texts, learn) if x]
    model, counts = language_model.fit(on_workers(spark).createDataFrame(rows, "text binary").repartition(3), **kinds)
    table = {r["word"]: r["class"] for r in counts.collect()}
    t, c = 3 + 16 + 1, Counter(w for s, x in zip(split, learn) if x for w in [*s, b""])
    known = dict(zip(model.remembered, model.word_class.tolist())) | {w: k for w, k in table.items() if k is not None}
    assert set(known) == set(c) and known[b""] == t - 1
    length = lambda w: 3 + min(len(w), 16) - 1
    once = {w for w, k in table.items() if k is not None and c[w] == 1}
    assert once and any(w not in c for s in split for w in s)
    g, n, v = np.zeros((t, t)), np.zeros(t), np.zeros(t)
    for s, x in zip(split, learn):
        p = [t - 1, *(known.get(w, -1) for w in s), t - 1]
        if x:
            np.add.at(g, (p[:-1], p[1:]), 1)
            for i, w in enumerate(s):
                if w in once:
                    g[p[i], length(w)] += 1
                    g[length(w), p[i + 2]] += 1
    for w, x in c.items():
        for k in [known[w], *([length(w)] if w in once else [])]:
            n[k] += x
            v[k] += 1
    move = np.log10((g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * t))
    got = {r["doc_id"]: r for r in language_model.lm_scores(docs(spark, texts), folds=3, **kinds).collect()}
    for i, s in enumerate(split):
        p = [t - 1, *(known.get(w, length(w)) for w in s), t - 1]
        emit = sum(math.log10((c[w] + 0.1) / (n[k] + 0.1 * (v[k] + 1))) for w, k in zip([*s, b""], p[1:]))
        assert math.isclose(got[i]["score"], emit + move[p[:-1], p[1:]].sum(), rel_tol=1e-9), texts[i]
        assert got[i]["n_known"] == sum(w in c for w in [*s, b""])


def test_end_counts_when_other_words_are_more_frequent(spark):
    texts = [" ".join(f"w{i}" for i in range(20)) + " " + " ".join(f"w{i}" for i in range(20))] * 3
    got = language_model.lm_scores(docs(spark, texts), folds=10**6, clustered=4, classes=2, remembered=8).collect()
    base = 40 * math.log10(6.1 / (123 + 2.2)) + math.log10(3.1 / (123 + 2.2))
    assert all(r["n_known"] == 41 and math.isclose(r["base_score"], base, rel_tol=1e-9) for r in got)


def test_words_that_span_batches_meet_all_their_rows(monkeypatch):
    rng = np.random.default_rng(3)
    words = sorted(b"w%03d" % x for x in rng.integers(0, 12, 60))
    near = [rng.integers(0, 20, 2 * x).astype(np.uint8).tobytes() for x in rng.integers(0, 3, 60)]
    whole = pa.RecordBatch.from_pydict({"word": words, "row": list(range(60)), "hole": [0] * 60, "near": near})
    log_share = np.log(rng.random((19, 19)))
    args = rng.permutation(np.arange(20) % 19), log_share, np.log([5.0, 7.0]), np.uint8
    table = lambda batches: [r for b in language_model._placed(iter(batches), *args) for r in b.to_pylist()]
    want = table([whole])
    assert [r["word"] for r in want if r["word"]] == sorted(set(words))
    assert {r["row"]: r["c"] for r in want} == {i: sum(len(x) // 2 for x, w in zip(near, words) if w == words[i]) for i in range(60)}
    for rows, step in ((1, 1), (1, 7), (5, 3), (100, 2)):
        monkeypatch.setattr(language_model, "ROWS", rows)
        assert table([whole.slice(i, step) for i in range(0, 60, step)]) == want
