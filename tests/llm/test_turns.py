"""The near-copy join in many turns and small tiles finds what brute force finds."""

import random

import pytest

from kolumna.llm import jaccard_join as J


@pytest.mark.parametrize("tile,wide", [(2, 4), (256, 1024)])
def test_turns_lose_and_add_no_links(spark, monkeypatch, tile, wide):
    rng = random.Random(8)
    family = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    common = [f"c{i}" for i in range(30)]  # a passage that many unrelated texts share fills keys
    texts = []
    for i in range(90):
        words = list(family[i % 6]) if i < 45 else [f"x{rng.randrange(10_000)}" for _ in range(rng.randrange(2, 40))]
        for _ in range(rng.randrange(3) if i < 45 else 0):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words + common))
    monkeypatch.setattr(J, "TURN", 1)
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "WIDE", wide)
    turns = []
    whole = J._turns
    monkeypatch.setattr(J, "_turns", lambda *a: turns.append(whole(*a)) or turns[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect()}
    assert max(turns) > 1
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert got == dict(enumerate(label))
