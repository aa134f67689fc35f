"""Ranked search against a plain scorer, and the sharing graph against the items it stands for."""

import math
import random
import re
from collections import Counter

import pytest

from tillcast.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall((text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER))))


def plain(docs, items, k=lexical.K):
    held = [(i, c, c.total()) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, wanted in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 50 + 50 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        if scores:
            out[item] = [(i, -s) for s, _, _, i in sorted(scores, key=lambda x: x[:3])[:k]]
    return out


def found(df):
    got = {}
    for r in df.orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    return got


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["中文", "Été", "naïve", "\U0001f600", " "]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(700)] + [(5, "w1 w2 W1"), (5, "w1 w2 W1"), (None, "w1 w59 中文"),
            (None, "w1"), (9001, None), (9002, ""), (9003, "...!"), (9004, "w3 " * 700_000), (9005, "q" * 3_000_000)]
    docs += [(10_000 + i, "copied words w7 w8") for i in range(300)]
    items = [(i, text(rng.randint(1, 30))) for i in range(60)] + [(60, None), (61, "?!"), (62, "nowhere"), (63, "q" * 3_000_000),
             (64, "Copied"), (65, "w7"), (65, "w9 W9"), (None, "w2 w3")]
    return (docs, items, spark.createDataFrame([(*d, "x") for d in docs], "doc_id BIGINT, text STRING, score STRING").repartition(5),
            spark.createDataFrame([(*i, 1) for i in items], "item_id BIGINT, text STRING, rank INT"))


def test_search_equals_a_plain_scorer(tables, monkeypatch):
    docs, items, d, q = tables
    assert found(lexical.search(d, q)) == plain(docs, items)
    assert found(lexical.search(d, q, k=3, block_terms=100)) == plain(docs, items, 3)  # several blocks of items


def test_small_slices_give_the_same(tables, monkeypatch):
    docs, items, d, q = tables
    monkeypatch.setattr(lexical, "CELLS", 2000)
    want = plain(docs, items, 5)
    number = {t: i for i, t in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    wanted = {i: w for i, w in wanted.items() if w}
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in number]
    import numpy as np
    ev = lexical.Evaluator(lexical.sharing_dag([{number[t] for t in w} for w in wanted.values()]), weights, 5)
    step = ev.rows_at_once
    for at in range(0, len(held), step):
        part = held[at:at + step]
        post = [(number[t], n, r) for r, (_, c) in enumerate(part) for t, n in c.items() if t in number]
        a = np.array(post, np.int64).reshape(-1, 3)
        ev.add(np.array([i or 0 for i, _ in part]), np.array([int(i is None) for i, _ in part]),
               np.array([50 + 50 * c.total() * n_docs // length for _, c in part]), a[:, 0], a[:, 1], a[:, 2])
    got = {}
    for item, score, none, i in zip(*ev.best):
        got.setdefault(list(wanted)[item], []).append((None if none else int(i), int(score)))
    assert got == want


def test_graph_stands_for_the_items():
    rng = random.Random(1)
    for _ in range(50):
        common = rng.sample(range(40), 8)
        items = [set(rng.sample(range(40), rng.randint(1, 9))) | set(common[:rng.randint(0, 8)]) for _ in range(rng.randint(1, 25))]
        dag = lexical.sharing_dag(items)
        n = len(dag.classes)
        value = [list(c) for c in dag.classes]
        for parent, extra in dag.nodes:
            value.append(value[parent] + value[extra])
        for terms_, refs in zip(items, dag.items):
            assert sorted(t for v in refs for t in value[v]) == sorted(terms_)
        used = Counter(v for refs in dag.items for v in refs) + Counter(p for p, _ in dag.nodes)
        assert all(used[n + k] > 0 for k in range(len(dag.nodes)))
        plain_sums, shared = dag.additions()
        assert shared <= plain_sums + len(dag.nodes)
    twin = lexical.sharing_dag([{1, 2, 3, 4}, {1, 2, 3, 4, 5}, {1, 2, 3, 4, 6}, {9}])
    assert twin.additions()[1] < twin.additions()[0] and [1, 2, 3, 4] in twin.classes


def test_empty_tables(tables):
    _, _, d, q = tables
    for a, b in ((d.filter("false"), q), (d, q.filter("false")), (d, q.filter("item_id in (60, 61)"))):
        out = lexical.search(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_long_text_windows(monkeypatch):
    text = "ab cdé EF " * 500 + "tail" * 300
    whole = Counter(t.encode() for t in TERM.findall(text.translate(str.maketrans(lexical.UPPER, lexical.LOWER))))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "WINDOW", size)
        assert lexical.term_counts(text) == whole
