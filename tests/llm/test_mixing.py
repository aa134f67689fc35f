"""The mix of sources against plain Python: targets, schedule, pieces and words taken."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillcast.llm import mixing

SCHEMA = "doc_id BIGINT, text STRING, source STRING, size INT, rank STRING"


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        part = {s: weight[s] * left / sum(weight[x] for x in rest) for s in rest}
        over = {s: 2 * sizes[s] for s in rest if part[s] > 2 * sizes[s]}
        if not over:
            return capped | part
        capped |= over


def plain_taken(rows, goals) -> Counter:
    words = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    out = Counter()
    for source in goals:
        key = lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])
        stream = sorted((r for r in words if r[1] == source), key=key)
        goal, at = int(goals[source] + 0.5), 0
        taken = [0] * len(stream)
        for _ in range(2):
            for k, r in enumerate(stream):
                taken[k] += max(0, min(at + r[2], goal) - at)
                at += r[2]
        out.update((r[0], r[2], goals[source], n) for r, n in zip(stream, taken))
    return out


def odd_rows():
    rows = [(i, " ".join(["w"] * (i % 17)), f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "one two three", "hot") for i in range(900)] + [(7, "the same row", "hot")] * 300
    rows += [(2000, None, "s1"), (2001, "", "s1"), (None, "no id", "s2"), (None, None, None), (2002, "a b c\x0bd", None),
             (2003, "x " * 50_000, "long"), (2004, "中文 \U0001f600", "\U0001f600"), (2005, "z", "￮"), (2006, None, "empty")]
    return rows


def test_mix_equals_plain_python(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(6)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goals = plain_targets(sizes)
    for block in (7, 4096):
        got = mixing.taken(docs, block=block).collect()
        assert Counter((r.doc_id, r["size"], r.target, r.taken) for r in got) == plain_taken(rows, goals)
        assert all(r.taken <= 2 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken(docs.repartition(3)).collect()))


def test_schedule_ranks_and_discrepancy(spark):
    docs = spark.createDataFrame([(*r, 5, "x") for r in odd_rows()], SCHEMA)
    table = mixing.targets(mixing.sizes(docs))
    slots = mixing.schedule(spark, table, 100).collect()
    goals = {r.s: int(r.target + 0.5) for r in table.collect()}
    total = sum(goals.values())
    ranks = defaultdict(list)
    for r in sorted(slots, key=lambda r: r["at"]):
        ranks[r.s].append(r["rank"])
    for s, goal in goals.items():
        assert sorted(ranks[s]) == list(range(-(-goal // 100)))  # every block has its slot, once
    low, cumulative = {}, 0
    for s in sorted(goals):
        low[s] = (cumulative, cumulative + goals[s])
        cumulative += goals[s]
    seen = Counter()
    for r in sorted((r for r in slots if r.drawn), key=lambda r: r["at"]):
        point = int(f"{int(r['at']):040b}"[::-1], 2) / 2 ** 40
        assert low[r.s][0] / total - 1e-9 <= point < low[r.s][1] / total + 1e-9
        assert r["rank"] == seen[r.s]  # slots of the source before this one
        seen[r.s] += 1
        assert abs(seen[r.s] - (r["at"] + 1) * goals[r.s] / total) < 2 + 2 * max(1, len(slots)).bit_length() / 2


def test_pieces_are_disjoint_and_whole(spark):
    docs = spark.createDataFrame([(*r, 5, "x") for r in odd_rows()], SCHEMA)
    parts = mixing.mix(docs, block=50)
    assert parts.groupBy("source", "rank").agg(F.sum("length").alias("n")).filter("n > 50").count() == 0
    held = defaultdict(list)
    for r in parts.collect():
        held[r.doc_id, r["size"], r.source, r["copy"]].append((r["first"], r.length))
        assert 0 <= r["first"] and r["first"] + r.length <= r["size"] and r.length > 0
    for (_, size, *_), cuts in held.items():
        cover = Counter(w for first, n in cuts for w in (range(first, first + n) if size < 1000 else ()))
        assert not cover or max(cover.values()) <= 2


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(*r, 5, "x") for r in odd_rows()], SCHEMA)
    assert mixing.taken(docs.filter("false")).count() == 0
    bare = mixing.taken(docs.select("doc_id", F.lit(None).cast("string").alias("text"), "source"))
    assert bare.filter("size = 0 and taken = 0 and target = 0 and source_size = 0").count() == docs.count()
