"""The conversation trie against plain Python, with containers of all sizes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tillcast.llm import turns

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, depth STRING"


def plain_sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + seq[h:])
    return out


def plain_nodes(sequences):
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = sum(len(x) == len(node) + 1 for x in below)
        inner = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if sequences[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children,
                    sum(x not in inner for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    said = ["hi", "yes", "no", "", None, "中\U0001f600"]
    out = []
    for c in range(0, 260):
        for t in range(rng.randint(1, 8)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(said)))
    for c in range(400, 480):  # copies, but for what they take over
        out += [(c, t, "user", f"the same {t}") for t in range(9)]
    out += [(1000, t, "user", f"long {t}") for t in range(300)] + [(1001, t, "user", f"long {t}") for t in range(250)]
    out += [(1002, t, "user", f"long {t}") for t in range(300)] + [(2003, 0, None, None), (2004, None, "user", "null turn"),
            (2004, 1, None, "x"), (2004, None, "user", "null turn"), (None, 1, "user", "nobody"), (-105, 1, "user", "hi"), (-100, 0, "user", "hi")]
    return out


@pytest.mark.parametrize("container,step", [(4096, 16), (50, 2), (3, 1)])
def test_nodes_equal_plain_python(spark, rows, container, step):
    # ties in turn follow the hashes of the turns: two equal rows only, so any order is the same
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    got = turns.trie(turns.rebuilt(turns.turn_rows(table)), container, step).collect()
    assert Counter(map(tuple, got)) == plain_nodes(plain_sequences(rows))


def test_lists_of_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(turns, "ENDS", 7)
    rows = [(c, 0, "user", "same") for c in range(5, 900, 3)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    built = turns.rebuilt(turns.turn_rows(table))
    ids = turns.cut_lineage(turns.prefixes(built))
    heads = turns.cut_lineage(turns.burst(ids, 1, 1))
    got = {r.ends_sha256 for r in turns.ended(ids, heads, 7).collect()}
    want = {n[-1] for n in plain_nodes(plain_sequences(rows))} - {turns.NONE_ENDED}
    assert got == want


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert turns.trie(turns.rebuilt(turns.turn_rows(table))).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "x", "y")], SCHEMA)
    assert turns.trie(turns.rebuilt(turns.turn_rows(only))).count() == 0
