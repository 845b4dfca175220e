import hashlib
import random
import zlib

import pytest

from synthloom.llm import trie
from synthloom.llm.trie import Losers, op13_trie, prefix_trie, rebuilt, run_of, sequences


def brute(convs):
    """Nodes of {conv_id: list of (role, text)}."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        up = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), up, len(m), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, digest))
    return out


def nodes(df):
    rows = df.collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def rebuilt_by_hand(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


@pytest.mark.parametrize(("run", "span"), [(1 << 24, 1 << 25), (400, 1 << 25), (600, 900)])
def test_trie_equals_brute_force(spark, monkeypatch, run, span):
    monkeypatch.setattr(trie, "RUN_BYTES", run)
    monkeypatch.setattr(trie, "RANGE_BYTES", span)
    monkeypatch.setattr(trie, "IDS", 5)
    rng = random.Random(run)
    convs = {c: [(rng.choice("ua"), rng.choice(["", "é", "hm"])) for _ in range(rng.randint(0, 4))] for c in rng.sample(range(1000), 90)}
    convs |= {c: [("u", "same"), ("a", "again"), ("u", "é")] for c in range(1000, 1060)}  # copies, more than a range holds
    convs |= {c: [("u", "same")] for c in range(1060, 1090)}
    convs[2000] = [("u", str(k % 3)) for k in range(200)]
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    seqs = sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    turnless = spark.createDataFrame([(c, b"") for c, turns in convs.items() if not turns], "conv_id long, seq binary")
    assert nodes(prefix_trie(seqs.unionByName(turnless))) == brute(convs)


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    convs = {c: [("u", f"{c}-{k}") for k in range(rng.randint(1, 6))] for c in [*range(-3, 40), 57, 96, 999_998]}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    positive = {c: t for c, t in convs.items() if c >= 0}
    got = prefix_trie(rebuilt(sequences(df.filter("conv_id >= 0"))))
    assert nodes(got) == brute(rebuilt_by_hand(positive))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, 3, "u", "b"), (1, 3, "u", "b"), (None, 1, "u", "x"), (2, 0, "", ""), (3, 1, "", None), (4, 1, None, "long " * 400_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS depth")
    long = "long " * 400_000
    want = {1: [("", ""), ("u", "b"), ("u", "b")], 2: [("", "")], 3: [("", "")], 4: [("", long)]}
    assert nodes(prefix_trie(sequences(df))) == brute(want)
    df.limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13_trie(spark, str(tmp_path)).count() == 0


def test_merging_compares_no_shared_turn_again(monkeypatch):
    turn = lambda x: x.to_bytes(24, "big")
    rng = random.Random(2)
    stem = b"".join(map(turn, range(50)))
    rows = [(stem + b"".join(turn(rng.randint(0, 2)) for _ in range(rng.randint(0, 4))), k) for k in range(400)]
    runs = [run_of(rows[k::8]) for k in range(8)]
    compared = 0
    real = trie.shared

    def counted(a, b, start=0):
        nonlocal compared
        out = real(a, b, start)
        compared += out - start + 1
        return out

    monkeypatch.setattr(trie, "shared", counted)
    merged = list(Losers(runs))
    assert [(s, i) for s, i, _ in merged] == sorted(rows)
    assert [lcp for _, _, lcp in merged] == [0, *(real(a[0], b[0]) for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False))]
    assert compared < 400 * 9  # a merge that starts each comparison anew takes 400 x 3 x 50 and more
