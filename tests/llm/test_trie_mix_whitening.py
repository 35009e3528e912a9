"""Prefix trie, curriculum and whitening on small and awkward tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from commentlake.llm import bidiagonal, curriculum, prefix_trie, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string, position string, path long"


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(70), 95, 100, 101, 140, 141, -1, -7, -20]:
        if c in (40, 60):  # absent bases
            continue
        for turn in range(rng.randrange(1, 7)):
            text = rng.choice([None, "", "hello there", "hello there", "a b c", "é 東京 x", " \t"])
            rows.append((c, rng.choice([turn, turn, turn, 0]), rng.choice(["user", "assistant", None]), text, "clash", c))
    rows += [(3, None, "user", "null turn", "x", 0), (3, None, None, None, "x", 0), (None, 0, "user", "no id", "x", 0)]
    rows += [(c, t, "system", "one prompt", "x", 0) for c in range(300, 340) for t in range(3)]  # copies
    rows += rows[5:8]
    return rows


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = {}
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in m if len(full[c]) == len(path))
        inner = {p[:-1] for p in members if p}
        out[min(m), len(path)] = (
            min(members[path[:-1]]) if path else None, len(m), sum(len(p) == len(path) + 1 for p in below),
            sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize(("convs", "turns", "parts"), [(4096, 1 << 17, 2), (7, 1 << 17, 3), (1, 20, 1), (5, 2, 3)])
def test_prefix_trie_matches_plain_sets(spark, convs, turns, parts):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(parts)
    at = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df)), convs, turns)
    got = {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
           for r in at.collect()}
    assert got == plain_trie(rows)
    assert max(v[1] for k, v in got.items() if k[1] == 2) >= 20


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "x", "", 0)], CONV)
    for df in (none, none.limit(0)):
        assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))).count() == 0


def test_conversation_longer_than_a_shard_is_not_held():
    def batches():  # a generator of turns: holding them would need all of it at once
        for at in range(0, 60_000, 1000):
            yield pa.RecordBatch.from_arrays(
                [pa.array([5] * 1000), pa.array([str(at + k).zfill(16).encode() for k in range(1000)], pa.binary()), pa.array([1] * 1000)],
                ["conv_id", "turn_id", "words"])

    seen = 0
    for out in prefix_trie._sharder(10, 100)(batches()):
        assert out.num_rows <= prefix_trie.OUT_ROWS
        seen += out.num_rows
    assert seen == 60_001 and out.column("ends")[-1].as_py() == b"5" and not out.column("inner")[-1].as_py()


# ---- curriculum ------------------------------------------------------------
DOCS = "doc_id long, text string, source string, size long, target string, place long"


def plain_targets(sizes):
    """Round by round, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, cut = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in cut]
        rest = total - sum(2 * sizes[s] for s in cut)
        target = {s: Fraction(2 * sizes[s]) if s in cut else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        cut |= over


def mix_rows():
    rng = random.Random(2)
    rows = [(None, "no id", "a", 1, "", 2), (7, None, None, 1, "", 2), (8, "", "b", 1, "", 2), (9, "x y z", None, 0, "", 0)]
    rows += [(k, "w " * rng.randrange(60), rng.choice(["a", "a", "a", "b", "ä", "c", "d"]), 0, "", 0) for k in range(300)]
    rows += [(4, "one row many times", "hot", 0, "", 0)] * 200 + [(5, "w " * 900, "hot", 0, "", 0), (6, "q " * 5000, "tiny", 0, "", 0)]
    return rows


def test_mix_meets_its_targets(spark, monkeypatch):
    rows = mix_rows()
    df = spark.createDataFrame(rows, DOCS)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = plain_targets(sizes)
    got = curriculum.mixed(df).select("doc_id", "source", "size", "source_size", "target", "taken", "times").collect()
    assert sorted((repr(r["doc_id"]), repr(r["source"]), r["size"]) for r in got) == sorted(
        (repr(d), repr(s), len(WORDS.findall(t or ""))) for d, t, s, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(t["words"] for t in r["times"])
        assert all(0 <= t["time"] <= 1 for t in r["times"])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s]) for s in want) and any(want[s] == 2 * sizes[s] > 0 for s in want)
    monkeypatch.setattr(curriculum, "RUN", 7)
    again = curriculum.mixed(df.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken", "times").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_curriculum_follows_the_schedules(spark):
    rows = [(k, "w " * 10 + str(k), s, 0, "", 0) for k, s in enumerate(["a", "b", "c"] * 400)]
    read = curriculum.curriculum(spark.createDataFrame(rows, DOCS)).collect()
    times = [r["time"] for r in read]
    assert times == sorted(times) and all(r["text"].split()[-1] == str(r["doc_id"]) for r in read)
    for k, source in enumerate("abc"):
        mine = [r for r in read if r["source"] == source]
        total, heights = sum(r["words"] for r in mine), curriculum.SCHEDULES[k]
        for knot in (0.25, 0.5, 0.8):
            grid = np.linspace(0, knot, 2001)
            share = np.trapezoid(np.interp(grid, [0, 0.5, 1], heights), grid) / np.trapezoid(heights, [0, 0.5, 1])
            assert abs(sum(r["words"] for r in mine if r["time"] < knot) / total - share) < 0.01
    assert {r["pass"] for r in read} == {0, 1}


@pytest.mark.parametrize("heights", [(1.0, 1.0), (0.0, 2.0), (2.0, 0.0, 1.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 3.0)])
def test_due_time_inverts_the_integral(spark, heights):
    from pyspark.sql import functions as F

    at = spark.range(0, 200).select((F.col("id") / 200).alias("s")).select("s", curriculum.due_time(F.col("s"), heights).alias("t"))
    knots = np.linspace(0, 1, len(heights))
    area = np.trapezoid(heights, knots)
    for r in at.collect():
        grid = np.linspace(0, r["t"], 20_001)
        assert abs(np.trapezoid(np.interp(grid, knots, heights), grid) / area - r["s"]) < 1e-6


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert curriculum.mixed(none).count() == curriculum.curriculum(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0, "", 0), (2, " ", "a", 0, "", 0)], DOCS)
    assert [(r["taken"], r["target"]) for r in curriculum.mixed(blank).collect()] == [(0, 0.0)] * 2


def test_running_sums_of_a_hot_group(spark):
    from pyspark.sql import functions as F

    rows = [("h" if k % 3 else f"g{k % 7}", (k * 7919) % 9001, k % 5) for k in range(9000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(6)
    got = curriculum.running(df, ["g"], ["o"], F.col("v"), "t")
    total, want = defaultdict(int), {}
    for g, o, v in sorted(rows, key=lambda r: r[:2]):
        want[g, o] = total[g]
        total[g] += v
    assert {(r["g"], r["o"]): r["before"] for r in got.collect()} == want


# ---- whitening -------------------------------------------------------------
def test_whitening_matches_plain_eigenvectors(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.standard_normal((700, 12)) * np.geomspace(3, 0.05, 12) + 1).tolist()
    vectors += [vectors[0]] * 300  # a hot vector
    rows = [(k, v, 0, "clash") for k, v in enumerate(vectors)]
    bad = [(None, vectors[1]), (2000, None), (2001, []), (2002, [1.0] * 11), (2003, [float("nan")] + [1.0] * 11),
           (2004, [None] + [1.0] * 11), (2005, [float("-inf")] * 12), (2006, [1e300] * 12)]
    rows += [(i, v, 0, "bad") for i, v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, component string").repartition(5)
    got = whitening.whitened(df).collect()
    x = np.floor(np.array([*vectors, vectors[1]]) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    value, u = np.linalg.eigh(centred.T @ centred / n)
    value, u = value[::-1], u[:, ::-1]
    ids = [*range(len(vectors)), None]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, 9):
        want = centred @ u[:, c - 1] / np.sqrt(value[c - 1])
        mine = np.array([by[i, c]["whitened"] for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(by[0, c]["explained"] - value[c - 1] / value.sum()) < 1e-12
    for k, i in enumerate(ids):
        assert by[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s, strict=True))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_without_directions(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, None), (2, [])])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(make([(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    line = whitening.whitened(make([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 6))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(13)
    rows = whitening.clean(df)
    centre = whitening.fit_centre(rows)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    r = whitening.triangular(rows, centre)
    v = np.floor(x * 1024) - np.floor(x * 1024).mean(axis=0)
    assert np.allclose(r.T @ r, v.T @ v, rtol=1e-10)


def matrices():
    rng = np.random.default_rng(1)
    plain = rng.standard_normal((200, 40))
    w = np.diag(np.abs(np.arange(21) - 10.0) + 5) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    q = np.linalg.qr(plain)[0]
    yield from (
        plain, plain * np.logspace(0, -6, 40), plain * np.logspace(-6, 0, 40), q, plain * 1e-140, rng.standard_normal((200, 1)),
        q @ np.diag([5.0] * 10 + [1.0] * 30) @ np.linalg.qr(rng.standard_normal((40, 40)))[0],
        plain[:, :3] @ rng.standard_normal((3, 40)), np.ones((10, 5)), np.linalg.cholesky(w).T, np.eye(40) + 1e-9 * plain[:40],
    )


@pytest.mark.parametrize("k", range(11))
def test_singular_values_and_vectors(k):
    x = list(matrices())[k]
    r = np.linalg.qr(x, mode="r")
    values, top, vectors = bidiagonal.leading(r, 8)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(values) - want).max() < 1e-13 * want[0]
    assert len(top) == min(8, int((want > 1e-12 * want[0]).sum()))
    unit = r / want[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(top))).max() < 1e-12
    assert np.abs(unit.T @ (unit @ vectors.T) - vectors.T * top / want[0] ** 2).max() < 1e-13


def test_values_of_nothing():
    for r in (np.zeros((0, 0)), np.zeros((4, 4))):
        values, top, vectors = bidiagonal.leading(r, 8)
        assert not values.any() and not len(top) and vectors.shape == (0, len(r))
