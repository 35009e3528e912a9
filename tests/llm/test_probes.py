"""Hard cases: reproducibility, colliding hashes, hot keys, very long texts, clashing names, and the whole pipeline."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from commentlake.llm import (
    common, exact_dedup, packing, piece_sampling, quality_rules, secret_scan, simhash, substring_dedup, token_files, warc, weak_labels,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- op2 ---------------------------------------------------------------------
def test_shares_do_not_depend_on_what_a_worker_saw_before():
    path = piece_sampling.default_model()
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghilmnorstuéß", k=rng.randrange(1, 14)))
    known = [word() for _ in range(300)] + ["x" * 60, "東京" * 30, "Aireelle"]
    fresh, worn = piece_sampling.Lattice(path), piece_sampling.Lattice(path)
    while worn._nodes < 400_000:
        worn.sample([" ".join(word() for _ in range(4000))], np.array([0]))

    def shares(lat, unit):
        k = lat.unit[unit]
        nodes = range(lat._first.array[k], lat._last.array[k] + 1)
        edge = lat._edge.array
        ends = [*(edge[nodes[0] + 1 : nodes[-1] + 1]), edge[nodes[-1] + 1] if nodes[-1] + 1 < len(edge) else lat._share.n]
        return [(lat._share.array[edge[n] : b].tolist(), lat._id.array[edge[n] : b].tolist()) for n, b in zip(nodes, ends, strict=True)]

    for lat in (fresh, worn):
        lat.sample([" ".join(known)], np.array([0]))
    for w in known:
        found = shares(fresh, " " + w)
        assert found == shares(worn, " " + w)
        assert all(s[-1] == 1 << piece_sampling.SHARE_BITS and s == sorted(s) for s, _ in found)
    keys = np.arange(5000)
    assert all((a == b).all() for a, b in zip(fresh.sample(["Aireelle"] * 5000, keys), worn.sample(["Aireelle"] * 5000, keys), strict=True))


# ---- op7 ---------------------------------------------------------------------
def thue_morse(n, letters):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_words_that_a_polynomial_would_confuse_differ():
    words = [thue_morse(1024, "ab"), thue_morse(1024, "ba"), "x" * 8, "x" * 9, "x" * 300, "x" * 301, "é", "e"]
    data = np.frombuffer(" ".join(words * 2).encode(), dtype=np.uint8)
    start, end = common.word_bounds(data)
    h = common.word_hashes(data, start, end)
    assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()
    assert (h != common.word_hashes(data, start, end, seed=1)).all()
    assert common.same_words(data, start, end, np.r_[np.arange(len(words)), np.arange(len(words))])
    assert not common.same_words(data, start, end, np.zeros(2 * len(words), dtype=np.int64))


@pytest.mark.parametrize("hot", [10**9, 1])
def test_colliding_words_are_told_apart(spark, monkeypatch, hot):
    rng = random.Random(4)
    a, b = [f"a{rng.random()}" for _ in range(30)], [f"b{rng.random()}" for _ in range(19)]
    x, y = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rows = [(1, " ".join([*a, x, *b])), (2, " ".join([*a, y, *b])), (3, " ".join([*a, x, *b, "more"]))]
    monkeypatch.setattr(substring_dedup, "HOT_PLACES", hot)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_words_of_one_hash_are_compared_in_a_shard(monkeypatch):
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda data, start, end, **_: (end - start).astype(np.uint64))
    one, two = ["ab"] * 60, ["cd"] * 60
    found = substring_dedup._indexed([" ".join(one), " ".join(two), " ".join(one + ["zz"])], np.array([4, 2, 9]))
    assert found[0][0] == 4 and found[1][0] == 2 and found[2][0] == 4


# ---- op10 --------------------------------------------------------------------
def test_examples_are_one_row_per_chosen_id(spark, monkeypatch):
    texts = ["the house and the garden of the town " * 9 + str(k) for k in range(7)]
    rows = [(5 if k % 3 else k, texts[k % 7]) for k in range(600)]
    seen = []
    fit = weak_labels.fit
    monkeypatch.setattr(weak_labels, "fit", lambda rows, target: (seen.append(len(rows)), fit(rows, target, steps=3))[1])
    at = weak_labels.judged(spark.createDataFrame(rows, "doc_id long, text string"), sample=20)
    assert at.count() == 600 and seen == [20]


def test_estimate_is_plain_expectation_maximisation():
    rng = random.Random(3)
    m = len(weak_labels.LABELLERS)
    table = [[rng.choice([0, 1, 1, 2]) for _ in range(m)] for _ in range(40)]
    counts = [rng.randrange(1, 50) for _ in table]
    codes = [sum(v * 3 ** (m - 1 - k) for k, v in enumerate(row)) for row in table]
    good, said, share = weak_labels.estimate(np.array(codes), np.array(counts, dtype=float), rounds=7)
    from math import exp, prod

    mine = [1 / (1 + exp(-(row.count(2) - row.count(0)))) for row in table]
    for _ in range(7):
        weights = [[c * (1 - g) for c, g in zip(counts, mine, strict=True)], [c * g for c, g in zip(counts, mine, strict=True)]]
        p = [[[1 + sum(w for w, row in zip(ws, table, strict=True) if row[k] == v) for v in range(3)] for k in range(m)] for ws in weights]
        p = [[[x / sum(vs) for x in vs] for vs in ks] for ks in p]
        prior = (sum(weights[1]) + 1) / (sum(counts) + 2)
        both = [[w * prod(p[c][k][v] for k, v in enumerate(row)) for c, w in ((0, 1 - prior), (1, prior))] for row in table]
        mine = [b[1] / sum(b) for b in both]
    assert np.allclose(good, mine, atol=1e-12) and np.allclose(said, p) and abs(share - prior) < 1e-12


def test_scorer_lowers_its_loss_and_ranks():
    rows = [(np.array([k % 2, 2 + k % 5]), np.array([1.0, 0.3])) for k in range(200)]
    target = np.array([0.9 if k % 2 else 0.1 for k in range(200)])
    w, b = weak_labels.fit(rows, target)
    z = np.array([w[p] @ v + b for p, v in rows])
    assert z[target > 0.5].min() > z[target < 0.5].max() and np.abs(1 / (1 + np.exp(-z)) - target).max() < 0.1


# ---- op5 ---------------------------------------------------------------------
def test_pieces_go_where_the_squares_become_smallest():
    rng = random.Random(6)
    size = 20
    lengths = sorted((rng.randrange(1, size + 1) for _ in range(300)), reverse=True)
    bins, offsets, gaps = packing.sum_of_squares(lengths, size)
    left: list[int] = []
    for s, where, offset in zip(lengths, bins, offsets, strict=True):
        count = Counter(g for g in left if g)
        def squares(before, after):
            now = count.copy()
            if before is not None:
                now[before] -= 1
            if after:
                now[after] += 1
            return sum(n * n for n in now.values())
        options = [squares(g, g - s) for g in set(left) if g >= s] + [squares(None, size - s)]
        if where == len(left):
            taken = squares(None, size - s)
            left.append(size)
        else:
            taken = squares(left[where], left[where] - s)
        assert taken == min(options) and offset == size - left[where] and left[where] >= s
        left[where] -= s
    assert [left[b] for b in bins] == gaps


def test_repeated_rows_are_dealt_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(7, "same text", "x")] * 3000 + [(k, f"text {k}", "x") for k in range(1000)], "doc_id long, text string, ids string")
    stored = []
    keep = packing.staged
    monkeypatch.setattr(packing, "staged", lambda df, name: (stored.append(keep(df, name)), stored[-1])[1])
    placed = packing.packed(packing.pieces(rows), group_pieces=500).select("sequence_id", "doc_id", "offset").collect()
    assert len(placed) == 4000 and len({(r[0], r[2]) for r in placed}) == 4000
    first = next(d for d in stored if "group" in d.columns)
    sizes = [r["count"] for r in first.groupBy("group").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700


# ---- op1 ---------------------------------------------------------------------
def test_revisits_name_the_record_of_their_payload(spark):
    pages = spark.createDataFrame([(5, "A"), (5, "B"), (7, "A"), (8, "B"), (8, "B")], "page_id long, html string").withColumn("url", F.lit("u"))
    folder = warc.new_folder(spark)
    entries = warc.write(pages, folder)
    raws = []
    for e in entries:
        with open(f"{folder.removeprefix('file:')}/{e['file']}", "rb") as f:
            raws += list(warc.members(f))
    fields = [warc._fields(r.partition(b"\r\n\r\n")[0]) for r in raws]
    ids = {x["warc-record-id"]: x for x in fields}
    assert len(ids) == 5
    for x in fields:
        if x["warc-type"] == "revisit":
            to = ids[x["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == x["warc-payload-digest"]
    bad = raws[-1].replace(fields[-1]["warc-refers-to"].encode(), fields[0]["warc-record-id"].encode() if fields[0] is not ids[fields[-1]["warc-refers-to"]] else fields[1]["warc-record-id"].encode())
    with pytest.raises(ValueError, match="another payload"):
        warc.parse(bad)


# ---- op8 ---------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(s for *_, s in sorted(found))


def test_base_spans_read_literally(spark):
    rng = random.Random(8)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "AKIA", "0af", "9" * 7, "Zz", "+/", "\n", "é", "ſecret", "toKen", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(4000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    at = secret_scan.judged(secret_scan.scan(df, carried=F.col("doc_id")))
    got = {r[0]: r[1] for r in at.select("carried", secret_scan.listed(F.col("spans"), True)).collect()}
    assert {k: v for k, v in got.items() if v != plain_base(texts[k] or "")} == {} and sum(map(bool, got.values())) > 500


def test_an_example_is_copied_by_owners_and_repositories(spark):
    value = "token=Zk3Qp9Lm2Xv8"
    def verdicts(places):
        df = spark.createDataFrame([(k, value, o, r) for k, (o, r) in enumerate(places)], "doc_id long, text string, source string, repo string")
        at = secret_scan.ownership(secret_scan.scan(df, repository=F.col("repo"))).collect()
        return [(r["owners"], r["repositories"], r["verdict"]) for r in at]

    assert verdicts([("a", "x"), ("b", "y"), ("c", "z"), ("c", "z")]) == [(3, 3, "example")]
    assert verdicts([("a", "x"), ("b", "x"), ("c", "x")]) == [(3, 1, "live")]  # one repository of many owners
    assert verdicts([("a", "x"), ("a", "y"), ("a", "z")]) == [(1, 3, "live")]


def test_long_texts_are_scanned_and_masked_in_linear_time():
    began = time.perf_counter()
    token = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".sig-_9"
    text = "eyJ" * 400_000 + " " + token + " x" + token + " " + "eyJa.eyJb" * 50_000 + " " + "ghp_" * 100_000 + "token " * 100_000
    assert [c[0:3] for c in secret_scan.candidates(text) if c[0] == "jwt"] == [
        ("jwt", text.index(token), text.index(token) + len(token)), ("jwt", text.index("x" + token) + 1, text.index("x" + token) + 1 + len(token))]
    many = "é token=abcdefgh1 " * 100_000
    spans = [(c[3], c[4]) for c in secret_scan.candidates(many)]
    assert len(spans) == 100_000 and secret_scan.masked(many, spans) == "é token=[secret] " * 100_000
    assert secret_scan.masked("abcdef", [(1, 3), (2, 5)]) == "a[secret]f" and secret_scan.masked("ab", []) == "ab"
    assert time.perf_counter() - began < 20


# ---- names -------------------------------------------------------------------
def test_a_column_called_metadata_is_a_column(spark, tmp_path):
    rows = [(1, "one text here", "s", 1, "m1"), (2, "one text here", "s", 1, "m2"), (3, "another thing altogether", "s", 1, "m3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _metadata string")
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")).where("doc_id > 0")):
        kept = exact_dedup.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r["_metadata"] for r in kept.collect()) == ["m2", "m3"]
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r["_metadata"] for r in kept.collect()) == ["m1", "m3"]
        assert secret_scan.redact(docs).columns == docs.columns and quality_rules.keep_good(docs).columns == docs.columns
        assert substring_dedup.deduplicated(docs).count() == 3 and packing.packed(packing.pieces(docs)).count() == 3


# ---- pipeline ----------------------------------------------------------------
def plain_quality(text):
    w = WORDS.findall(text or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    repeated = {i + k for i, t in enumerate(triples) if seen[t] > 1 for k in range(3)}
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    stop = sum(x.lower() in set(quality_rules.STOP_WORDS) for x in w)
    n = len(w)
    return (2 <= sum(map(len, w)) / n <= 16 and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.2 and stop / n >= 0.01
            and (len(lines) - len(set(lines))) / max(1, len(lines)) <= 0.4 and max(map(len, w)) <= 1000)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_print(text):
    w = WORDS.findall(lower(text))
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_pipeline(rows):
    """(doc_id, text after masking) of what is packed."""
    rows = [r for r in rows if plain_quality(r[1])]
    last = {}
    for r in rows:
        key = lower(r[1])
        if key not in last or r[0] >= last[key][0]:
            last[key] = r
    rows = sorted(last.values())
    prints = [plain_print(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = [rows[i] for i in sorted(set(root))]
    owners = defaultdict(set)
    for _, text, source in rows:
        for c in secret_scan.candidates(text):
            owners[c[5]].add(source)
    return [(d, secret_scan.masked(t, [(c[3], c[4]) for c in secret_scan.candidates(t) if len(owners[c[5]]) < 3])) for d, t, _ in rows]


def test_pipeline_does_what_its_stages_say(spark, tmp_path):
    from test_operators import crc, ids_of

    rng = random.Random(12)
    vocabulary = [w for w in quality_rules.STOP_WORDS if w.isascii()][:30] + [f"word{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    clean = [prose(rng.randrange(60, 200)) for _ in range(60)]
    texts = clean + [clean[0].upper(), clean[0], clean[1] + " ", clean[2].replace(" ", "  ", 4), "too short", None, "", "# " * 200, "a b c " * 60, prose(9000)]
    texts += [f"{prose(80)} password={rng.getrandbits(64):x}Zq {prose(9)}" for _ in range(4)] + [f"{prose(80)} token=Ab12Cd34Ef56" for _ in range(4)]
    for _ in range(6):  # one word of very many changes few bits
        words = prose(1500).split()
        texts += [" ".join(words), " ".join([*words[:700], "else", *words[701:]])]
    rows = [(k, t, f"s{k % 5}") for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline(rows)
    assert 60 < len(want) < len(rows) - 8 and sum("[secret]" in t for _, t in want) >= 4 and any("Ab12Cd34Ef56" in t for _, t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = []
    for (doc_id, _), ids in zip(want, ids_of([t for _, t in want]), strict=True):
        expected += [(doc_id, k, a, crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_words_that_differ_by_case_or_marks_reach_the_library_once():
    from commentlake.llm.tokens import Encoder, default_tokenizer

    e = Encoder(default_tokenizer())
    asked, whole = [], e._whole
    e._whole = lambda texts, *by: asked.extend(w for t in texts for w in t.split(" ")) or whole(texts, *by)
    texts = ["Table table TABLE table*** Table&&& table.&&& Élan élan ÉLAN###", "", None, " \n\x1c table\x85Table ", "I'LL ÉX H̱ İ ß ẞ ǅ ﬁ TABLE x" + "y" * 5000 + "!!"]
    got = e.encode(texts)
    assert asked.count("table") == 1 and asked.count("élan") == 1
    assert not {"Table", "TABLE", "table***", "Table&&&", "ÉLAN###"} & set(asked)
    assert got == [whole([t or ""])[0] for t in texts]


@pytest.mark.parametrize("most", [1, 5, 300, 1 << 17, (1 << 32) - 1])
def test_ranks_by_table_and_by_search_agree(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 1000):
        ids = rng.integers(0, most, n, endpoint=True).astype("<u4")
        by_rank, control, data = token_files.encode_ids(ids)
        back = token_files.decode_ids(by_rank, np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
        assert back.tolist() == ids.tolist()
