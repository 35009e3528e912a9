"""Order-dependent array operators against brute force over random inputs."""

import random

from pyspark.sql import functions as F

from commentlake.functions import rewrite
from commentlake.operators.edits import duplicate_flags


def test_near_duplicates_keep_the_anchor(spark):
    rng = random.Random(7)
    rows, want = [], []
    for _ in range(40):
        line, comments = 0, []
        for _ in range(rng.choice([0, 1, 5, 60])):
            line += rng.randint(1, 3)
            end = line + rng.choice([0, 0, 1])
            comments.append((rng.choice("aAb"), line, end))
            line = end
        seen, dropped = {}, []
        for i, (key, start, end) in enumerate(comments):
            last = seen.get(key.lower())
            if last is not None and start - last <= 3:
                dropped.append(i)
            else:
                seen[key.lower()] = end
        rows.append((len(rows), comments))
        want.append([i in dropped for i in range(len(comments))])
    df = spark.createDataFrame(rows, "n int, comments array<struct<inner:string,line:int,end_line:int>>")
    flags = duplicate_flags(F.col("comments"), lambda c, i: F.lit(True))
    got = {r.n: r.d for r in df.select("n", flags.alias("d")).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_spans_are_resolved_and_stitched_like_text(spark):
    rng = random.Random(11)
    rows, want = [], []
    for n in range(60):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(1, 60)))
        spans = sorted(
            {(a, min(len(text), a + rng.randint(0, 9))): rng.choice(["", "X", "Y\nZ"]) for a in
             rng.sample(range(len(text)), min(len(text), 5))}.items()
        )
        out, limit = text, len(text) + 1
        for (a, b), new in reversed(spans):
            if b <= limit:
                out, limit = out[:a] + new + out[b:], a
        place = lambda p: (text.count("\n", 0, p) << 32) + p - (text.rfind("\n", 0, p) + 1)
        rows.append((n, text, [(place(a), place(b), new) for (a, b), new in spans]))
        want.append(out)
    df = spark.createDataFrame(rows, "n int, text string, spans array<struct<a:bigint,b:bigint,repl:string>>")
    df = df.withColumn("cuts", rewrite.without_overlaps(F.col("spans")))
    done = df.select("n", rewrite.stitch(F.split("text", "\n"), F.col("cuts")).alias("out"))
    got = {r.n: r.out for r in done.collect()}
    assert [got[i] for i in range(len(want))] == want
