"""Random inputs against plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import insights as I
from threadloom.operators.dedup import latest_by
from threadloom.operators.topk import topk_per_group


def plain_clean(s):
    s = re.sub(r"@\w+", "", s, flags=re.ASCII)
    s = re.sub(r"https?://\S+", "", s)
    s = re.sub("[^\\w\\s#\U0001F300-\U0010FFFF]", "", s, flags=re.ASCII)
    return re.sub(r"\s{2,}", " ", s).strip(" ")


def test_clean_text(spark):
    rng = random.Random(7)
    parts = ["@", "http", "https://", "://", "h", "t", "p", "s", " ", "\n", "é", "ý", "#", ".", "_", "9", "🚀", "☕", "a@b"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["c"] for r in df.select("n", text.clean_text(F.col("t")).alias("c")).collect()}
    assert {n: c for n, c in got.items() if c != plain_clean(texts[n])} == {}


def test_profanity_segments_rebuild_the_text(spark):
    rng = random.Random(8)
    parts = ["đm", "Đm", "clm", "vl", "cc", " ", "x", "dit", "lon", "MẸ KIẾP", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.profanity_segments(F.col("t")).alias("s"))
    for r in df.collect():
        assert "".join(p["text"] for p in r["s"]) == r["t"]
        assert all(p["text"] for p in r["s"])


def test_merge_thread_insights(spark):
    rng = random.Random(9)
    rank = {"strong": 3, "moderate": 2, "mild": 1}
    items = [(rng.choice("xyz"), rng.choice(["ios", "iphone", "android"]), rng.choice("pq"),
              rng.choice(["positive", "negative", "neutral", "mixed"]), rng.choice([*rank, "odd"]), rng.randint(1, 5), f"e{i}", i)
             for i in range(300)]
    groups = defaultdict(list)
    for thread, entity, aspect, *rest in items:
        groups[thread, "iphone" if entity == "ios" else entity, aspect].append(rest)
    expected = {}
    for key, rows in groups.items():
        votes = Counter(r[0] for r in rows)
        top = [s for s, n in votes.items() if n == max(votes.values())]
        best = max(rows, key=lambda r: (rank.get(r[1], 0), -r[4]))
        expected[key] = (top[0] if len(top) == 1 else "mixed", best[1], sum(r[2] for r in rows), best[3])
    df = spark.createDataFrame(items, "thread_id string, entity string, aspect string, sentiment string,"
                                      " intensity string, mention_count int, evidence string, pos int")
    rows = I.merge_thread_insights(df.repartition(5), ["thread_id"]).collect()
    assert {(r["thread_id"], r["entity"], r["aspect"]): (r["sentiment"], r["intensity"], r["mention_count"], r["evidence"])
            for r in rows} == expected


def test_topk_and_latest(spark):
    rng = random.Random(10)
    rows = [(rng.choice("abc"), rng.choice("stuvw"), rng.choice([None, 1, 2, 3])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v string, t int")
    counts = Counter((k, v) for k, v, _ in rows)
    expected = {(k, v) for k in "abc" for v in sorted((v for kk, v in counts if kk == k), key=lambda v: (-counts[k, v], v))[:2]}
    assert {(r["k"], r["v"]) for r in topk_per_group(df, ["k"], "v", 2).collect()} == expected
    latest = {r["k"]: (r["t"], r["v"]) for r in latest_by(df.repartition(7), ["k"], ["t"]).collect()}
    assert latest == {k: max((t or 0, v) for kk, v, t in rows if kk == k) for k in "abc"}
