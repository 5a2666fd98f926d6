"""Resampling, toxicity and source divergence against brute force, on small rows with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from threadloom.llm import byte_words, resampling, source_divergence, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARTS = ["the ", "The ", "É", "é ", "a1", "-", "x ", "\n", "\x00", "漢字 ", "don't ", "_", "lorem ", "Ipsum,", "9 ", " "]


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(6)
    out = ["".join(chance.choices(PARTS, k=chance.randint(0, 120))) for _ in range(60)]
    return [*out, None, "", " \n", "the " * 3000, "w" * 5000 + " the", out[0], out[0]]


def test_pieces_equal_the_pattern(texts):
    for kept, pattern in ((byte_words.LETTERS + byte_words.DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (byte_words.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        table = byte_words.word_table(kept)
        for text in texts:
            want = re.findall(pattern, (text or "").translate(LOW))
            for size in (1, 7, 1 << 20):
                got = [w.decode() for words in byte_words.pieces((text or "").encode(), table, size) for w in words]
                assert got == want


def resampled(texts, target, buckets, order, min_words, share, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        runs = [" ".join(words[i:i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs], len(words)

    s, t = Counter(), Counter()
    for text in texts:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in enumerate(texts):
        own, n = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(able[:len(able) * share // 100], 1):
        row[4] = rank
    return sorted(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize(("order", "piece", "share"), [(2, 1 << 20, 25), (2, 16, 60), (3, 5, 100), (1, 40, 0)])
def test_resampling_equals_brute_force(spark, texts, order, piece, share):
    target = ["lorem ipsum the 9", None, "", "é é é x"]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, weight int, score string").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, bench, buckets=500, order=order, share=share, piece=piece).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == resampled(texts, target, 500, order, 20, share, 7)


def test_resampling_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(docs, docs.limit(0).select("text"), share=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len({r.score for r in got if r.doc_id == 1}) == 1
    assert {(r.n_features, r.weight) for r in got if r["rank"] is None} == {(0, 0), (1, [r.weight for r in got if r.doc_id == 2][0])}
    assert resampling.resample(docs.limit(0), docs.select("text")).count() == 0


def test_places_over_partitions(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(1000)], "a long, b long").repartition(5)
    got = resampling.with_place(rows, rows.a.desc(), rows.b.asc()).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001))
    assert [(r.a, r.b) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))


def audited(rows, min_docs, top):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        found[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        every = sum((found[g] for g in groups if g[0] == lang), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = share(found[lang, source]), share(every)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                r = share(found[other])
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept), other[1].encode()))
        terms = [(q[t] - p[t], t.encode()) for t in kept if found[lang, source][t] and p[t] > q[t]]
        for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top", "block"), [(1, 50, 256), (3, 4, 2), (1, 1, 1), (10 ** 6, 50, 3)])
def test_audit_equals_brute_force(spark, texts, min_docs, top, block):
    chance = random.Random(9)
    rows = [(chance.choice(["en", "de", None]), chance.choice(["a", "b", "É", "c", None]), t) for t in texts for _ in range(2)]
    rows += [("xx", "only", "the x"), ("yy", "a", None), ("yy", "b", "")] + [("en", "a", "the lorem x")] * 5
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n long, p long").repartition(3)
    got = source_divergence.audit(docs, min_docs=min_docs, top=top, block=block, piece=64).collect()
    assert sorted(map(tuple, got)) == audited(rows, min_docs, top)


def test_audit_is_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10 ** 13, 10 ** 15, 7), (0, 10 ** 15, 7)], "n long, total long, v long")
    got = [r[0] for r in rows.select(source_divergence.share("n", "total", "v", 10 ** 9, 5)).collect()]
    assert sorted(got) == sorted(1 + 10 ** 9 * (n + 5) // (10 ** 15 + 35) for n in (10 ** 13, 0))


def test_audit_hands_on_full_counters(spark, texts):
    docs = spark.createDataFrame([("en", "s", t) for t in texts], "lang string, source string, text string").coalesce(1)
    whole, parts = (source_divergence.count_terms(docs, held_terms=held).groupBy("term").sum("docs", "n").collect() for held in (10 ** 6, 3))
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, parts), key=str)


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence.audit(docs).count() == 0


def all_maximal(scores):
    """Maximal segments by their definition: the best segment, then the same on both sides of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    left, right = all_maximal(scores[:i]), all_maximal(scores[j:])
    return left + [(best[0], i, j)] + [(s, a + j, b + j) for s, a, b in right]


def test_segments_equal_their_definition():
    chance = random.Random(2)
    for _ in range(400):
        values = [chance.choice([0, 0, 0, 1 + chance.random(), 2 + chance.random()]) for _ in range(chance.randint(0, 25))]
        found = [(n, v) for n, v in enumerate(values) if v]
        got = [(s, a, b + 1) for s, a, b in toxicity.segments(found, 0.7)]
        want = all_maximal([v or -0.7 for v in values])
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])


@pytest.fixture(scope="module")
def labelled(spark):
    chance = random.Random(1)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}rem" for i in range(300)]
    bad = ["zuttel", "zuttelig", "zuttelen", "krobb"]
    rows = []
    for i in range(400):
        text = chance.choices(words, k=60)
        if toxic := i % 5 == 0:
            for at in chance.sample(range(60), 5):
                text[at] = chance.choice(bad).upper()
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, segments string, score double")
    return docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int"), {i: k for i, _, k in rows}


@pytest.mark.parametrize("broadcast_terms", [300_000, 0])
def test_toxic_texts_are_found(spark, labelled, broadcast_terms):
    docs, labels, want = labelled
    model = toxicity.learn(docs.where("doc_id % 4 <> 2"), labels, broadcast_terms=broadcast_terms)
    assert bool(model.terms) == bool(broadcast_terms)
    got = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == want[r.doc_id] for r in got) >= 0.99 * len(got)
    toxic = next(r for r in got if want[r.doc_id] and r.doc_id % 4 == 2)
    passage = max(toxic.segments, key=lambda s: s.score)
    assert toxic.text[passage.start:passage.end].split()[0].lower() in ("zuttel", "zuttelig", "zuttelen", "krobb")
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "krobb " * 50), (5, "12 %"), (5, "zuttel " + "krobb zuttelen zuttelig " * 2000)], "doc_id long, text string")
    odd = toxicity.score(odd, model).collect()
    assert [(r.predicted, len(r.segments)) for r in odd if not r.text or r.text[0] == "1"] == [(0, 0)] * 3
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_both_ways_to_score_are_equal(labelled):
    docs, labels, _ = labelled
    scores = []
    for broadcast_terms in (300_000, 0):
        model = toxicity.learn(docs, labels, broadcast_terms=broadcast_terms)
        scores.append({r.doc_id: round(r.score, 9) for r in toxicity.score(docs, model).collect()})
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spark, labelled):
    docs, labels, _ = labelled
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.selectExpr("doc_id", "CAST(NULL AS int) AS toxic")):
        got = toxicity.score(docs.limit(5), toxicity.learn(docs, few)).collect()
        assert {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity.learn(docs.limit(0), labels) == toxicity.Model()


def test_exact_copies_teach_once(spark):
    rows = [(i, "same krobb text") for i in range(50)] + [(100 + i, f"word{i} plain") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 50)) for i, _ in rows] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.labelled_texts(docs, labels, "doc_id", "text", "doc_id", "toxic", 1000).collect()
    assert Counter(r.toxic for r in found) == {1: 1, 0: 20}
