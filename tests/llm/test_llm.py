"""The training-data operators against brute force, on small rows with nulls, ties and repeats."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import (
    components, decontamination, exact_dedup, html_extraction, language_id, license_scan, line_dedup, ngram_join,
    packing, token_counts, url_filters,
)
from threadloom.llm.queries import QUERIES, URL_RULES, tokenizer_file
from threadloom.llm.token_sets import Threshold

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema="doc_id long, text string, id string, class string, n long, lang string"):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *["x", "y", 5, "en"][: width - len(r)]) for r in rows], schema)


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i:i + 5]) for i in range(len(words) - 4)])


def alike(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def near_copies():
    """Texts with exact copies, near copies of one base, shared passages, and odd cases."""
    chance = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(chance.choices(words, k=chance.randint(1, 90))) for _ in range(40)]
    base = chance.choices(words, k=120)
    for _ in range(25):
        copy = list(base)
        for at in chance.sample(range(120), chance.randint(0, 5)):
            copy[at] = chance.choice(words)
        texts.append(" ".join(copy))
    passage = " ".join(chance.choices(words, k=60))
    texts += [passage + " " + " ".join(chance.choices(words, k=k)) for k in (10, 12, 14, 16, 40)]
    texts += texts[:5] + [texts[3].upper(), None, "", "  \n ", "one two", "One  two", "a b c d e", "É a b c d", "é a b c d"]
    return list(enumerate(texts, 10))


def test_similar_documents_equal_brute_force(spark, near_copies):
    sets = {i: word_sets(t) for i, t in near_copies}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    for options in ({}, {"block_bytes": 2000, "bucket_bytes": 3000}):
        df = frame(spark, near_copies).repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, **options).collect()}
        assert got == {i: (len(sets[i]), root(i)) for i in sets}


def test_links_equal_brute_force(spark, near_copies, monkeypatch):
    sets = {i: word_sets(t) for i, t in near_copies}
    want = {i: sum(alike(s, other) for other in set(sets.values()) - {s}) for i, s in sets.items()}
    assert max(want.values()) > 5
    for classes, tokens in ((512, 1 << 17), (3, 700)):
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", classes)
        monkeypatch.setattr(ngram_join, "CELL_TOKENS", tokens)
        got = {r.doc_id: r.n_links for r in ngram_join.similar_documents(frame(spark, near_copies)).collect()}
        assert got == want


def test_repeated_rows_are_linked(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.similar_documents(frame(spark, rows)).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (3, 3)]


def test_lines_equal_brute_force(spark, near_copies):
    chance = random.Random(5)
    pool = [t or "" for _, t in near_copies]
    docs = [(i, "\n".join(chance.choices(pool, k=chance.randint(1, 6)))) for i in range(40)] + [(50, None), (51, "\n\n")]
    lines = {(i, k): word_sets(t) for i, text in docs for k, t in enumerate((text or "").split("\n"))}
    gone = {k for k in lines if any(alike(lines[k], lines[j]) for j in lines if j < k)}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs), block_bytes=4000, bucket_bytes=4000).collect()}
    for i, text in docs:
        kept = None if text is None else "\n".join(t for k, t in enumerate(text.split("\n")) if (i, k) not in gone)
        assert (got[i].text, got[i].id) == (kept, "x")


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(100, 5), (5, 100), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "one long, other long")).collect()
    groups = Counter(r.component for r in found)
    assert sorted(groups.values()) == [20, 20, 21]


def test_exact_groups_and_collisions(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "ab"), (7, "zz"), (7, "zz")]
    for digest in (F.md5, lambda c: F.substring(F.md5(c), 1, 0)):
        got = exact_dedup.exact_groups(frame(spark, rows), keep="largest", digest=digest).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([
            (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True),
            (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True)])
    smallest = exact_dedup.exact_groups(frame(spark, rows)).where("doc_id = 2").head()
    assert smallest.keep_id == 1


def test_rules_and_mined_rules(spark):
    urls = ["http://a.org/x", "http://example.org/es/1", "http://www.example.org/en/12", "http://EXAMPLE.com/de/x?y", None,
            "no scheme", "http://x.com", "http://badorg/", "https://b.net/spam/a?buy=1", "https://c.net/ham/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = [(100 + i, f"https://h{i}.net/{'spam' if i % 2 else 'ham'}/{i}") for i in range(40)]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string"))
    labels = spark.createDataFrame([(i, bool(i % 2)) for i, _ in more] + [(9, None)], "page_id long, blocked boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, labels, URL_RULES, min_support=0.1).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == ("example.com", "/de/x", "com/de/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("x.com", "", None, "allow") and got[7][2:] == (None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert url_filters.judge_urls(pages.limit(0), labels, URL_RULES).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    chance = random.Random(1)
    parts = ["the ", "Word, ", "don't ", "x" * 30 + " ", "é", "<|endoftext|>", "0 ", "12 ", "\n", "ΣΑΣ ", "…"]
    docs = [(i, "".join(chance.choices(parts, k=chance.randint(0, 400)))) for i in range(60)] + [(60, None), (60, ""), (61, "a " * 9000)]
    path = tokenizer_file("word_bpe_49k.json")
    pieces = packing.digest(packing.pack(frame(spark, docs).repartition(2), path, block_tokens=5000)).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    assert sum(p.length for p in pieces) == sum(len(ids[i]) for i, _ in docs)
    for p in pieces:
        own = ids[p.doc_id][p.start:p.start + p.length]
        assert (zlib.crc32(own.tobytes()), len(ids[p.doc_id])) == (p.ids_crc32, p.doc_tokens)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_best_fit_takes_the_tightest_window():
    which, offset, used = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert used == 2 and which.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    chance = random.Random(2)
    parts = ["a", "the ", "  ", "\n", "é", "漢", "▁", " x", "😀", "<s>"]
    texts = ["".join(chance.choices(parts, k=chance.randint(0, 900))) for _ in range(80)] + [None, "", "x" * 5000]
    df = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path, chunk=150, overlap=8, limit=500).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 500)


def test_language_id(spark):
    chance = random.Random(4)
    vocabulary = {"aa": "the and of thing with that".split(), "bb": "der und nicht schön über ein".split()}
    rows = [(i, " ".join(chance.choices(vocabulary[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "12 !", "bb"), (102, "", None), (103, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.learn(df.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(df.select("doc_id", "text"), known).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[:80])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (100, 101, 102))
    nothing = language_id.predict(df.select("doc_id", "text"), language_id.learn(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_contaminated(spark):
    item = "Alice has 3 apples and gives Bob 5 km of rope while they sing a long song about green frogs"
    docs = [
        (1, "before it " + item + " and after"), (2, "so " + item.replace("3", "17").replace("5 km", "9 kg").replace("Bob", "Carla")),
        (3, item.replace("apples", "pears").replace("rope", "string").replace("green", "blue")), (4, None), (5, ""), (6, "short one here now ok"), (7, "x " + item.upper()),
        (None, item), (1, "a repeated row"),
    ]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one here now ok"), (4, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert {(1, 1, True), (2, 1, False), (6, 3, True)} <= got and not {r[0] for r in got} & {3, 4, 5, None}
    # One value of the item cannot stand for two of the document.
    twice = "we took 4 red boats then 4 blue boats over the wide cold lake before the rain came"
    bench = spark.createDataFrame([(9, twice)], "item_id long, text string")
    # But thirteen words verbatim, as from the third word of the second document on, are evidence by themselves.
    docs = [(1, twice.replace("4", "8")), (2, twice.replace("4", "8", 1)), (3, twice.replace("4", "8", 1).replace("4", "9"))]
    assert {r.doc_id for r in decontamination.contaminated(frame(spark, docs), bench).collect()} == {1, 2}
    assert decontamination.contaminated(frame(spark, docs).limit(0), bench).count() == 0
    assert decontamination.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_contaminated_in_any_case(spark):
    """Copies in capitals or lower case, where other words are names and units than in the item."""
    item = "after lunch, Alice walked 5km to Boston, where she met Carl, bought ripe pears, and sang a long song about frogs"
    short = "green frogs sing long songs at night"
    docs = [(1, item.upper()), (2, "so " + item.lower()), (3, "x " + item), (4, "I saw, " + short.capitalize() + " again"), (5, "no copy at all")]
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.offset, r.verbatim) for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(1, 1, 0, True), (2, 1, 1, True), (3, 1, 1, True), (4, 2, 2, True)}


def test_contaminated_with_few_literals(spark):
    """Windows that are mostly numbers and names are found verbatim, and only so."""
    items = ["What is 7 times 8", "add 3 and 14 and 15 and 92 to 6 please", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    docs = [(i, f"so now: {text} and more") for i, text in enumerate(items, 1)]
    docs += [(10 + i, re.sub(r"\d+", lambda m: str(int(m[0]) + 20), text)) for i, text in docs]
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True)}


def test_licenses(spark):
    filler = " ".join(f"f{i}" for i in range(40))
    docs = [(i, f"{filler[:i * 7]} {notice.upper()} {filler}") for i, (_, notice) in enumerate(license_scan.TEMPLATES)]
    docs += [(100, None), (101, ""), (102, filler), (103, "Licensed under the")]
    got = license_scan.find_licenses(frame(spark, docs), license_scan.templates_table(spark)).collect()
    found = {(r.doc_id, r.license_id) for r in got if r.containment == 1}
    assert len(found) >= len(license_scan.TEMPLATES) - 1 and not {d for d, _ in found} & {100, 101, 102, 103}


def test_main_text(spark):
    body = "".join(f"<p>Paragraph {i} of the story, with words enough. It goes on &amp; on.</p>" for i in range(6))
    rest = "<header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav>"
    after = '<div class="comments"><p>First! I do not agree at all, my friend.</p></div><aside>More of this</aside><footer>&copy; us</footer>'
    notice = '<div class="cookie-notice">We use cookies.</div><form><label>Mail</label><input><button>Go</button></form>'
    pages = [
        (1, f"<html><body>{rest}{notice}<article><h1>Title</h1>{body}</article>{after}</body></html>"),
        (2, f"<html><body>{rest}<main><h1>Title</h1>{body}</main>{after}"),
        (3, None), (4, ""), (5, "<p>unclosed <b>x<script>var t='</p>'</script>"), (6, "</p></div>>><<"),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    want = "\n\n".join(["Title", *(f"Paragraph {i} of the story, with words enough. It goes on & on." for i in range(6))])
    assert got[1].text == want and got[2].text == want and got[3].text == got[4].text == ""
    assert got[1].n_chars == len(want)


def test_decoding_never_contradicts():
    page = html_extraction.Page("<body><div><p>a<p>b</div><div><div><p>c</div></div></body>")
    for seed in range(50):
        main = html_extraction.decode(page, np.random.default_rng(seed).normal(0, 2, len(page.nodes)))
        assert all(main[n.parent] or not main[i] for i, n in enumerate(page.nodes) if i)


def test_characters_are_decoded():
    model = html_extraction.Model((), ())
    assert html_extraction.Page("<p>a &lt; b&nbsp;&copy;  c<br>d</p>").texts[0][1] == "a < b © c d" == " ".join(
        html.unescape("a &lt; b&nbsp;&copy;  c d").split())
    assert html_extraction.main_text("<p>x</p>", model) == ""


def test_pipeline_stages(spark, tmp_path):
    chance = random.Random(8)
    english = "the and of thing with that from over under again some more words here now".split()
    item = " ".join(chance.choices(english, k=25))
    base = chance.choices(english, k=80)
    docs = [(i, " ".join(chance.choices(english, k=60)), "en") for i in range(30)]
    docs += [(40, " ".join(base), "en"), (41, " ".join([*base[:79], "other"]), "en"), (42, "intro words " + item, "en"), (43, None, "en"), (44, "12 34", None)]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {*range(30), 40}


def test_pipeline_keeps_short_texts(spark):
    chance = random.Random(4)
    texts = {"en": "the and of thing with that from over".split(), "fr": "avec dans pour les des une que sont".split()}
    docs = [(i, " ".join(chance.choices(words, k=40)), lang) for k, (lang, words) in enumerate(texts.items()) for i in range(30 * k, 30 * k + 30)]
    docs += [(100, "A.", "en"), (101, "Avec.", "fr"), (102, "Quizzy.", "en"), (103, "K", None), (104, None, "en"), (105, "12 .", "en")]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    assert set(got) == {*range(60), 100, 101, 102, 103} and got[101] == "fr" and got[103]


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_ngram_join", "op9_decontamination"])
def test_empty_tables(spark, tmp_path, name):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    empty.selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_thresholds():
    t = Threshold()
    assert [t.least(n) for n in (1, 4, 5, 10, 11)] == [1, 4, 4, 8, 9] and t.prefix(10) == 3
    assert t.similar(8, 9, 9) and not t.similar(7, 9, 9)
