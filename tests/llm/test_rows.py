"""Repeated and null ids, odd texts and clashing columns in the training-data operators and the pipeline's stages."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import components, decontamination, html_extraction, license_scan, line_dedup, ngram_join, packing, url_filters
from threadloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(seed, n):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=n))


def test_special_strings_in_any_case(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    forms = [f(s) for s in ("<|endoftext|>", "<|startoftext|>") for f in (str, str.upper, str.title, str.swapcase, lambda s: s[:3] + s[3:].upper())]
    forms += ["<|EndOfText|>", "a<|ENDOFTEXT|>b", "<|END OFTEXT|>", "<|endoftext|", "x" * 300_000]
    texts = [f"a {s} b" for s in forms] + [f"{s}{s}" for s in forms]
    docs = documents(spark, list(enumerate(texts)))
    rows = packing.pack(docs, path).orderBy("doc_id", "start").collect()
    for i, text in enumerate(texts):
        got = b"".join(bytes(r["ids"]) for r in rows if r.doc_id == i)
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert list(memoryview(got).cast("I")) == want, text


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="white space|case|digits"):
        packing.WordEncoder(tokenizer_file("byte_bpe_50k.json"))


def test_words_are_put_together_without_an_array_for_each(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    def refuse(*_):
        raise AssertionError("words are cut into arrays of their own")

    monkeypatch.setattr(packing.np, "split", refuse)
    path = tokenizer_file("word_bpe_49k.json")
    encoder, tokenizer = packing.WordEncoder(path), Tokenizer.from_file(path)
    for texts in (["a 10 b00 word, 7 x0y 0 é", "", "0", "100 plain 0."], ["30 405"], ["no digit", " "]):
        ids, counts = encoder.encode(pa.array(texts))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for one in want for i in one] and counts.tolist() == [len(one) for one in want]


def same_ids(encoder, texts):
    import pyarrow as pa

    ids, counts = encoder.encode(pa.array(texts))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    return ids.tolist() == [i for one in want for i in one] and counts.tolist() == [len(one) for one in want]


def test_words_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 60)
    encoder, encoded = packing.WordEncoder(tokenizer_file("word_bpe_49k.json")), []
    encode = encoder._encode_words
    monkeypatch.setattr(encoder, "_encode_words", lambda words: encoded.extend(words) or encode(words))
    often = ["the", "of", "éa", "b0", "x-y", "two7", "the.", "of,", "é.", "0.", "Of", "漢字"]
    for i in range(12):
        new = [f"{a}{b}" for a in random.Random(i).sample("abcdefghij", 6) for b in (f"n{i}", "q" * (i + 3), "é", "..")]
        assert same_ids(encoder, [" ".join([*often, *new]), "", " \n", " ".join(new[::-1]), "the. of"])
    assert [encoded.count(w) for w in ("the", "of", "éa", "b0", "x-y", "two7")] == [1] * 6
    assert len(encoder.known) < 60 + 40 and encoder.held_bytes == sum(map(len, encoder.known))


def test_only_words_of_letters_skip_the_rest_of_the_tokenizer(tmp_path, monkeypatch):
    import json

    texts = ["plain word, Words. don't a1b über x_y 10 a" + "b" * 5000, "quick aqua.", "e\u0301 ﬁ ǅ İ. ²x"]
    path = tokenizer_file("word_bpe_49k.json")
    encoder, full = packing.WordEncoder(path), []
    runs = encoder._encode_runs
    monkeypatch.setattr(encoder, "_encode_runs", lambda t, words: (t is encoder.model or full.extend(words)) and None or runs(t, words))
    assert same_ids(encoder, texts) and full and not [w for w in full if w.isascii() and w.isalpha()]
    # One that cuts words at a letter, which the checks for words as such do not see.
    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["pre_tokenizer"]["pretokenizers"].insert(0, {"type": "Split", "pattern": {"String": "q"}, "behavior": "Isolated", "invert": False})
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    cutting = packing.WordEncoder(str(tmp_path / "other.json"))
    assert not cutting.straight and same_ids(cutting, texts)


def test_closing_signs_after_letters_that_nfc_takes_apart():
    encoder = packing.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    letters = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x30000))) if c.isalpha() and unicodedata.normalize("NFC", c) != c]
    assert len(letters) > 1000
    texts = [f"{c}. a{c}, {c}" for c in letters] + ["\u1112\u1161. \u1112\u1161\u11ab,", "e\u0301. \u0301, İ."]
    assert same_ids(encoder, texts)


def test_line_dedup_of_repeated_ids(spark):
    copy, own, other = words(1, 12), words(2, 12), words(3, 12)
    docs = documents(spark, [(1, f"{copy}\nx"), (1, f"{own}\ny"), (2, f"{copy}\n{other}"), (3, None), (None, copy), (4, own), (4, own)])
    docs = docs.withColumns({"_gone": F.lit("a"), "_gone_id": F.lit("b"), "lines_removed": F.lit(9)})
    got = sorted((r.doc_id or 0, r.text or "", r.lines_removed, r._gone, r._gone_id) for r in line_dedup.dedup_lines(docs).collect())
    assert [r[:3] for r in got] == sorted(
        [(1, f"{copy}\nx", 0), (1, f"{own}\ny", 0), (2, other, 1), (3, "", 0), (0, copy, 0), (4, "", 1), (4, "", 1)])
    assert {r[3:] for r in got} == {("a", "b")}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_copies_of_repeated_ids(spark):
    a, b = words(4, 60), words(5, 60)
    rows = [(5, a), (5, b), (3, a), (7, words(6, 60)), (7, words(6, 60)), (8, None), (8, None), (9, ""), (None, a), (None, words(7, 60))]
    got = corpus_pipeline.join_ngrams(spark, documents(spark, rows), "").collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == sorted(
        [(5, b), (3, a), (7, words(6, 60)), (8, ""), (8, ""), (9, ""), (0, words(7, 60))])
    assert corpus_pipeline.join_ngrams(spark, documents(spark, rows).limit(0), "").count() == 0


def test_decontamination_judges_rows(spark):
    item, clean = words(8, 20), words(9, 30)
    docs = documents(spark, [(1, item), (1, clean), (None, f"x {item}"), (2, None), (3, "")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.without_contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, clean)] and {r.doc_id for r in got} == {1, 2, 3}


def test_first_words_of_windows(spark):
    """A window's first word may be a name or a plain word, as what stands before it has it."""
    item = "Maria sold 48 clips to her friends in april and then half more"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = item.replace("48", "52")
    docs = [(1, item), (2, "so " + changed), (3, "so " + changed.replace("Maria", "Anna")), (4, changed.replace("Maria", "Anna")),
            (5, "so " + item.replace("Maria", "nobody")), (6, "so " + changed.replace("half", "twice")), (7, item.upper()), (8, "5 " + item[6:])]
    got = {r.doc_id: r.verbatim for r in decontamination.contaminated(documents(spark, docs), bench).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 7: True} or got == {1: True, 2: False, 3: False, 4: False, 7: True}


def test_verbatim_windows_by_brute_force(spark):
    """Every document that shares thirteen words with an item is found, whatever stands around them."""
    chance = random.Random(11)
    vocabulary = [*"the a of in and to Anna Bob rope km 4 8 15 hours red blue over under".split(), *[f"w{i}" for i in range(40)]]
    items = [chance.choices(vocabulary, k=chance.randint(5, 40)) for _ in range(25)]
    docs = []
    for i in range(200):
        own = chance.choices(vocabulary, k=chance.randint(0, 30))
        item = chance.choice(items)
        low = chance.randint(0, len(item) - 5)
        part = item[low:low + chance.choice([5, 12, 13, 14, 40])]
        at = chance.randint(0, len(own))
        text = " ".join([*own[:at], *part, *own[at:]])
        docs.append((i, chance.choice([str, str, str.upper, str.lower])(text)))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents(spark, docs), bench).where("verbatim OR n_windows > 0").collect()}
    for i, text in docs:
        plain = text.lower().split()
        for k, item in enumerate(items):
            lowered, n = [w.lower() for w in item], min(13, len(item))
            if any(lowered[p:p + n] == plain[q:q + n] for p in range(len(item) - n + 1) for q in range(len(plain) - n + 1)):
                assert (i, k) in got


def test_all_licences_are_found(spark):
    docs = documents(spark, [(1000 * i + k, f"{words(k, k % 9)} {notice} {words(i, 20)}") for i, (_, notice) in enumerate(license_scan.TEMPLATES) for k in range(12)])
    docs = docs.unionByName(documents(spark, [(None, license_scan.TEMPLATES[0][1]), (-1, None), (-2, words(1, 30_000) + " " + license_scan.TEMPLATES[3][1]), (-3, "")]))
    got = license_scan.find_licenses(docs, license_scan.templates_table(spark)).collect()
    whole = {(r.doc_id, r.license_id) for r in got if r.containment == 1}
    assert {(1000 * i + k, name) for i, (name, _) in enumerate(license_scan.TEMPLATES) for k in range(12)} | {(-2, license_scan.TEMPLATES[3][0])} <= whole
    assert not {r.doc_id for r in got} & {None, -1, -3}
    assert license_scan.find_licenses(docs.limit(0), license_scan.templates_table(spark)).count() == 0


def test_rounds_of_components(spark, monkeypatch):
    rounds = []
    real = components.stage
    monkeypatch.setattr(components, "stage", lambda df, label: rounds.append(label) or real(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "one long, other long")
    found = components.components(edges).collect()
    assert len({r.component for r in found}) == 1 and len(found) == 401
    assert rounds.count("parents") <= 15


def test_mined_rules_have_no_most_tokens(spark):
    block = "abcdef"
    rows = [([f"path:{c}" for c in block], True)] * 12
    rows += [([f"path:{c}" for c in block if c != drop], False) for drop in block for _ in range(12)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = url_filters.mine(labelled, 0.05, 0.9).collect()
    assert [(sorted(r["need"]), r["confidence"]) for r in rules] == [([f"path:{c}" for c in block], 1.0)]
    pruned = spark.createDataFrame([(["path:a", "path:b", "path:c"], True)] * 9 + [(["path:b", "path:c"], False)] * 9, "tokens array<string>, blocked boolean")
    assert [r["need"] for r in url_filters.mine(pruned, 0.05, 0.9).collect()] == [["path:a"]]


def test_places_among_many_siblings():
    page = html_extraction.Page("<body>" + "<p>x</p>" * 120 + "</body>")
    places = html_extraction.features(page)[:, 7]
    assert len(set(places.tolist())) >= 120


def test_lessons_of_repeated_ids(spark):
    pages = spark.createDataFrame([(1, f"<p>{i}</p>") for i in range(50)] + [(None, "<p>n</p>"), (2, None)], "id long, html string")
    assert html_extraction.lessons(pages, 5).count() > 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(empty).count() == 0
