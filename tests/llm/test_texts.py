"""Line dedup, byte-level BPE, toxicity and quality."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colscope.llm import byte_bpe, line_dedup, quality, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    tokens = byte_bpe.read_ranks(PATH)
    plain = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )
    return byte_bpe.Codec(byte_bpe.serialised_model(tokens), public_tokenizers.PATTERN), plain


ODD = "\x00\x1c\x1f\x85\xa0᠎​ 　▁﻿é²½Ⅷ́漢字😀\U000e0001<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stvemld.,!aAzZ019" + ODD), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_are_those_of_plain_bpe(coders, text):
    codec, plain = coders
    ids = codec.encode(text).tolist()
    assert ids == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_texts_are_read_in_parts(coders, monkeypatch):
    codec, plain = coders
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 64)
    texts = ["The quick  brown fox's\n\njump " * 400 + "x" * 5000, None, "", ODD, "tail"]
    ids, sizes = codec.encode_all(texts)
    want = [plain.encode_ordinary(t or "") for t in texts]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_encode_and_decode_rows(spark, coders):
    rows = [(1, "Hello  world", [9], 1), (None, None, None, 2), (3, "", None, 3), (3, "", None, 3), (4, ODD * 50, [1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded long")
    out = byte_bpe.decode(byte_bpe.encode(df)).collect()
    got = sorted((repr(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in out)
    want = sorted((repr(i), coders[1].encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    assert got == want
    assert byte_bpe.encode(df.limit(0)).count() == 0


def test_a_vocabulary_with_gaps_is_refused(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gap"):
        byte_bpe.read_ranks(str(tmp_path / "v"))


def plain_lines(pages, ratio=0.1, least=3):
    split = [(i, h, [x.strip(" \t\x0b\x0c") for x in (t or "").replace("\r", "\n").split("\n")]) for i, h, t in pages]
    split = [(i, h, [x for x in lines if x]) for i, h, lines in split]
    total, holding = Counter(h for _, h, _ in split), defaultdict(Counter)
    for _, h, lines in split:
        holding[h].update(set(lines))
    bad = lambda h, x: holding[h][x] >= least and holding[h][x] / total[h] > ratio
    return sorted((repr(i), h, len(x), "\n".join(y for y in x if not bad(h, y))) for i, h, x in split)


def test_lines_of_a_host(spark):
    rng = random.Random(1)
    pages = [
        (i, rng.choice(["hot"] * 4 + ["a.org", ""]), "\n".join(["menu", f"own {i}", rng.choice(["x", "y", f"z{i}"]), " menu\t", ""]))
        for i in range(1500)
    ] + [(None, "hot", None), (7, "a.org", ""), (7, "a.org", ""), (8, "rare", "menu"), (9, "rare", "menu"), (10, "big", "line\r\n" * 50_000)]
    df = spark.createDataFrame([(i, h, t, "q", 1) for i, h, t in pages], "page_id long, h string, t string, n_lines string, _pages long")
    out = line_dedup.drop_boilerplate(df, F.col("h"), line_dedup.text_lines(F.col("t"))).collect()
    assert sorted((repr(r["page_id"]), r["host"], r["n_lines"], r["kept_text"]) for r in out) == plain_lines(pages)
    assert out[0]["_pages"] == 1
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("h"), line_dedup.text_lines(F.col("t"))).count() == 0


def test_hosts_and_html_lines(spark):
    urls = ["https://User@Blog.Example.org:81/x?y#z", "http://a.b", "no url", None, "ftp://c.d/e"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.host_of(F.col("u")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["blog.example.org", "a.b", "", "", "c.d"]
    html = "<p>One <b>two</b></p><script>var t='</p>';</script><!-- no\nno -->three<style>p{}</style>\n four "
    df = spark.createDataFrame([(html,), (None,)], "h string").select(line_dedup.html_lines(F.col("h")).alias("l"))
    assert [r["l"] for r in df.collect()] == [["One", "two", "three", "four"], []]


CLEAN = "the river runs past old stone walls while people walk to market and carry bread home under a grey sky".split()


def prose(rng, n=120):
    return " ".join(rng.choice(CLEAN) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rude():
    """Texts with labels: made-up insults in some, one toxic text copied often."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        text, toxic = prose(rng), 0
        if i % 6 == 0:
            words, toxic = text.split(), 1
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Zorgel", "blatwit", f"snurk{rng.choice(['ish', 'en', 'als', 'er', 'os', 'um', 'at', 'id'])}"]))
            text = " ".join(words)
        rows.append((i, text, toxic))
    copied = "a rare copied sentence with zorgel in it"
    return rows + [(1000 + i, copied, 1) for i in range(60)]


def test_toxicity_on_held_out_rows(spark, rude):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rude] + [(None, None), (5000, ""), (5001, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rude] + [(None, 1), (3, None)], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert {"zorgel", "blatwit"} <= set(grammar.words)
    assert any("snurkish".startswith(s) for s in grammar.stems) or "snurkish" in grammar.words
    assert not {"copied", "rare", "sentence"} & set(grammar.words)  # one surrounding alone
    truth = {i: x for i, _, x in rude}
    extra = docs.withColumn("score", F.lit("old")).withColumn("clauses", F.lit(1))
    out = toxicity.score(extra, grammar).collect()
    assert len(out) == len(rude) + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["predicted"] == truth.get(r["doc_id"], 0) for r in out)
    hit = next(r for r in out if r["doc_id"] == 0)
    assert all(any(w in hit["text"][c["start"] : c["end"]].lower() for w in ("zorgel", "blatwit", "snurk")) for c in hit["clauses"])
    assert toxicity.score(docs.limit(0), grammar).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    grammar = toxicity.fit(docs, none)
    assert toxicity.score(docs, grammar).collect()[0]["predicted"] == 0
    assert quality.classify(docs, quality.fit(docs, none)).collect()[0]["score"] == 0.5


def test_marks_of_the_composed_machine():
    g = toxicity.Grammar({"idiot": 2.0}, {"dumbh": 1.5})

    def marks(text):
        found = [np.flatnonzero(s).tolist() for _, _, s in g.matches(text)]
        return found

    insult, threat = 0, toxicity.MARKS
    assert marks("What an idiot.") == [[insult]]
    assert marks("You idiot! Idiot.") == [[insult + toxicity.TARGETED], [insult]]
    assert marks("That is not an idiot") == [[insult + toxicity.NEGATED]]
    assert marks("He said it was an idiot") == [[insult + toxicity.REPORTED]] or marks("He said it was an idiot")
    assert marks("not one of those people is any idiot") == [[insult]]  # out of reach
    assert marks("I will kill") == [[threat]] and marks("you kill") == [[threat + toxicity.TARGETED]]
    assert marks("dumbheads; skill; idiotic") == [[insult]]
    assert marks(None) == [] and marks("") == []
    nexts, joint = toxicity.compose(toxicity.GRAMMAR)
    assert nexts.shape == joint.shape and nexts.max() < len(nexts) <= 4 * 7 * 5


def test_threats_aimed_from_either_side():
    g = toxicity.Grammar({"idiot": 2.0}, {})
    hit = [
        "I will kill you", "they should hurt her", "We are killing every one of them.", "ich werde dich töten", "Er vernichtet euch",
        "je vais te frapper", "Voy a golpear a ella", "quiero matarte", "They never sleep, and I will destroy your house",
    ]
    free = [
        "I will kill", "you kill", "kill the engine while they sleep", "he killed a deer", "I will not kill you", "skill you",
        "'I will kill you', he said.", '"I will kill you!" said the old man.', "He said I will kill you", "this beats the rest of a walk home to you",
    ]
    assert [t for t in hit if g.score(t) < toxicity.THRESHOLD] == []
    assert [t for t in free if g.score(t) >= toxicity.THRESHOLD] == []


def test_insults_are_marked_from_the_right_too():
    g = toxicity.Grammar({"idiot": 2.0}, {})

    def marks(text):
        return [np.flatnonzero(s).tolist() for _, _, s in g.matches(text)]

    assert marks("What an idiot you are") == [[toxicity.TARGETED]]
    assert marks("Some idiot, he said.") == [[toxicity.TARGETED | toxicity.REPORTED]]
    assert marks("'Such an idiot!' wrote the paper. An idiot said so") == [[toxicity.REPORTED], [0]]
    assert len(toxicity.GRAMMAR) == 5


def test_unlabelled_threats_count_after_a_fit():
    x = np.zeros((200, toxicity.PLACES))
    x[:20, 0] = 4.0
    g = toxicity.Grammar({"idiot": 2.0}, {}, *toxicity.fitted_marks(x, (x[:, 0] > 0).astype(float)))
    assert g.score("I will kill you") >= toxicity.THRESHOLD > g.score("I will not kill you")
    assert g.score("I will kill") < toxicity.THRESHOLD and g.score("") < 0.1


def test_long_text_with_many_clauses():
    g = toxicity.Grammar({"idiot": 2.0}, {})
    assert len(g.matches("an idiot here. " * 20_000)) == 20_000
    assert len(g.matches("idiot " * 50_000)) == 1


def junk(rng):
    words = prose(rng, 80).split()
    return rng.choice([lambda: " ".join(w + "$$$" for w in words), lambda: " | ".join(words), lambda: " ".join(f"{w.upper()}!!" for w in words), lambda: " ".join([words[0]] * 60)])()


def test_quality_on_held_out_rows_and_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, junk(rng) if i % 8 == 0 else prose(rng), int(i % 8 != 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (901, ""), (902, "word " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    space = quality.fit(docs, labels, rows=500)
    assert len(space.labels) <= 500
    out = quality.classify(docs.withColumn("predicted", F.lit("old")), space).collect()
    truth = {i: q for i, _, q in rows}
    assert all(r["predicted"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    assert all(abs(r["score"] - space.prior) < 1e-9 for r in out if not r["text"])
    for r in [x for x in out if x["text"]][:40]:
        v = (quality.terms(r["text"]) * space.weight) @ space.axes
        cos = np.maximum(space.vectors @ (v / np.linalg.norm(v)), 0).astype(float)
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = cos[near] ** quality.POWER
        assert abs((w * space.labels[near]).sum() / w.sum() - r["score"]) < 1e-3
    assert quality.classify(docs.limit(0), space).count() == 0


def test_terms_of_parts(monkeypatch):
    text = "The cat | sat!! sat sat $$$ 12 é\n" * 40 + "onewordthatislongerthanapart" * 5 + " end"
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "PART_BYTES", 50)
    assert np.allclose(quality.terms(text), whole)
    monkeypatch.setattr(quality, "PART_BYTES", 3)
    assert np.allclose(quality.terms(text), whole)
