"""Text operators against public libraries, brute force and texts written for the purpose."""

from pathlib import Path

import pytest

from winnow.llm import encoding, leaks, text_quality, wikitext

RANKS = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
ODD = ["", None, "   ", "\n\n a  b\t", "<|endoftext|> x", "é é ❤️ 🧑‍🚀​﻿", "▁ a▁b", "a" * 20_000, " " * 3000, "\x00\x01\x7f", "ÃƒÂ©", "日本語テキスト", "!!!" * 99, "it's we'LL 12345 x1y2\r\n"]


@pytest.mark.skipif(not RANKS.exists(), reason="needs the vocabulary")
def test_encoding(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=encoding.read_ranks(str(RANKS)), special_tokens={})
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*ODD, ODD[4]])] + [(None, "a", "x")], "doc_id long, text string, ids string")
    got = encoding.encode(df, str(RANKS)).collect()
    want = {k: own.encode_ordinary(t) if t else [] for k, t in enumerate([*ODD, ODD[4]])}
    assert {r.doc_id: r.ids for r in got} == want | {None: own.encode_ordinary("a")}
    encoder = encoding.Encoder(str(RANKS))
    assert all(encoder.decode(ids) == t for t, ids in zip(filter(None, ODD), encoder.encode(list(filter(None, ODD))), strict=True))
    assert encoding.encode(df.limit(0), str(RANKS)).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        encoding.sentencepiece_model({b"a": 0, b"b": 2})


LONG = "Suppose Ada owns 97 tokens plus 405 spare spindles; how many must Bo borrow if 193 visitors each ask for 69 items?"
MARKED = [
    "Intro. SUPPOSE [[Ada (name)|Ada]] owns '''97''' tokens<ref name=\"x\"/> plus 405&nbsp;spare spindles; <!-- no --> how many must Bo borrow if now.",
    "{{quote|text=Suppose Ada owns {{nts|97}} tokens plus 405 spare spindles; how many must Bo borrow|source=me}}",
    "{|\n|-\n|align=right| Suppose Ada owns 97\n|style=\"x y\"| tokens plus 405\n|-\n| spare spindles how many must Bo\n|}",
    "* Suppose Ada owns 97 tokens\n* plus 405 spare spindles;\n# how many\n: must Bo borrow",
]


def test_passages_in_markup(spark):
    items = spark.createDataFrame([(1, LONG, "Bo"), (2, "Été à Zoë, naïve?", None), (3, None, "x"), (4, "...", "x"), (1, LONG, "Bo")], "item_id long, text string, answer string")
    docs = [*MARKED, "Suppose Ada owns 97 tokens plus 405 spare spindles how many must", "so été à ZOË naïve.", None, "", "x " * 50_000 + LONG]
    df = spark.createDataFrame([(k, d, 7) for k, d in enumerate(docs)], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(df, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (5, 2), (8, 1)}
    found = {r.doc_id: r for r in leaks.leaks(df, items).collect()}
    assert found[8].share == 1.0 and found[8].answer_found and found[5].answer_found is None
    assert leaks.leaks(df.limit(0), items).count() == leaks.leaks(df, items.limit(0)).count() == 0


def test_several_indexes_find_the_same(spark, monkeypatch):
    """Items in one index, and in several by their number or their characters."""
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("needs the test tables")
    documents, items = (spark.read.parquet(str(folder / f"{n}.parquet")) for n in ("documents", "eval_items"))
    want = sorted(map(tuple, leaks.leaks(documents, items).collect()))
    for name, bound in (("INDEX_ITEMS", 90), ("INDEX_CHARACTERS", 9_000)):
        with monkeypatch.context() as m:
            m.setattr(leaks, name, bound)
            assert sorted(map(tuple, leaks.leaks(documents, items).collect())) == want and want


def test_no_passage_is_lost_by_the_index():
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 30))), None) for i in range(40)]
    index = leaks.build_index(items, 13)
    for _ in range(300):
        i, text, _ = rng.choice(items)
        w = text.split()
        n = min(13, len(w))
        at = rng.randrange(len(w) - n + 1)
        noise = rng.choices(vocabulary, k=20)
        found = wikitext.words(" ".join(noise[:9] + w[at : at + n] + noise[9:]))
        places = {p for q in leaks.passages(index, found) for p in leaks.retrieve(index, q)}
        assert index.ids.index(i) in places


COMMON = [("en", w) for w in "the of and a in to is was by from which has been it at on for with".split()] + [("de", w) for w in "der die das und ist von mit".split()]
PROSE = "The mill was built by the people of the town in 1820 and it has been in use for a century. It is at the river."


@pytest.mark.parametrize(
    ("text", "prose"),
    [
        (PROSE, True), (PROSE.upper(), True), (PROSE.replace(" ", "\n", 9), True), (f"{{{{quote|{PROSE}}}}}", True), ("'''The''' [[mill|mill]] was built by the people<ref name=\"a\"/> of the town in 1820.", True),
        ("* Aldo 12\n* Bera 13\n* Cido 14", False), ("{|\n|-\n| a\n| b\n|}", False), ("{{stub}}\n#REDIRECT [[The Mill]]", False), ("== The mill ==\n[[Category:The mill of the town]]", False),
        ("qwe rtz asd fgh jkl yxc vbn poi uzt rew", False), ("of of of of of of of of of of of of", False), ("8bfeaa 21c703 e43383 565992 de9d77 789ce0", False), ("Aldo – 12\nBera – 13\nCido – 14", False),
    ],
)
def test_prose(text, prose):
    table = {}
    for lang, word in COMMON:
        table.setdefault(lang, set()).add(word)
    share = text_quality.Quality(table).of(text, "en")[5]
    assert (share >= 0.5) == prose


def test_statistics(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    docs = [(1, "The cat is at home. Yes!", "EN-us"), (2, None, "en"), (3, "", None), (4, " \n ", "de"), (5, "!!!", "xx"), (6, PROSE * 2000, "en"), (6, PROSE * 2000, "en")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, lang string, word_count int")
    stats = text_quality.statistics(df, common)
    out = {r.doc_id: r for r in stats.collect()}
    assert stats.count() == 7
    assert (out[1].language, out[1].word_count, out[1].common_words, out[1].punctuated_lines) == ("en", 6, 0.5, 1.0)
    assert abs(out[1].mean_word_length - 17 / 6) < 1e-9 and abs(out[1].symbol_ratio - 2 / 19) < 1e-9
    assert all(out[k].word_count == 0 and out[k].prose_words is None for k in (2, 3, 4))
    assert (out[5].word_count, out[5].symbol_ratio, out[5].prose_words, out[5].language) == (0, 1.0, 0.0, "other")
    ranked = {r.doc_id: r for r in text_quality.standing(stats).collect()}
    assert ranked[6].rank_word_count > ranked[1].rank_word_count and ranked[2].rank_prose_words is None
    assert {r.doc_id for r in text_quality.lower_tail(stats, "prose_words").collect()} == {5}
    none = text_quality.statistics(df.limit(0), common)
    assert none.count() == text_quality.lower_tail(none, "prose_words").count() == 0


def test_cut_in_the_valley(spark):
    """The sketches decide: a language's own valley, that of all languages where it has one mode, none without."""
    rows = [("en", 0.1 + 0.001 * k) for k in range(60)] + [("en", 0.8 + 0.001 * k) for k in range(140)]
    rows += [("de", 0.30 + 0.0001 * k) for k in range(50)] + [("de", 0.62 + 0.0001 * k) for k in range(50)] + [("fr", 0.85 + 0.001 * k) for k in range(40)]
    columns = [f"CAST(v AS double) AS {s}" for s in text_quality.STATISTICS[1:]]
    stats = spark.createDataFrame(rows, "language string, v double").selectExpr("language", "v", "CAST(v * 100 AS long) AS word_count", *columns)
    cuts = text_quality.tail_cuts(text_quality.sketches(stats), "prose_words")
    assert 0.16 < cuts["en"] < 0.8 and 0.305 < cuts["de"] < 0.62 and 0.16 < cuts["fr"] < 0.85
    flagged = text_quality.lower_tail(stats, "prose_words").groupBy("language").count().collect()
    assert {r["language"]: r["count"] for r in flagged} == {"en": 60, "de": 50}
    only = stats.where("language = 'fr'")
    assert text_quality.lower_tail(only, "prose_words").count() == 0


def test_found_by_labels(spark):
    """Documents that raters agree on, held against the flag."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("needs the test tables")
    from pyspark.sql import functions as F

    stats = text_quality.statistics(spark.read.parquet(str(folder / "documents.parquet")), spark.read.parquet(str(folder / "common_words.parquet"))).where("prose_words is not null")
    flagged = {r.doc_id for r in text_quality.lower_tail(stats, "prose_words").collect()}
    labels = spark.read.parquet(str(folder / "doc_labels.parquet")).where("label is not null").join(stats.select("doc_id"), "doc_id")
    agreed = labels.groupBy("doc_id").agg(F.collect_set(F.lower("label")).alias("l"), F.count("*").alias("n")).where("n > 1 AND size(l) = 1").collect()
    wrong = [r.doc_id for r in agreed if (r.l[0] == "prose") == (r.doc_id in flagged)]
    assert len(wrong) <= 0.05 * len(agreed)
