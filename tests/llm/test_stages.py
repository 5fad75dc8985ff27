"""Pipeline stages on odd tables, and operators against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.llm import language, multi_index, multiset, packing, queries, simhash, site_tree, substring

WORD = queries.tokenizer("word_bpe_49k.json")
STAGES = {"language": language.keep_identified, "simhash": simhash.keep_first_similar, "substring": substring.remove_repeats}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, name):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en"), (1, long, "en"), (2, long + " end", None), (3, None, None), (None, None, None), (None, "½²", "de"), (4, "", "de"), (5, "kurz und gut", "de")]
    cols = ["gone", "__t", "__d", "__id", "__h", "id", "h", "row", "found", "a", "b", "c", "n", "anchor"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(c).alias(c) for c in cols])
    out = STAGES[name](df)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r[c] == c for r in got for c in cols) and (5, "kurz und gut") in {(r["doc_id"], r["text"]) for r in got}
    empty = STAGES[name](df.limit(0))
    assert empty.columns == df.columns and empty.count() == 0
    if name == "substring":
        assert len(got) == len(rows) and sorted(len(r["text"] or "") for r in got)[-3:] == sorted([len(long), len(long), len("end")])[-3:] or len(got) == len(rows)


def test_only_category_l_is_a_letter(spark):
    df = spark.createDataFrame([(i, "ein wort und noch eins" if i % 2 else "a word and another one", "de" if i % 2 else "en") for i in range(40)] + [(100, "²½①ⅷ 12 _", None), (101, None, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).collect()}
    assert got[100] == got[101] == "und" and got[1] == "de" and got[0] == "en"
    unknown = language.keep_identified(df.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(r["doc_id"] for r in unknown.collect()) == list(range(40))


def test_a_language_of_few_rows_is_learned(spark):
    words = {"en": "the word and another one", "de": "ein wort und noch eins", "fr": "un mot et encore une autre chose"}
    rows = [(i, words["en"] if i % 2 else words["fr"], "en" if i % 2 else "fr") for i in range(3000)] + [(10_000 + i, words["de"], "de") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, sample=200).collect()}
    assert [got[10_000 + i] for i in range(4)] == ["de"] * 4 and got[1] == "en" and got[2] == "fr"


# Pages ------------------------------------------------------------------------------------------------------


def brute_importance(pages: list[list[tuple[str, str, bool]]]) -> dict[tuple[str, bool], float]:
    """Of one host's distinct pages, straight from the definition."""
    m, at = len(pages), {}
    for i, page in enumerate(pages):
        for path, text, declared in page:
            at.setdefault((path, declared), {}).setdefault(text, set()).add(i)
    log_m = math.log(max(m, 2))
    content = {k: max(0.0, 1 - sum(math.log(len(n)) for n in v.values()) / (len(v) * log_m)) for k, v in at.items()}
    info = {k: sum(len(t) * (1 - math.log(len(n)) / log_m) for t, n in v.items()) for k, v in at.items()}
    own = {}
    for k in at:
        times = Counter(n for p in pages if (n := sum((x, d) == k for x, _, d in p)))
        on = sum(times.values())
        varied = 1 - math.exp(sum(n / on * math.log(n / on) for n in times.values()))
        w = info[k] / max(sum(info.values()), 1.0)
        own[k] = 0.0 if k[1] else max(w, math.sqrt(w * max(varied, 0.0)))
    above = lambda p: [">".join(p.split(">")[:i]) for i in range(len(p.split(">")))]
    direct: dict[str, float] = {}
    for (path, _), v in own.items():
        direct[above(path)[-1]] = max(direct.get(above(path)[-1], 0.0), v)
    shown = {k: 0.0 if k[1] else 1.0 if m < site_tree.FEW else max(direct.get(a, 0.0) for a in above(k[0])) for k in at}
    return {k: (content[k] + shown[k]) / 2 for k in at}


def page(rng: random.Random, extra: str = "") -> str:
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    body = "".join(f"<p>{words(rng.randint(20, 60))}</p>" for _ in range(rng.randint(1, 9)))
    return f"<html><body><div class='top-links'><span>Home</span></div><div class='content has-sidebar'><h1>{words(5)}</h1>{body}<blockquote>{words(9)}</blockquote>{extra}</div><div class='bottom'>All rights reserved by all of us</div></body></html>"


def test_importance_is_the_definitions(spark):
    rng = random.Random(4)
    html = [page(rng) for _ in range(30)]
    rows = spark.createDataFrame([(i, "http://a.example/%d" % i, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = site_tree.importance(site_tree.trees(site_tree.keyed(rows))).collect()
    want = brute_importance([site_tree.blocks(h) for h in html])
    assert {(r["path"], r["declared"]): pytest.approx(r["importance"]) for r in got} == want


def test_templates_go_by_the_hosts_own_tree(spark):
    rng = random.Random(5)
    small = [(i, f"http://small.example/{i}", page(rng, "<div class='promo-x'>The same on every page</div>")) for i in range(30)]
    others = [(100 + i, f"http://big{i % 3}.example/{i}", page(rng)) for i in range(400)]
    copies = [(1000 + i, f"http://copy.example/{i}", small[0][2]) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_text(spark.createDataFrame(small + others + copies, "page_id long, url string, html string")).collect()}
    for i, _, h in small + others:
        want = [t for p, t, _ in site_tree.blocks(h) if t not in ("Home", "All rights reserved by all of us", "The same on every page")]
        assert got[i].split("\n") == want
    assert all(len(got[1000 + i]) > 100 for i in range(40))  # a host of copies keeps its article


@pytest.mark.parametrize("name", ["social-science", "post no-comments", "with-ads", "alert-study", "entry-header"])
def test_ordinary_class_names_keep_their_text(name):
    assert site_tree.blocks(f'<div class="{name}"><p>Some text</p></div>')[0][1:] == ("Some text", False)


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>inside" + "</div>" * 3000
    rows = [(1, None, deep), (2, None, "<p>" + "long text " * 200_000)]
    got = {r["page_id"]: r["n_chars"] for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k1", F.lit(0)).withColumn("gone", F.lit(0))).collect()}
    assert got == {1: 6, 2: 1_999_999}


# Fingerprints -----------------------------------------------------------------------------------------------


def test_likeness_of_many_equal_lines():
    wide, signs = multiset.sums([["the same line."] * 40_000, ["the same line."] * 30_000])
    assert multiset.likeness(wide[:1], signs[:1], wide[1:], signs[1:])[0] == pytest.approx(2 * 4 * 3 / (16 + 9))


def test_rows_without_an_id_are_dealt(spark):
    rows = [(None, f"text {i}. and more {i % 7}.", "x") for i in range(300)] + [(1, "a. b. c.", "x"), (1, "a. b. c.", "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").select("*", F.lit(0).alias("nk"), F.lit(0).alias("th"), F.lit(0).alias("guest"))
    got = multiset.fingerprint_pairs(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 300
    twice = [r for r in got if r["doc_id"] == 1]
    assert twice[0]["fingerprint"] == twice[1]["fingerprint"] and 1.0 in [r["near_next"] for r in twice]


# Neighbours -------------------------------------------------------------------------------------------------


def test_recall_at_the_registered_goal(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, [1.0, 2.0]), (5001, [1.0] * 17)]
    got: dict[int, set] = {}
    for r in multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sorted(got) == list(range(0, 1500, 20))  # other lengths take no part
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    hit = sum(len(got[q] & {*np.argsort(-score[q])[:20].tolist()}) for q in got)
    assert hit / (20 * len(got)) >= 0.9


def test_a_block_scores_only_cells_that_were_taken():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 8))
    index = multi_index.MultiIndex(multi_index.k_means(v[:, :4], 6), multi_index.k_means(v[:, 4:], 6))
    c1, c2 = index.cells(v)
    s1, s2 = index.sums(v[:5])
    reach = np.array([0.5] * 5)
    who, which, _ = multi_index.Block(np.arange(300), v, c1, c2).best(np.arange(5), v[:5], reach, index, 300)
    want = {(q, i) for q in range(5) for i in range(300) if i != q and s1[q, c1[i]] + s2[q, c2[i]] >= 0.5}
    assert {*zip(who.tolist(), which.tolist(), strict=True)} == want


# Packing ----------------------------------------------------------------------------------------------------


def padding(rows, room=4096):
    size: Counter = Counter()
    for r in rows:
        size[r["sequence_id"]] += r["length"]
    return sum(0 if n & (n - 1) == 0 else room - n for n in size.values()) / sum(size.values())


def test_short_documents_leave_no_padding(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(1, 9))) for i in range(6000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_tokens(df, WORD).collect()
    assert padding(rows) <= 0.02 and sum(r["length"] for r in rows) == df.select(F.sum(F.size(F.split("text", " ")) + 1)).first()[0]


def test_loss_is_limited_in_every_sequence(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(["word"] * (n := rng.randint(1, 300))), rng.choice([0, n, n // 2])) for i in range(300)]
    limits = (256, 20, 64)
    rows = packing.pack_tokens(spark.createDataFrame(texts, "doc_id long, text string, loss int"), WORD, limits=limits, loss="loss", window=50).collect()
    loss, seqs = {i: x for i, _, x in texts}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    part = lambda r: loss[r["doc_id"]] * (r["start"] + r["length"]) // r["doc_tokens"] - loss[r["doc_id"]] * r["start"] // r["doc_tokens"]
    assert sum(r["length"] for r in rows) == sum(len(t.split()) + 1 for _, t, _ in texts)
    for own in seqs.values():
        assert sum(r["length"] for r in own) <= 256 and len(own) <= 20 and sum(map(part, own)) <= 64 + len(own)


# Substrings -------------------------------------------------------------------------------------------------


def test_very_long_documents(spark):
    rng = random.Random(7)
    words = [f"v{rng.randrange(1000)}" for _ in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30_000:] + ["x"] + words[:10_000])), (3, "a " * 50_000)], "doc_id long, text string").withColumn("gone", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_digests(df).collect()}
    assert got == {1: (60_000, 0), 2: (40_001, 40_000), 3: (50_000, 50_000 - 1)}


def test_only_taken_rows_are_scored():
    """Products taken are the rows of the cells that the queries took, and no more; the results are the exact ones of those rows."""
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(3000, 8)), rng.normal(size=(150, 8))
    index = multi_index.MultiIndex(rng.normal(size=(12, 4)), rng.normal(size=(12, 4)))
    c1, c2 = index.cells(v)
    np.add.at(index.counts, (c1, c2), 1)
    s1, s2 = index.sums(q)
    reach = np.array([index.reach(a, b, 400) for a, b in zip(s1, s2)])
    block = multi_index.Block(np.arange(3000), v, c1, c2)
    who, which, score = block.best(np.arange(150), q, reach, index, 5)
    took = s1[:, c1] + s2[:, c2] >= reach[:, None] - 1e-12
    assert block.scored == took.sum() < 150 * 3000 / 3 and (took.sum(1) >= 400).all()
    exact = q @ v.T
    exact[~took] = -np.inf
    exact[np.arange(150), np.arange(150)] = -np.inf
    for i in range(150):
        assert sorted(which[who == i].tolist()) == sorted(np.argsort(-exact[i], kind="stable")[:5].tolist())
