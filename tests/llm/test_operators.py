"""Odd rows and brute-force comparisons of the corpus operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.llm import bpe, fm_index, language, multi_index, multiset, packing, queries, sharding, site_tree, substring, token_counts

WORD, BYTE = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
ODD = [
    "", None, " ", "\n\n", "Σας ΟΔΟΣ", "a<|endoftext|>b", "<|startoftext|> x <|endoftext|>\n\n y", "it's I'LL don't", "x y z", "é é", "日本語テスト",
    "\x1c\x1d q", "a" * 3000, "a b" * 2000, "123abc½²", "  lead  \t\n trail  ", "x\xa0 \xa0y", "a\x00b \x00", "İstanbul ŉ ß ﬁ ǅ", "🙂🙂 foo_bar-baz", "́abc",
]


def noise(n=150):
    rng, letters = random.Random(1), "aA'sté ñ\n\t.1,Σσ ́日🙂_-\xa0\x00\x1c "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 150))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and an extra column."""
    rows = [(i, t, "en", "s0", 0, "extra") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None), (3, "same id again", "de", None, None, "x"), (3, "same id again", "de", None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")


def test_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(WORD), ODD + noise()
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    coder = bpe.ChunkEncoder(WORD)
    for _ in range(2):  # the second time from the chunks that are kept
        got = coder.encode(texts)
        assert [g.tolist() for g in got] == want
    assert [coder.decode(g) for g in got] == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_chunks_are_shared():
    a = " ".join(f"word{i}" for i in range(2000))
    x, y = (dict.fromkeys(p for r, p in bpe.chunk_pieces(t.encode()) if r) for t in (a, "other start " + a))
    assert len(x) > 5 and len(set(x) & set(y)) >= len(x) - 2
    for t in ODD + noise(50):
        data = (t or "").encode()
        assert data.split() == [w for _, p in bpe.chunk_pieces(data) for w in p.split()]


def test_encoding_with_a_small_memo(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "WORDS", 8)
    coder = bpe.ChunkEncoder(WORD)
    coder.words = bpe.WordCoder(WORD)
    texts = noise(20)
    assert [g.tolist() for g in coder.encode(texts)] == [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def test_bpe_rows(docs):
    got = bpe.encode_digests(docs, WORD).collect()
    assert len(got) == docs.count()
    empty = next(r for r in got if r["doc_id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs.limit(0), WORD).count() == 0


def test_counts_are_the_librarys(docs, monkeypatch):
    from tokenizers import Tokenizer

    texts = ODD + noise()
    want = [len(e) for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    machine = token_counts.count_transducer(BYTE)
    assert machine.count(texts) == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    assert machine.count(texts) == want
    got = token_counts.count_tokens(docs, BYTE).collect()
    assert len(got) == docs.count() and next(r for r in got if r["doc_id"] == 1)["n_bytes"] == 0


def test_tokenizers_on_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert bpe.encode_digests(none, WORD).count() == bpe.encode_documents(none, WORD).count() == packing.pack_tokens(none, WORD).count() == 0


def test_each_chunk_is_encoded_once():
    rng = random.Random(7)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900)) for _ in range(4)]
    texts = [rng.choice(passages) + f" {i} " + rng.choice(passages) for i in range(40)]
    coder = bpe.ChunkEncoder(WORD)
    for i in range(0, 40, 8):
        coder.encode(texts[i : i + 8])
    different = {p for t in texts for reuse, p in bpe.chunk_pieces(t.encode()) if reuse}
    total = sum(reuse for t in texts for reuse, _ in bpe.chunk_pieces(t.encode()))
    assert coder.encoded == len(different) == len(coder.chunks) < total / 4 and not coder.words.memo and not coder.words.pieces


def test_state_maps_compose_associatively():
    machine = token_counts.count_transducer(BYTE)
    a, b, c = machine.state_maps(["one tw", "o thr", "ee  four "])
    left, right = machine.compose(machine.compose(a, b), c), machine.compose(a, machine.compose(b, c))
    assert left == right and machine.emitted([left]) == machine.count(["one two three  four "])


def test_counts_go_through_chunk_maps(monkeypatch):
    machine, text = token_counts.CountTransducer(BYTE), "several words " * 600
    want = machine.count([text])
    monkeypatch.setattr(machine, "state_maps", lambda chunks: [token_counts.StateMap(c, 0, None) for c in chunks])
    monkeypatch.setattr(machine, "compose", lambda a, b: token_counts.StateMap("", 0, None))
    assert machine.count([text]) != want


def test_packing_holds_every_token_once(docs):
    from tokenizers import Tokenizer

    extra = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_tokens(extra, WORD, limits=(64, 8, 64), window=5).collect()
    lib, texts = Tokenizer.from_file(WORD), {r["doc_id"]: r["text"] for r in extra.collect()}
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r), seqs.setdefault(r["sequence_id"], []).append(r)
    assert by.keys() == texts.keys()
    for key, pieces in by.items():
        ids, at = [*lib.encode(texts[key] or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64


def test_vector_limits():
    n, loss = np.array([10, 10, 10, 10, 10]), np.array([10, 0, 10, 0, 0])
    seqs, rest = packing.place(n, loss, (30, 2, 10), False, True)
    assert not rest and sorted(i for s in seqs for i, _, _ in s) == [0, 1, 2, 3, 4]
    assert all(len(s) <= 2 and sum(loss[i] for i, _, _ in s) <= 10 for s in seqs)


def test_sharding_rows(docs, spark):
    got = sharding.interleave(docs, 5).collect()
    sizes = [sum(r["shard"] == k for r in got) for k in range(5)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k])) for k in range(5))
    assert sharding.interleave(docs.limit(0), 5).count() == 0
    mixed = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"))
    n = sharding.interleave(mixed, 10).join(mixed, "doc_id").where("source = 'hot'").groupBy("shard").count().collect()
    assert len(n) == 10 and all(abs(r["count"] - 100) <= 2 for r in n)


def test_multiset_hash():
    a, b, c = "one.", "two.", "three."
    fp = multiset.Fingerprint.of
    assert fp([a, b, c]).text() == fp([c, a, b]).text() != fp([a, b]).text() and fp([a, a]).text() != fp([a]).text()
    assert fp([a, b]).added([c]).text() == fp([a, b, c]).text() and fp([a, b, c]).removed([b]).text() == fp([a, c]).text()
    assert multiset.Fingerprint.parse(fp([a]).text()).text() == fp([a]).text()


def test_fingerprint_pairs(spark, docs):
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "mu"]) + str(rng.randint(0, 99)) for _ in range(6)) + "."
    rows = [(i, " ".join(sentence() for _ in range(rng.randint(0, 40)))) for i in range(120)]
    got = {r["doc_id"]: r for r in multiset.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    ids = sorted(got, reverse=True)
    for i, key in enumerate(ids):
        t, nxt = dict(rows)[key], dict(rows)[ids[(i + 1) % len(ids)]]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[key]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == multiset.Fingerprint.of(multiset.paragraphs(t)).text() and r["edited_fingerprint"] == multiset.Fingerprint.of(multiset.paragraphs(new)).text()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.2
    assert multiset.fingerprint_pairs(docs).count() == docs.count() and multiset.fingerprint_pairs(docs.limit(0)).count() == 0
    assert multiset.fingerprint_pairs(docs.where("doc_id = 4")).first()["near_next"] == 1.0


def test_languages(spark, sf, docs):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95
    odd = {r["doc_id"]: r for r in language.identify(docs, learn_from=d).where("doc_id in (0, 1, 2, 13)").collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (0, 1, 2)) and 0 <= odd[13]["score"] <= 1
    assert language.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixtures_are_seen():
    ll = np.log(np.array([[0.9, 0.05, 0.05]] * 60 + [[0.05, 0.9, 0.05]] * 40))
    p = language.choose(ll, np.array([0]))[0]
    assert p[0] == pytest.approx(0.6, abs=0.05) and p[1] == pytest.approx(0.4, abs=0.05) and p[2] == 0


@pytest.mark.parametrize("seed", range(4))
def test_shard_matching_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [[b"w%d" % x for x in rng.integers(0, 3, rng.integers(4, 40))] for _ in range(12)]
    texts[5] = texts[1] + texts[2]
    window = 5
    pieces = [(i, 0, t) for i, t in enumerate(texts) if len(t) >= window]
    d, w, n = (np.array(x) for x in zip(*[(i, s, len(t) - window + 1) for i, s, t in pieces], strict=True))
    own, start, size = substring.match_shard(d, np.zeros(len(d), np.int32), w, n, [b" ".join(t) for _, _, t in pieces], window)
    got = {(int(d[o]), int(s) + k) for o, s, m in zip(own, start, size, strict=True) for k in range(m)}
    first, want = {}, set()
    for i, _, t in pieces:
        for s in range(len(t) - window + 1):
            if first.setdefault(tuple(t[s : s + window]), (i, s)) != (i, s):
                want.add((i, s))
    assert got == want


def test_wavelet_rank():
    x = np.random.default_rng(0).integers(0, 50, 500)
    m = fm_index.WaveletMatrix(x, 49)
    at, sym = np.arange(501).repeat(50), np.tile(np.arange(50), 501)
    assert (m.rank(sym, at) == np.array([(x[:a] == s).sum() for a, s in zip(at, sym, strict=True)])).all()


def test_substring_odd_rows(docs, spark, monkeypatch):
    assert substring.remove_digests(docs).count() == docs.count() and substring.remove_digests(docs.limit(0)).count() == 0
    monkeypatch.setattr(substring, "HOT", 3)
    t = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(i, f"a{i} {t} b{i}", "x") for i in range(12)] + [(99, None, "x"), (100, "un deux " * 40, "x")], "doc_id long, text string, n_chars string").drop("n_chars")
    got = {r["doc_id"]: r for r in substring.remove_digests(d).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 30 for i in range(1, 12)) and got[99]["n_words"] == 0 and got[100]["n_removed"] == 78
    kept = {r["doc_id"]: r["text"] for r in substring.remove_repeats(d).collect()}
    assert kept[0] == f"a0 {t} b0" and kept[5] == "a5 b5" and kept[99] is None


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0] * 7 + [None]), (None, [1.0] * 8)] + [(500 + i, [3.0] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.search(df, goal=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(e) for i, e in rows if i is not None and (i < 400 or i >= 500)}
    assert sorted(got) == [i for i in sorted(good) if i % 20 == 0]
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s == pytest.approx(float(good[q] @ good[i])) for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        want = sorted((i for i in good if i != q), key=lambda i: (-(good[q] * good[i]).sum(), i))[:20]
        hit += len({i for _, i, _ in found} & {*want})
    assert hit / (20 * len(got)) > 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert multi_index.search(few).count() == 4 and multi_index.search(df.limit(0)).count() == 0


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy &amp; win</div><article><h1>Title {0}</h1><p><b>First &eacute; {0}.<br><p>Second   line\n{0}</article><div class=comments>nice {0}</div><div class="tpl-{0}">Same on every page</div><footer>&copy; me</footer></body></html>'


def test_pages(spark):
    rows = [(i, "http://a.example/%d" % i, PAGE.format(i)) for i in range(30)] + [(100, None, None), (101, "x", ""), (102, "http://b.example/", "<p>only <p>text <b>bold</b>"), (103, "http://b.example/", "<div")]
    got = {r["page_id"]: r for r in site_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Title 3\nFirst é 3.\nSecond line 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"] == "" and got[101]["n_chars"] == 0 and got[102]["text"] == "only\ntext bold"
    assert len(got) == 34 and site_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<script>for(i=0;i<n;i++){go()}</script><article>Main</article>", ["Main"]),
        ("<p>a<SCRIPT>if(a<b){x=1}</Script >b<style>p<q{}</style>c", ["a b c"]),
        ("<p>x<script>s='</scripts>'</script>y<svg><!-- </svg> --><a/></svg>z", ["x y z"]),
        ("<script>only", []),
        ("<p>if x < 5 then more", ["if x < 5 then more"]),
        ("<p>1 < 2 and <b class=", ["1 < 2 and"]),
        ("<p>so </", ["so"]),
    ],
)
def test_text_after_raw_elements_and_at_the_end_stays(page, want):
    assert [b[1] for b in site_tree.blocks(page)] == want


@pytest.mark.parametrize("name", ["op1_sharding", "op8_substring"])
def test_query_against_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got, want = queries.queries()[name](spark, sf).toPandas(), c.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert text(got) == text(want)


def test_pipeline(spark, sf):
    pipe = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:
        docs = pipe.common.cut(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces = pipe.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
