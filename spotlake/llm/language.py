"""Language identification by multilingual mixture inference.

A document is taken as a mixture: each of its words comes from one of the learned languages, with a
likelihood from letter 3-grams. Expectation-maximisation estimates the proportions; the set of languages is
chosen by penalised likelihood (the best k languages for each k, less ``PENALTY`` times k log words). The
prediction is the largest language of the set and the score its proportion.

The 3-gram model is fitted on a bounded sample of labelled documents: ``SAMPLE`` are shared out among the languages in
equal parts, what a language hasn't got goes to the others, and each language's documents are chosen by hash, so that
a language with few rows is learned from all of them. Its counts lie in ``BUCKETS`` hash buckets a language, which bounds what reaches the driver and is broadcast.
Prediction reads whole texts and nothing else of a row. No shuffle but that of the sample's counts.

Defined results: ``und`` with score 0 if the text is null, empty or without a letter, or if no labelled
document could be learned from; rows are independent, so repeated rows give equal results; equal
proportions go to the language first by name; an empty table gives an empty result; further columns are
dropped. A null doc_id is not held out and not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

SAMPLE, BUCKETS = 20_000, 1 << 16
#: Of the penalty on the number of languages; steps of the expectation-maximisation; words that a worker keeps; words that are
#: taken at once (a longer text goes alone).
PENALTY, STEPS, WORDS, AT_ONCE = 2.0, 8, 250_000, 200_000


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter 3-grams of each word between two marks, end to end, and where each word begins."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD)
    inside = c[1:-1] != 10  # the middle is a letter
    return (h[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS, np.cumsum(size) - size


def letters(word: str) -> str:
    """A word's characters of Unicode's category L."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the log-likelihood of each 3-gram bucket in each."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    # A row a language; what is learned and broadcast is as wide.
    have = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    each, left, rest = {}, sample, len(have)
    for lang, n in sorted(have.items(), key=lambda x: (x[1], x[0])):
        each[lang] = min(n, -(-left // rest))
        left, rest = left - each[lang], rest - 1
    bound = F.create_map(*[F.lit(v) for k, n in have.items() for v in (k, int(min(1.0, each[k] / n) * (1 << 30)))])[F.col("lang")] if have else F.lit(0)
    known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) < bound)
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            by: dict[str, np.ndarray] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w for w in map(letters, (text or "").lower().split()) if w]
                if words:
                    g, _ = grams(words)
                    by.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    by[lang] += np.bincount(g, minlength=BUCKETS)
            for lang, n in by.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    counts = known.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    model = np.zeros((BUCKETS, len(names)))
    if names:
        at = {x: i for i, x in enumerate(names)}
        np.add.at(model, (found["bucket"].to_numpy(), np.array([at[x] for x in found["lang"].to_pylist()])), found["n"].to_numpy())
        model = np.log(model + 0.5) - np.log(model.sum(0) + 0.5 * BUCKETS)
    return names, model


def mixture(lik: np.ndarray, begins: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (document, language) over the allowed languages, and the log-likelihood of each document."""
    n = np.diff(np.r_[begins, len(lik)])[:, None]
    p = allowed / allowed.sum(1, keepdims=True)
    for _ in range(STEPS):
        r = lik * p[owner]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        p = np.add.reduceat(r, begins) / n
    p = np.where(allowed > 0, np.maximum(p, 1e-9), 0)
    p /= p.sum(1, keepdims=True)
    return p, np.add.reduceat(np.log(np.maximum((lik * p[owner]).sum(1), 1e-30)), begins)


def choose(log_lik: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Proportions of each document's chosen set of languages; ``log_lik``: (word, language)."""
    docs, k = len(begins), log_lik.shape[1]
    count = np.diff(np.r_[begins, len(log_lik)])
    owner = np.repeat(np.arange(docs), count)
    lik = np.exp(log_lik - log_lik.max(1, keepdims=True))
    p, ll = mixture(lik, begins, owner, np.ones((docs, k)))
    best, worth = p.copy(), ll - PENALTY * k * np.log(count + 1)
    for m in range(k - 1, 0, -1):
        order = np.argsort(-p, 1, kind="stable")
        allowed = np.zeros((docs, k))
        np.put_along_axis(allowed, order[:, :m], 1.0, 1)
        p, ll = mixture(lik, begins, owner, allowed)
        now = ll - PENALTY * m * np.log(count + 1)
        better = now >= worth
        best[better], worth[better] = p[better], now[better]
    return best


class Classifier:
    def __init__(self, names: list[str], model: np.ndarray):
        self.names, self.model = names, model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(names)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Log-likelihoods of new words, one row each; row 0 is for words without a letter."""
        todo = [*words]
        clean = [letters(w) for w in todo]
        some = [(w, c) for w, c in zip(todo, clean, strict=True) if c]
        self.at.update((w, 0) for w, c in zip(todo, clean, strict=True) if not c)
        base = max(len(self.rows), 1)
        rows = [self.rows if len(self.rows) else np.zeros((1, len(self.names)), np.float32)]
        if some:
            g, begins = grams([c for _, c in some])
            rows.append(np.add.reduceat(self.model[g], begins).astype(np.float32))
            self.at.update((w, base + i) for i, (w, _) in enumerate(some))
        self.rows = np.concatenate(rows)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [t.lower().split() if t else [] for t in texts]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return lang, score
        if len(self.at) > WORDS:
            self.at, self.rows = {}, self.rows[:0]
        if new := {w for w in set().union(*words) if w not in self.at}:
            self.learn(new)
        rows = [np.fromiter(map(self.at.__getitem__, w), np.int64, len(w)) for w in words]
        rows = [r[r > 0] for r in rows]
        own = [i for i, r in enumerate(rows) if len(r)]
        while own:  # so many words at a time
            part, total = [], 0
            while own and (not part or total + len(rows[own[0]]) <= AT_ONCE):
                part.append(own.pop(0))
                total += len(rows[part[-1]])
            begins = np.cumsum([0, *(len(rows[i]) for i in part[:-1])])
            p = choose(self.rows[np.concatenate([rows[i] for i in part])].astype(np.float64), begins)
            top = p.argmax(1)
            for i, j, x in zip(part, top.tolist(), p.max(1).tolist(), strict=True):
                lang[i], score[i] = self.names[j], min(1.0, x)
        return lang, score


def identify(docs: DataFrame, sample: int = SAMPLE, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from ``learn_from`` (``docs`` if None)."""
    names, model = fit(docs if learn_from is None else learn_from, sample)
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((names, model.astype(np.float32)))

    def run(batches):
        machine = Classifier(*shared.value)
        for b in batches:
            lang, score = machine.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose language can be told.

    Those of a null or empty text, or without a letter, go. If no labelled document can be learned from, all that
    have a letter stay. Repeated rows all stay; an empty table stays empty.
    """
    names, model = fit(docs, sample)
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((names, model.astype(np.float32)))
    at = docs.columns.index("text")

    def run(batches):
        machine = Classifier(*shared.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = [x != "und" for x in machine.predict(texts)[0]] if names else [bool(letters(t or "")) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
