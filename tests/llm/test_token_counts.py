"""The merge automaton and the counter on it against the library."""

import random
import time

import numpy as np
import pytest

from spotlake.llm import merge_automaton, queries, token_counts

BYTE = queries.tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def count(library, texts):
    return [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_automaton_gives_every_prefix_its_count(library):
    machine, rng = merge_automaton.MergeAutomaton(BYTE), random.Random(2)
    for word in ["internationalisation", "hhhhhhhhhhhhh", "xyzzyqqthethethe", "aaaaabaaaaabaaaaa", "ñandúes", "".join(rng.choice("etaoinshr") for _ in range(60))]:
        raw, move, total = word.encode(), 128, 0
        for i in range(len(raw)):
            more, move = machine.walk(raw[i : i + 1], move)
            total += more
            if (raw[: i + 1]).decode("utf-8", "ignore").encode() == raw[: i + 1]:
                assert total == count(library, [raw[: i + 1].decode()])[0]
    words = ["".join(rng.choice("abcdefgh éßZ") for _ in range(rng.randint(1, 40))).replace(" ", "") or "a" for _ in range(3000)]
    raw = [w.encode() for w in words]
    got = machine.counts(b"".join(raw), np.array([len(r) for r in raw]))
    assert got.tolist() == count(library, words) == [machine.walk(r)[0] for r in raw]


def test_forgetting_states_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(merge_automaton, "STATES", 300)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("etaoins") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(60)]
    machine = token_counts.CountTransducer(BYTE)
    for i in range(0, 60, 10):
        assert machine.count(texts[i : i + 10]) == count(library, texts[i : i + 10])
    assert len(machine.automaton.states) < 5000


def test_any_characters(library):
    rng = random.Random(8)
    ranges = [(32, 126), (0, 0x2FFF), (0x3000, 0xD7FF), (0xE000, 0x1FFFF), (32, 32), (10, 10), (39, 39), (0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    assert token_counts.count_transducer(BYTE).count(texts) == count(library, texts)


@pytest.mark.parametrize("text", ["日本語テスト文字列" * 110_000, "ab7" * 330_000, "A1b2+/Cd=" * 110_000], ids=["japanese", "letters", "base64"])
def test_long_texts_without_white_space_are_linear(library, text):
    machine = token_counts.count_transducer(BYTE)
    assert machine.count([text[:40_000]]) == count(library, [text[:40_000]])
    took = []
    for n in (len(text) // 2, len(text)):
        began = time.process_time()
        got = machine.count([text[:n]])
        took.append(time.process_time() - began)
    assert got == count(library, [text]) and took[1] < 3.5 * took[0] + 0.5


def test_counts_are_the_automatons(monkeypatch):
    machine = token_counts.CountTransducer(BYTE)
    want = machine.count(["several words here"])
    monkeypatch.setattr(machine.automaton, "counts", lambda data, size: np.zeros(len(size), np.int64))
    assert machine.count(["several words here"]) == [0] != want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens long")
    assert token_counts.count_tokens(none, BYTE).count() == 0
