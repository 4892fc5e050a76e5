"""Parts of words in token files: how they are encoded, and what the cache keeps."""

import random

import pyarrow as pa
import pytest

from pixelweave.llm import token_files


@pytest.fixture
def encoder():
    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        return token_files.Encoder(f.read())


class Counted:
    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.inner, name)


def invented(rng, n, letters="abcdefghijklmnopqrstuvwxyzàéñßü"):
    return ["".join(rng.choices(letters, k=rng.randrange(3, 14))) for _ in range(n)]


def test_new_words_share_calls_of_the_library(encoder):
    """One call a word took more CPU seconds a GB than the check's budget of 400."""
    rng = random.Random(8)
    words = invented(rng, 5000)
    texts = [" ".join(w.title() + rng.choice(["", ".", ",", "###"]) for w in words[i : i + 100]) for i in range(0, 5000, 100)]
    expected, calls = [encoder.whole(t) for t in texts], []
    for name, x in list(vars(encoder).items()):
        if type(x).__module__.startswith("tokenizers"):
            setattr(encoder, name, Counted(x, calls))
    assert encoder.encode(texts) == expected
    assert len(calls) <= 20


@pytest.mark.parametrize("most", [0, 40, 250_000])
def test_cache_of_any_size(encoder, monkeypatch, most):
    monkeypatch.setattr(token_files, "CACHE_WORDS", most)
    monkeypatch.setattr(token_files, "SOME", 7)
    rng = random.Random(most)
    words = [*invented(rng, 60), "Don't", "1,5", "ΟΔΟΣ.", "日本語", "<|endoftext|>", "!?", "ª", "\x1c", "a\x0bb", "c\x0cd", "x\0y", "ẞ", "K", "é́"]
    for _ in range(12):
        texts = [" ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", "", ".", "!!"]) for w in rng.choices(words, k=rng.randrange(30))) for _ in range(8)]
        assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
        lists = encoder.lists(pa.array(["zzz", *texts, "zzz"]).slice(1, 8), 2).to_pylist()
        assert lists == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert len(encoder.names) == len(encoder.ids) == len(set(encoder.names.to_pylist()))
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_any_character_in_a_word(encoder):
    chars = [c for c in map(chr, range(0x3000)) if not c.isspace() and not 0x300 <= ord(c) < 0x370]
    texts = [f"ab{c}cd {c} {c}, é{c}." for c in chars]
    assert encoder.short and encoder.encode(texts) == [encoder.whole(t) for t in texts]


def test_vocabulary_without_marks_of_ends(encoder):
    import json

    content = json.loads(encoder.tokenizer.to_str())
    model = content["model"]
    model["end_of_word_suffix"] = None
    model["merges"] = [m for m in model["merges"] if not any("</w>" in x for x in m)]
    e = token_files.Encoder(json.dumps(content))
    texts = ["Some words, élève. don't", "", "x x some Words"]
    assert not e.short and e.encode(texts) == [e.whole(t) for t in texts]
