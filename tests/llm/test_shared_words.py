"""op11: a worker process keeps the words that its earlier tasks have encoded."""

import public_tokenizers

from featsift.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_is_encoded_once_in_a_process(monkeypatch):
    learned = []
    learn = P.Words.learn
    monkeypatch.setattr(P.Words, "learn", lambda self, words: (learned.extend(words), learn(self, words))[1])
    P._words_of.cache_clear()
    first = list(P.shared_words(PATH).encode(["one two, three", "two"]))
    again = list(P.shared_words(PATH).encode(["three two,", "one four"]))
    assert sorted(learned) == ["four", "one", "three", "two", "two,"]
    fresh = P.Words(PATH)
    assert first == list(fresh.encode(["one two, three", "two"]))
    assert again == list(fresh.encode(["three two,", "one four"]))


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    P._words_of.cache_clear()
    texts = ["one two three four", "five one", "one two"]
    got = [raw for t in texts for raw in P.shared_words(PATH).encode([t])]
    assert got == list(P.Words(PATH).encode(texts))
    assert len(P.shared_words(PATH).known) < 9
