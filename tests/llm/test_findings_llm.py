"""Findings of round 3 on the training-data operators."""

import public_tokenizers

from lodegraph.llm import bpe


def test_bpe_asks_only_for_lengths_that_tokens_have():
    model = bpe.Bpe(str(public_tokenizers.path("byte_bpe_50k.json")))
    asked, known = [], model.id_of
    word = b" qzxjkvwyqpfhbgtmdncrls" * 40

    class Asked(dict):
        def get(self, part, default=None):
            asked.append(part)
            return known.get(part, default)

        __getitem__ = get

    model.id_of = Asked(known)
    found = model._propose(word)
    assert b"".join(model.token[t] for t in found) == word
    lengths = {}
    for t in known:
        lengths.setdefault(t[:4], set()).add(len(t))
    assert all(len(p) < 4 or len(p) in lengths.get(p[:4], ()) or word.endswith(p) for p in asked)


def test_bpe_words_met_again_outlast_a_turn(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    model, proposed = bpe.Bpe(str(public_tokenizers.path("byte_bpe_50k.json"))), []
    whole = model._propose
    monkeypatch.setattr(model, "_propose", lambda word: proposed.append(word) or whole(word))
    for n in range(12):
        ids = model.encode_batch([f"often x{n}q"])
        assert model.decode(ids[0]) == f"often x{n}q"
    assert proposed.count(b"often") == 1 and len(model.known) <= 6 and len(model.before) <= 6
