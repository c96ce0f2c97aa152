"""Findings of the third round."""

import random

import public_tokenizers
import tiktoken

from lodestrata.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_merges_little_of_words_it_has_not_seen():
    """A transition looks up which tokens stay apart instead of merging what has been read, once for each boundary in it."""
    ranks, rng = bpe.read_ranks(VOCABULARY), random.Random(4)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merged, calls = encoder.transducer.merged, []
    encoder.transducer.merged = lambda data: calls.append(data) or merged(data)
    pieces = "th he in er an re nd on at en or es st ed ti tion ing ble wh of ea ou sh ly nt to".split()
    texts = [" ".join("".join(rng.choice(pieces) for _ in range(rng.randrange(2, 6))) for _ in range(100)) for _ in range(100)]
    for text in texts:
        assert list(memoryview(encoder.encode(text)).cast("I")) == known.encode_ordinary(text)
    assert len(calls) < 20_000  # 9,320; 44,574 when each boundary's encoding was merged anew


def test_bpe_of_made_up_merges(monkeypatch):
    """Any order of merges, long matches cut into blocks, and caches that overflow."""
    monkeypatch.setattr(bpe, "STEPS_HELD", 20)
    monkeypatch.setattr(bpe, "TRIMMED", 7)
    rng = random.Random(5)
    for _ in range(150):
        letters = [bytes((b,)) for b in b"abc"[: rng.randrange(1, 4)]]
        tokens = list(letters)
        for _ in range(rng.randrange(40)):
            token = rng.choice(tokens) + rng.choice(tokens)
            if token not in tokens and len(token) < 12 and by_merges(token, {t: k for k, t in enumerate([*tokens, token])}) == [token]:
                tokens.append(token)
        ranks = {t: k for k, t in enumerate(tokens)}
        machine = bpe.Transducer(ranks)
        for _ in range(60):
            data = b"".join(rng.choices(letters, k=rng.randrange(1, 60)))
            assert list(memoryview(machine.run(data)).cast("I")) == [ranks[t] for t in by_merges(data, ranks)]
            machine.trim()


def by_merges(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [data[k : k + 1] for k in range(len(data))]
    while True:
        found = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
