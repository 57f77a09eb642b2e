"""Texts on which a plain way would take the square of their length."""

import base64
import time
import tracemalloc

import numpy as np
import public_tokenizers
import regex
import tiktoken

from ectolog.llm import bpe, registry


def test_long_words_before_a_tab():
    with open(registry.MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    find = regex.compile(public_tokenizers.PATTERN).findall
    v = bpe.Vocabulary(registry.MULTI)
    texts = ["x" * 300_000 + "\t", "é日" * 40_000 + "\x85 a", "ab c\t\td\x0be " * 30_000, "the quick brown\tfox"]
    began = time.time()
    found = [np.frombuffer(ids, "<u4").tolist() for ids in bpe.encode_texts(v, find, texts)]
    assert time.time() - began < 60
    assert found == [plain.encode_ordinary(t) for t in texts]
    for text in ("x" * 5000, "abababa" * 700, "internationalization", "a"):
        assert bpe.encode_one(v, text.encode()).tolist() == plain.encode_ordinary(text)


def test_memory_of_a_replay_is_a_small_multiple_of_its_words():
    v = bpe.Vocabulary(registry.MULTI)
    words = [f" {i:x}".encode() for i in range(150_000)]
    replay = bpe.Replay(v, words)
    size = replay.n
    tracemalloc.start()
    replay.run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * size
