from __future__ import annotations

import math

import public_tokenizers
from tokenizers import Tokenizer, models

from starcart.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library_model():
    """The same unigram model in the tokenizers library."""
    scores = token_counts.load_scores(PATH)
    bytes_ = [(f"<0x{b:02X}>", -math.log(len(scores) + 2)) for b in range(256)]
    return Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items(), *bytes_], 0, byte_fallback=True))


def test_counts_against_the_library(edges, edge_rows):
    model, cache = library_model(), {}
    for text in (t or "" for _, t in edge_rows):
        for w in text.encode().split():
            cache.setdefault(w, len(model.encode(token_counts.MARK + w.decode()).ids))
    got = token_counts.count_tokens(edges, PATH).select("doc_id", "text", "n_words", "n_tokens").collect()
    assert len(got) == len(edge_rows)
    for r in got:
        words = (r["text"] or "").encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(cache[w] for w in words))


def test_best_segmentation_by_trying_all():
    scores = {"a": -1.0, "b": -1.1, "ab": -1.5, "ba": -2.4, "aba": -2.6, "c": -3.0}
    trie = token_counts.PrefixTrie(scores)

    def best(word):
        if not word:
            return 0.0, 0
        tries = [(best(word[:-k])[0] + scores[word[-k:]], best(word[:-k])[1] + 1) for k in range(1, len(word) + 1) if word[-k:] in scores]
        return max(tries)

    for word in ("a", "ab", "aba", "abab", "babab", "ababc", "cab"):
        assert trie.insert(word) == best(word)[1], word


def test_shared_prefixes_are_scored_once():
    trie = token_counts.PrefixTrie({c: -1.0 for c in "abcdefgh"})
    trie.insert("abcdef")
    nodes = len(trie.best)
    trie.insert("abcdeh")
    assert len(trie.best) == nodes + 1


def test_bounded_memory_changes_nothing():
    scores = {c: -1.0 - i / 10 for i, c in enumerate("abcd")} | {"ab": -1.2, "cd": -1.4}
    small, large = token_counts.PrefixTrie(scores, nodes=5, words=4), token_counts.PrefixTrie(scores)
    texts = ["ab cd abcd dcba", "aabb ccdd", "abab abab cdcd x é", ""]
    assert [small.count(t) for t in texts * 3] == [large.count(t) for t in texts * 3]


def test_empty(table):
    assert token_counts.count_tokens(table([]), PATH).collect() == []
