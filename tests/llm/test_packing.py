import random
from collections import Counter, defaultdict

import pytest

from fareline.llm.packing import SumOfSquares, pack, token_counts, tokenizer, VOCABULARY


def brute_place(gaps, capacity, size):
    """All choices tried: gaps is the multiset of the residual gaps of open bins."""
    def total(counts):
        return sum(n * n for g, n in counts.items() if g)

    best = None
    for g in [None, *sorted(g for g in gaps if gaps[g])]:
        if g is not None and g < size:
            continue
        after = Counter(gaps)
        if g is not None:
            after[g] -= 1
        after[(capacity if g is None else g) - size] += 1
        key = (total(after), 1 if g is None else 0, (capacity if g is None else g) - size)
        best = min(best or (key, after), (key, after), key=lambda x: x[0])
    return best[1], best[0][0]


def test_places_by_the_sum_of_squares():
    rng = random.Random(1)
    packer, fill = SumOfSquares(20), defaultdict(int)
    for _ in range(400):
        size = rng.randint(1, 20)
        before = Counter(20 - x for x in fill.values() if x < 20)
        _, best = brute_place(before, 20, size)
        fill[packer.place(size)] += size
        after = Counter(20 - x for x in fill.values() if x < 20)
        assert sum(n * n for n in after.values()) == best
    assert max(fill.values()) <= 20


@pytest.mark.parametrize("per_shard", [100_000, 50])
def test_every_item_is_placed_whole(spark, per_shard):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, None, 1, 7, 64, 65, 200, rng.randint(1, 64)])) for i in range(300)] + [(1, 5), (1, 5)]
    out = pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), 64, len(sizes), per_shard=per_shard).collect()
    pieces = defaultdict(list)
    fill = Counter()
    for r in out:
        pieces[r.doc_id].append((r.token_start, r.n_tokens))
        fill[r.sequence_id] += r.n_tokens
        assert (r.sequence_id is None) == (r.n_tokens == 0)
    assert max(n for s, n in fill.items() if s) <= 64
    for i, n in sizes[:-2]:
        if i == 1:
            continue
        got = sorted(pieces[i])
        assert sum(x for _, x in got) == (n or 0)
        assert len(got) == max(1, -(-(n or 0) // 64))
        assert [s for s, _ in got] == [64 * k for k in range(len(got))]
    total = sum(fill[s] for s in fill if s)
    assert total / (64 * sum(1 for s in fill if s)) > 0.9


def test_counts_tokens_of_whole_texts(spark):
    texts = ["a stop", "", None, "Halt " * 20_000, "<|endoftext|> \n\n  x"]
    found = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    encode = tokenizer(VOCABULARY).encode_ordinary
    assert found == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert pack(token_counts(spark.createDataFrame([], "doc_id long, text string")), 64, 0).count() == 0


def test_split_pattern_is_the_published_one():
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("It's 10:15  at Île  Gate \n\n x ", "   ", "\tÀ la  carte'll", "Рейс в 20:45\r\n"):
        assert plain.encode_ordinary(text) == tokenizer(VOCABULARY).encode_ordinary(text)
