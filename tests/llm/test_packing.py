import random
from collections import Counter

import pytest

import public_tokenizers

from netledger.llm.packing import pack, plan_containers, token_pieces, tokenizer, vocabulary_path


def check(rows, capacity):
    """No container overflows, slots are side by side, positions count up."""
    boxes = {}
    for r in rows:
        if r.n_tokens:
            boxes.setdefault(r.container, []).append((r.position, r.token_offset, r.n_tokens))
        else:
            assert r.container is None
    assert sorted(boxes) == list(range(len(boxes)))
    for slots in boxes.values():
        at = 0
        for k, (position, offset, n) in enumerate(sorted(slots)):
            assert (position, offset) == (k, at)
            at += n
        assert at <= capacity
    return len(boxes)


def best_fit(lengths, capacity):
    """Containers that best fit, longest first, needs one text at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_as_good_as_best_fit_on_single_texts(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 200])
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, max(2, capacity // 5)) for _ in range(rng.randrange(1, 500))]
    plan, made = plan_containers(Counter(lengths), capacity)
    assert made == best_fit(lengths, capacity)
    assert len(plan["length"]) <= 3 * capacity * int((2 * capacity) ** 0.5 + 1)


def test_plan_of_huge_counts_stays_small():
    plan, made = plan_containers({n: 10**9 + n for n in range(1, 2049)}, 2048)
    tokens = sum(n * (10**9 + n) for n in range(1, 2049))
    assert made >= tokens / 2048 and made * 2048 < tokens * 1.001 and len(plan["length"]) < 20_000


def test_pack_on_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["route", "origin", "ü", "経路", "x"]) for _ in range(rng.choice([1, 5, 5, 5, 30, 400]))) for _ in range(150)]
    texts += ["", None, "same", "same", "z" * 3000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "container long, body string, piece int")
    capacity = 64
    pieces = token_pieces(df, "container", "body", capacity=capacity)
    rows = pack(pieces, capacity=capacity).collect()
    made = check(rows, capacity)
    assert made == best_fit([r.n_tokens for r in rows if r.n_tokens], capacity)
    enc = tokenizer(vocabulary_path(), public_tokenizers.PATTERN)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t is not None}
    for i, rs in by.items():
        rs.sort(key=lambda r: r.piece)
        raw = texts[i].encode()
        assert b"".join(raw[r.byte_from : r.byte_to] for r in rs) == raw
        assert sum(r.n_tokens for r in rs) == len(enc.encode_ordinary(texts[i]))
        assert len(rs) == max(1, -(-sum(r.n_tokens for r in rs) // capacity))


def test_many_cells_give_the_same_containers(spark, monkeypatch):
    from netledger.llm import packing

    rows = [(i, 0, n, 0, 0) for i, n in enumerate([3] * 50 + [7] * 20 + [0] * 2)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, piece int, n_tokens int, byte_from long, byte_to long")
    monkeypatch.setattr(packing, "CELL_ROWS", 4)
    assert check(pack(df, capacity=10).collect(), 10) == best_fit([r[2] for r in rows + rows[:5] if r[2]], 10)
    assert pack(df.limit(0), capacity=10).collect() == []
    with pytest.raises(ValueError):
        pack(df, capacity=5)
