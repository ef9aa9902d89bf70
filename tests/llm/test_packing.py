import random
import struct
import zlib

import numpy as np
import pytest

from corpusframe.llm import packing

from .conftest import ODD, prose


def check(rows, capacity):
    """Pieces cover their documents; sequences are gapless and don't overflow."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by)


def test_bins_are_few():
    r = np.random.default_rng(1)
    for sizes in (r.integers(1, 2048, 3000), r.integers(600, 1100, 500), np.full(10, 2047), np.array([1]), np.zeros(0, int)):
        where = packing.sum_of_squares(sizes, 2048)
        fill = np.bincount(where, weights=sizes) if len(sizes) else np.zeros(0)
        assert len(where) == len(sizes) and (fill <= 2048).all()
    sizes = r.integers(1, 1200, 4000)
    bins = len(np.unique(packing.sum_of_squares(sizes, 2048)))
    assert bins <= 1.001 * -(-sizes.sum() // 2048)
    sizes = r.integers(1, 2049, 8192)
    assert len(np.unique(packing.sum_of_squares(sizes, 2048))) <= 1.01 * max(-(-sizes.sum() // 2048), (sizes > 1024).sum())


def slow_sum_of_squares(sizes, capacity):
    """Each size's bin by trying every open bin and adding up all squares anew."""
    left, where = [], [0] * len(sizes)
    born = []  # when each bin got its gap
    for turn, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        best = None
        for b, gap in enumerate(left):
            if 0 < gap and gap >= sizes[i]:
                after = left[:b] + [gap - sizes[i]] + left[b + 1 :]
                cost = sum(after.count(g) ** 2 for g in set(after) - {0})
                if best is None or (cost, gap, -born[b]) < best[0]:
                    best = (cost, gap, -born[b]), b
        if best is None:
            where[i] = len(left)
            left.append(capacity - sizes[i])
            born.append(turn)
        else:
            where[i] = best[1]
            left[best[1]] -= sizes[i]
            born[best[1]] = turn
    return where


def test_rule_placement_by_placement():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.choice([5, 12, 40])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 40))]
        assert list(packing.sum_of_squares(np.array(sizes), capacity)) == slow_sum_of_squares(sizes, capacity)


def test_query(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd_docs, *packing.gpt_parts(), capacity=64, group=20).collect()
    check(rows, 64)
    for d in range(len(ODD)):
        ids = [*library.encode(ODD[d] or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        mine = mine[:1] if d == 4 else mine  # the row that stands twice
        assert [r["start"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine]])[:-1])
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 64 for r in mine[1:])
        assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])) for r in mine)
    assert sum(r["doc_id"] == 4 for r in rows) == 2
    assert packing.pack_documents(no_docs, *packing.gpt_parts()).count() == 0


@pytest.mark.parametrize("group", [30, 4096])
def test_sequences_stay_near_the_bound(spark, group):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, prose(r, r.randint(1, 300))) for i in range(300)], "doc_id long, text string")
    rows = packing.pack_documents(docs, *packing.gpt_parts(), capacity=512, group=group).collect()
    bound = -(-sum(x["length"] for x in rows) // 512)
    assert bound <= check(rows, 512) <= (1.12 if group < 100 else 1.03) * bound + 1
