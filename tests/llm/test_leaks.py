"""What a stretch shares with an item, counted many at a time, against one at a time."""

import random
from collections import Counter

import numpy as np
import pytest

from repograph.llm import decontam as D


@pytest.mark.parametrize("cells", [D.TABLE_CELLS, 0])
def test_shared_words_of_stretches(monkeypatch, cells):
    monkeypatch.setattr(D, "TABLE_CELLS", cells)
    rng = random.Random(1)
    items = [[rng.randrange(12) for _ in range(rng.randint(1, 20))] for _ in range(9)]
    terms = [rng.randrange(-1, 12) for _ in range(600)]
    cases = [(a, min(a + rng.randint(1, 60), 600), rng.randrange(9), rng.choice((1, 3.5, 6, 9))) for a in range(600)]
    begin, stop, item, least = (np.array(c) for c in zip(*cases))
    got = D._Bags(items, 12).share(np.array(terms, np.int32), begin, stop, item, least)
    assert got.tolist() == [k for k, (a, b, i, n) in enumerate(cases) if (Counter(terms[a:b]) & Counter(items[i])).total() >= n]


def test_cover_with_places_made_once():
    rng = random.Random(2)
    for _ in range(200):
        want, near = ([rng.randrange(30) for _ in range(rng.randint(1, 40))] for _ in range(2))
        near += [rng.randrange(-1, 30) for _ in range(60)]
        assert D._cover(want, near, D._places(want)) == D._cover(want, near)
        assert D._lcs(D._places(want), len(want), near) == D.lcs(want, near)


def test_words_of_blocks_drop_no_stretch_that_holds_half_an_item():
    rng = random.Random(3)
    items = [[rng.randrange(40) for _ in range(n)] for n in (1, 4, 9, 16, 25, 37, 60)]
    bags, lengths = D._Bags(items, 40), np.array([len(i) for i in items])
    kept = held = 0
    for _ in range(30):
        texts = [[rng.randrange(-1, 40) for _ in range(rng.randint(0, 150))] + (rng.choice(items) if rng.random() < 0.7 else []) + [-1] * rng.randint(0, 40) for _ in range(3)]
        terms, sizes = np.array([t for text in texts for t in text], np.int32), np.array([len(t) for t in texts])
        block, term, block_doc, start = D._blocks(terms, sizes, np.ones(40, bool))
        inside = bags.in_blocks(block, term, len(block_doc))
        assert inside.sum() == sum(t in i for i in items for t in terms.tolist())
        begin = np.cumsum(sizes) - sizes
        cases = [(b, i) for b in range(len(block_doc)) for i in range(len(items))]
        where, which = (np.array(c) for c in zip(*cases))
        doc = block_doc[where]
        a = np.maximum(begin[doc], start[where] - lengths[which])
        z = np.minimum((begin + sizes)[doc], start[where] + 2 * D.BLOCK + lengths[which])
        head = np.searchsorted(block_doc, doc)
        width = -(-(D._span(lengths) + D.BLOCK - 1) // D.BLOCK)
        some = set(D._may_hold(inside, head + (a - begin[doc]) // D.BLOCK, head - (begin[doc] - z) // D.BLOCK, which, width, 0.5 * lengths).tolist())
        covered = {k for k, (f, t, i) in enumerate(zip(a, z, which)) if D._cover(items[i], terms[f:t].tolist()) >= 0.5}
        assert covered <= some
        kept, held = kept + len(some), held + len(covered)
    assert 0 < held <= kept


def test_passages_that_may_share_words():
    rng = np.random.Generator(np.random.PCG64(4))
    inside = rng.integers(0, 17, (40, 5), np.uint8)
    block_doc = np.sort(rng.integers(0, 9, 40))
    _, first = D._passages(inside.astype(np.float32), block_doc)
    least = np.array([14.0, 21.5], np.float32)
    sums, _ = D._passages(inside.astype(np.float32), block_doc)
    assert D._may_share(inside, block_doc, first, [1, 3], least).tolist() == np.flatnonzero((sums[:, [1, 3]] >= least).any(1)).tolist()
    assert D._may_share(None, block_doc, first, [1, 3], least).tolist() == list(range(len(first)))
