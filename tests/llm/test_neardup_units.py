import random

import numpy as np
import pytest

from parley.llm import neardup as N


def edited(a, share, rng):
    out = list(a)
    for _ in range(int(share * len(a))):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < .6:
            out[i] = rng.randrange(2**32)
        elif kind < .8:
            out.insert(i, rng.randrange(2**32))
        elif len(out) > 1:
            out.pop(i)
    return out


def unit(rng, n, long):
    """Texts as word hashes: a family that drifts, pairs, texts around a shared passage."""
    passage = [rng.randrange(2**32) for _ in range(60)]
    base = [rng.randrange(2**32) for _ in range(100 * long)]
    texts = []
    for i in range(n):
        if i % 3 == 0:
            texts.append(edited(base, rng.choice([.02, .1, .19]), rng))
        elif i % 3 == 1:
            texts.append([rng.randrange(2**32) for _ in range(rng.randrange(10, 40))] + passage)
        else:
            texts.append(edited(rng.choice(texts), rng.choice([.0, .1, .2]), rng))
    return [np.array(t, np.uint32) for t in texts]


@pytest.mark.parametrize("seed, long, crossed", [(1, 1, False), (2, 1, True), (3, 30, False), (4, 30, True)])
def test_no_similar_pair_is_left_out(seed, long, crossed):
    rng = random.Random(seed)
    texts = unit(rng, 60, long)
    n = len(texts)
    label = np.array([0 if i % 6 == 0 else i for i in range(n)])
    block = np.array([rng.randrange(2) for _ in range(n)])
    keys = [sorted({5, *rng.sample(range(10), rng.randrange(3))}) for _ in range(n)]
    bags = [(np.sort(t) if len(t) > N.COARSE else np.sort(t >> 16).astype(np.uint16)).tobytes() for t in texts]
    got = N.unit_pairs(5, crossed, block, np.arange(n), label, np.array([len(t) for t in texts]), keys, bags, 0.8)
    assert len(set(got)) == len(got)
    found = 0
    for a in range(n):
        for b in range(a + 1, n):
            ours = label[a] != label[b] and min(set(keys[a]) & set(keys[b])) == 5 and (not crossed or block[a] != block[b])
            if not ours:
                assert (a, b) not in got
            elif N.similar(texts[a], texts[b], 0.8):
                assert (a, b) in got
                found += 1
    assert found > 20 and len(got) < 4 * found           # and hardly any other pair


def test_a_common_passage_makes_no_pairs():
    """Pairs to verify follow the similar texts, not the square of those that share a passage."""
    rng = random.Random(8)
    passage = [rng.randrange(2**32) for _ in range(200)]
    for n in (60, 120, 240):
        texts = [np.array([rng.randrange(2**32) for _ in range(80)] + passage, np.uint32) for _ in range(n)]
        texts += [np.array(edited(texts[0].tolist(), .1, rng), np.uint32)]
        bags = [np.sort(t >> 16).astype(np.uint16).tobytes() for t in texts]
        m = len(texts)
        got = N.unit_pairs(1, False, np.zeros(m, int), np.arange(m), np.arange(m), np.array([len(t) for t in texts]),
                           [[1]] * m, bags, 0.8)
        assert (0, n) in got and len(got) <= 2


def test_signatures_leave_no_similar_text_out():
    rng = random.Random(11)
    for long in (1, 30, 120):                               # the last: classes that are full
        texts = unit(rng, 40, long)
        label = np.arange(40)
        h = np.concatenate([t.astype(np.uint64) << np.uint64(32) for t in texts])
        signs = N.signatures(h, np.array([len(t) for t in texts]))
        length = np.array([len(t) for t in texts])
        for crossed in (False, True):
            block = np.array([rng.randrange(2) for _ in range(40)])
            has = N.with_partner(crossed, block, label, length, signs, 0.8)
            for a in range(40):
                if not has[a]:
                    assert not any(N.similar(texts[a], texts[b], 0.8) for b in range(40)
                                   if b != a and (not crossed or block[a] != block[b]))
            if long == 1 and not crossed:
                alone = [i for i in range(40) if i % 3 == 1]
                assert sum(has[i] for i in alone) < len(alone)
