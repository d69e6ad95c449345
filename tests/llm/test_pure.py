"""The operators' numpy parts against brute force, without Spark."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewrack.llm import _text as X
from tidewrack.llm import fingerprints, packing, sampling, simhash, suffix_dedup, toxicity
from tidewrack.llm.queries import MODEL


def buffers(texts):
    return X.buffers(pa.array(texts, pa.string()))


def slow_chunks(data: bytes) -> list[int]:
    ends, begin, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(fingerprints._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - begin
        bits = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
        if i + 1 == len(data) or size >= fingerprints.MOST or (size >= fingerprints.LEAST and h < 1 << (32 - bits)):
            ends.append(i + 1)
            begin = i + 1
    return ends


def words(n, seed, size=400):
    draw = np.random.default_rng(seed)
    return " ".join("w%d" % k for k in draw.integers(0, size, n))


def test_chunks_are_those_of_a_rolling_hash():
    texts = [words(600, 1), "", None, "é" * 700, words(3, 2), words(4000, 3)]
    data, offsets = buffers(texts)
    ends, rows = fingerprints.chunks(data, offsets)
    for r, t in enumerate(texts):
        assert (ends[rows == r] - offsets[r]).tolist() == slow_chunks((t or "").encode())


def test_an_insertion_moves_few_chunks():
    text = words(3000, 4)
    digests = []
    for t in (text, text[:5000] + "INSERTED" + text[5000:]):
        data, offsets = buffers([t])
        ends, _ = fingerprints.chunks(data, offsets)
        begin = np.concatenate([[0], ends[:-1]])
        digests.append(set(X.span_hashes(data, begin, ends, X.PLAIN).tolist()))
    assert len(digests[0] & digests[1]) >= 0.9 * len(digests[0])


def groups(n, pairs):
    """The least member of each point's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    return [find(x) for x in range(n)]


def near(prints, most):
    """All pairs within ``most`` bits, by brute force."""
    left, right = [], []
    for i in range(len(prints) - 1):
        j = i + 1 + np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(1) <= most)
        left += [i] * len(j)
        right += j.tolist()
    return list(zip(left, right))


def joined(prints, most, r):
    """Edges of all grids."""
    masks, chosen = simhash.blocks(most, r)
    out = []
    for half in (0, 1):
        for t, c in enumerate(chosen):
            value = prints[:, half] & np.uint64(sum(int(masks[b]) for b in c))
            order = np.argsort(value, kind="stable")
            cell = np.unique(value[order], return_inverse=True)[1] + ((half * len(chosen) + t) << simhash._SHIFT)
            a, b = simhash.link(cell, prints[order], most, r)
            out += zip(order[a].tolist(), order[b].tolist())
    return out


def some_prints(n, centres, seed, flips=40):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, (centres, 2), dtype=np.uint64)
    out = base[draw.integers(0, centres, n)]
    for i in range(n):
        for b in draw.choice(128, draw.integers(0, flips), replace=False):
            out[i, b // 64] ^= np.uint64(1 << int(b % 64))
    return np.unique(out, axis=0)


def test_manhattan_never_exceeds_hamming():
    prints = some_prints(200, 40, 0)
    a, b = np.repeat(np.arange(len(prints)), len(prints)), np.tile(np.arange(len(prints)), len(prints))
    exact = np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= 20
    assert (simhash._near(prints[a], prints[b], 20) == exact).all()


@pytest.mark.parametrize("most, r, n, centres, flips", [(20, 2, 400, 60, 30), (20, 3, 300, 40, 30), (20, 1, 700, 9, 24), (7, 2, 400, 30, 12), (2, 1, 200, 20, 5), (20, 2, 600, 2, 22)])
def test_range_join_loses_no_link(most, r, n, centres, flips):
    prints = some_prints(n, centres, most + r, flips)
    pairs, edges = near(prints, most), joined(prints, most, r)
    assert pairs and set(map(tuple, map(sorted, edges))) <= set(pairs)
    assert groups(len(prints), edges) == groups(len(prints), pairs)


@pytest.mark.parametrize("matches", [1, 60, 1 << 20])
def test_best_holders_of_a_block_are_those_of_brute_force(monkeypatch, matches):
    monkeypatch.setattr(fingerprints, "MATCHES", matches)
    draw = np.random.default_rng(matches)
    for n_docs, n_digests in ((60, 6), (60, 30), (1, 1), (0, 1)):
        docs = draw.integers(-(1 << 62), 1 << 62, 90).tolist()
        digests = (draw.integers(-(1 << 54), 1 << 54, n_digests) * 256 + draw.integers(16, 40, n_digests)).tolist()
        held = {d: {digests[k] for k in draw.integers(0, n_digests, 3)} for d in docs[:n_docs]}
        asks = {d: [digests[k] for k in draw.integers(0, n_digests, 4)] for d in docs[40:80]} | {docs[85]: [digests[0] + (1 << 20)]}
        pairs = [(docs[a], docs[b], int(n)) for a, b, n in zip(draw.integers(30, 80, 80), draw.integers(0, 90, 80), draw.integers(16, 40, 80)) if a != b]
        rows = [(d, c, 0) for d, s in held.items() for c in [*s, *s]] + [(d, c, -1) for d, s in asks.items() for c in s] + pairs
        one, two, size = zip(*(rows[k] for k in draw.permutation(len(rows))))
        best = {}
        for k1, holder, n in zip(*fingerprints._block_best(pa.table({"one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "size": pa.array(size, pa.int64())})).to_pydict().values()):
            best[k1] = min(best.get(k1, (1, 0)), (-n, holder))
        want = {}
        for q in docs:
            by = {d: sum(c & 255 for c in asks.get(q, []) if c in held.get(d, ())) + sum(n for a, b, n in pairs if (a, b) == (q, d)) for d in docs if d != q}
            if any(by.values()):
                want[q] = min((-n, d) for d, n in by.items() if n)
        assert best == want


def test_range_join_of_real_fingerprints_is_exact():
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])
    data, offsets = X.buffers(table["text"])
    prints = np.unique(np.concatenate([simhash.simhash(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1] for a, b in X.pieces(offsets)]), axis=0)
    pairs = near(prints, simhash.DISTANCE)
    assert len(pairs) > 500 and groups(len(prints), joined(prints, simhash.DISTANCE, 2)) == groups(len(prints), pairs)


def test_range_join_compares_few_of_millions():
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])
    data, offsets = X.buffers(table["text"])
    prints = np.unique(np.concatenate([simhash.simhash(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1] for a, b in X.pieces(offsets)]), axis=0)
    masks, chosen = simhash.blocks(simhash.DISTANCE, simhash.grids(3_000_000))
    met = 0
    for half in (0, 1):
        for c in chosen:
            many = np.unique(prints[:, half] & np.uint64(sum(int(masks[b]) for b in c)), return_counts=True)[1]
            met += int((many * (many - 1) // 2).sum())
    # of all pairs, those that share a cell, as often as they do, and the rows that this takes
    assert met < 0.13 * len(prints) * (len(prints) - 1) / 2 and 2 * len(chosen) < 240


@pytest.mark.parametrize("most, r", [(20, 1), (20, 2), (20, 3), (20, 4), (21, 4), (7, 1), (2, 2), (1, 1)])
def test_pairs_meet_in_the_first_grid_that_is_theirs(most, r):
    draw = np.random.default_rng(most * 8 + r)
    apart = np.zeros((4000, 2), np.uint64)
    for i in range(len(apart)):
        for b in draw.choice(128, draw.integers(1, most + 1), replace=False):
            apart[i, b // 64] ^= np.uint64(1 << int(b % 64))
    masks, chosen = simhash.blocks(most, r)
    grid = simhash._first_grid(apart[:, 0], apart[:, 1], most, r)
    assert (grid >= 0).all()
    for k, (x, y) in zip(grid.tolist(), apart.tolist()):
        assert (x, y)[k // len(chosen)] & sum(int(masks[b]) for b in chosen[k % len(chosen)]) == 0
        assert k < len(chosen) or 0 not in chosen[k % len(chosen)] or not simhash._spare(most, 1)


def test_fingerprints_know_order_and_all_words():
    draw = np.random.default_rng(4)
    text = words(300, 8, 3000).split()
    short = [chr(97 + k) * 2 for k in draw.integers(0, 26, 1600)]
    edited = list(text)
    for k in range(0, 300, 30):
        edited[k] = "changed"
    data, offsets = buffers([" ".join(x) for x in (text, draw.permutation(text), text + short, edited)])
    rows, prints = simhash.simhash(data, offsets)
    apart = np.bitwise_count(prints ^ prints[0]).sum(1)
    assert rows.tolist() == [0, 1, 2, 3] and apart[1] > simhash.DISTANCE and apart[2] > simhash.DISTANCE and apart[3] <= simhash.DISTANCE


@pytest.mark.parametrize("seed", range(5))
def test_longest_previous_factors(seed):
    text = np.random.default_rng(seed).integers(0, 3, 120)
    got = suffix_dedup.longest_previous_factors(text, 8)
    s = text.tolist()
    for i in range(len(s)):
        best = 0
        for j in range(i):
            k = 0
            while i + k < len(s) and s[j + k] == s[i + k]:
                k += 1
            best = max(best, k)
        assert got[i] == best or (best >= 8 and got[i] >= 8)


@pytest.mark.parametrize("seed", range(5))
def test_maximal_segments(seed):
    draw = np.random.default_rng(seed)
    at = np.flatnonzero(draw.random(200) < 0.3)
    gain = draw.random(len(at)) * 2
    score = np.full(200, -0.5)
    score[at] = gain

    def whole(lo, hi):
        best, where = 0.0, None
        for i in range(lo, hi):
            total = np.cumsum(score[i:hi])
            k = int(total.argmax())
            if total[k] > best + 1e-12:
                best, where = total[k], (i, i + k)
        return [] if where is None else whole(lo, where[0]) + [(*where, best)] + whole(where[1] + 1, hi)

    got = toxicity.maximal_segments(at, gain, 0.5)
    want = whole(0, 200)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_best_fit_and_crossover_keep_every_piece():
    draw = np.random.default_rng(3)
    sizes = draw.integers(1, 100, 300)
    people = packing.found(sizes, 100, 4, draw)
    child = packing.crossover(people[0], people[1], sizes, 100, draw)
    for p in (*people, child, *packing.evolve(people, sizes, 100, 6, draw)):
        assert len(p) == 300 and p.min() >= 0
        assert np.bincount(p, sizes).max() <= 100
    assert packing.fitness(packing.evolve(people, sizes, 100, 10, draw)[0], sizes, 100) >= packing.fitness(people[0], sizes, 100)


@pytest.mark.parametrize("seed", range(3))
def test_evolution_packs_better_than_best_fit(seed):
    draw = np.random.default_rng(seed)
    sizes = []
    for _ in range(60):  # three pieces fill a bin, which best fit doesn't see
        a = int(draw.integers(380, 490))
        b = int(draw.integers(250, (1000 - a) // 2 + 1))
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    people = packing.found(sizes, 1000, packing.POPULATION, draw)
    best = packing.evolve(list(people), sizes, 1000, packing.GENERATIONS, draw)[0]
    assert np.bincount(best, sizes).max() <= 1000 and len(np.unique(best)) < len(np.unique(people[0]))


def test_sampled_pieces_follow_the_lattice():
    vocab = sampling.vocabulary(MODEL, 1.0)
    unit = b" there"
    ways = {}

    def grow(at, pieces, weight):
        if at == len(unit):
            ways[tuple(pieces)] = weight
        for end in range(at + 1, len(unit) + 1):
            if (i := vocab.pieces.get(unit[at:end])) is not None:
                grow(end, [*pieces, i], weight * math.exp(vocab.weight[i]))

    grow(0, [], 1.0)
    n = 20_000
    data, offsets = buffers([unit.decode()] * n)
    ids, first = sampling.encode_rows(data, offsets, X.mix(np.arange(n, dtype=np.uint64)), sampling.Lattices(vocab))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:]))
    total = sum(ways.values())
    assert set(seen) <= set(ways)
    for way, weight in ways.items():
        p = weight / total
        assert abs(seen[way] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_units_cut_no_piece():
    vocab = sampling.vocabulary(MODEL, 1.0)
    assert any(p.startswith(b"  ") for p in vocab.pieces)
    # whole texts as one unit give the same lattice: the chance of a segmentation is the product over units
    text = "int   x = f(a, b);\n\n    return  don't 12 ünï"
    data, _ = buffers([text])
    cut = np.append(0, np.flatnonzero(~vocab.inner[data[:-1], data[1:]]) + 1)
    raw = data.tobytes()
    for begin in range(len(raw)):
        for end in range(begin + 1, min(len(raw), begin + vocab.longest) + 1):
            if raw[begin:end] in vocab.pieces:
                assert not ((cut > begin) & (cut < end)).any()
