"""Vector links, the manifest and whitening against brute force, on small tables and on odd rows."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from conftest_rows import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from legwise.llm import manifest, vector_links, whitening
from legwise.llm.queries import QUERIES
from legwise.llm.text import id_remainder


# ---------------------------------------------------------------- vector links
def slow_links(items, cosine=0.93):
    """(id, label, vector) -> (id, links, component, kept), by comparing all pairs."""
    def fine(label, v):
        return label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    n, links, root = len(items), [0] * len(items), list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, p, a), (_, q, b) = items[i], items[j]
            if fine(p, a) and fine(q, b) and p == q and len(a) == len(b):
                big = [max(map(abs, v)) for v in (a, b)]
                x, y = np.array(a, float) / big[0], np.array(b, float) / big[1]
                if (x * y).sum() / math.sqrt((x * x).sum()) / math.sqrt((y * y).sum()) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, item in enumerate(items):
        if item[0] is not None:
            least[find(i)] = min(item[0], least.get(find(i), item[0]))
    return [(item[0], links[i], least.get(find(i)), least.get(find(i)) == item[0]) for i, item in enumerate(items)]


def vector_rows(seed=5, size=12):
    """Balls of near copies, copies, scaled copies and lone vectors under three labels."""
    rng, out = np.random.default_rng(seed), []
    for label in (0, 1, 2):
        for ball in range(6):
            middle = rng.standard_normal(size)
            for _ in range((40, 3, 1, 2, 9, 1)[ball]):
                v = (middle + rng.standard_normal(size) * 0.28).astype(np.float32)
                out.append((label, v.tolist()))
        out += [(label, [c * 3 for c in out[-1][1]]), out[-2], out[-2]]
    return [(i * 7 % len(out), *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("shard_rows,width", [(16_384, 16), (12, 4), (5, 3)])
def test_vector_links(spark, shard_rows, width):
    data = vector_rows()
    table = rows(spark, data, "vec_id bigint, label int, embedding array<float>")
    got = [tuple(r) for r in vector_links.link(table, width=width, shard_rows=shard_rows).collect()]
    assert sorted(got) == sorted(slow_links(data))
    assert sum(r[1] for r in got) > 1000


def test_vector_links_of_hot_ball_are_dealt_to_parts(spark):
    rng = np.random.default_rng(9)
    ball = (np.ones(8) + rng.standard_normal((60, 8)) * 0.1).astype(np.float32)
    far = rng.standard_normal((60, 8)).astype(np.float32)
    data = [(i, "x", v.tolist()) for i, v in enumerate(np.vstack([ball, far]))]
    table = rows(spark, data, "vec_id bigint, label string, embedding array<float>")
    got = [tuple(r) for r in vector_links.link(table, width=4, shard_rows=10).collect()]
    assert sorted(got) == sorted(slow_links(data))


def test_vector_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, None), (4, 0, []), (5, 0, [0.0, 0.0]),
            (6, 0, [nan, 1.0]), (7, 0, [inf, 1.0]), (8, 0, [None, 1.0]), (9, None, [1.0, 0.0]), (None, 0, [2.0, 0.1]),
            (10, 0, [1.0, 0.0, 0.0]), (11, 0, [1e200, 1e199]), (12, 0, [1e-300, 0.0]), (13, 1, [1.0, 0.0]), (None, 1, [-1.0, 0.0]),
            (None, 2, [1.0, 1.0]), (None, 2, [1.0, 1.0])]
    extra = "vec_id bigint, label int, embedding array<double>, key string, code string, n string, first string, links string, root string"
    table = rows(spark, [(*d, *"abcdef") for d in data], extra)
    got = [tuple(r) for r in vector_links.link(table).collect()]
    assert sorted(got, key=repr) == sorted(slow_links(data), key=repr)
    assert vector_links.link(table.where("false")).count() == 0


def test_least_block_is_within_budget():
    rng = np.random.default_rng(2)
    space = vector_links.Space(24, 0.93, 5)
    base = rng.standard_normal((500, 24))
    near = base + rng.standard_normal((500, 24)) * 0.3
    a, b = space.place(base), space.place(near)
    cosine = (base * near).sum(1) / np.linalg.norm(base, axis=1) / np.linalg.norm(near, axis=1)
    apart = (a.astype(int) - b) ** 2
    least = space.least_block(a, b)
    assert (cosine >= 0.93).sum() > 100
    for i in np.flatnonzero(cosine >= 0.93):
        assert apart[i, space.blocks[least[i]]].sum() <= space.budget[least[i]]


# ---------------------------------------------------------------- manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(values):
    texts = [None if v is None else str(v) for v in values]
    return sha(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def slow_climb(nodes, place):
    """Top of a list of digests and the siblings (left, right) of one place, level by level."""
    path = []
    while len(nodes) > 1:
        run = place // 16 * 16
        mates = nodes[run:run + 16]
        path.append(("".join(mates[:place - run]), "".join(mates[place - run + 1:])))
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        place //= 16
    return nodes[0], path


def slow_manifest(docs):
    """doc_id, source, lang, n_chars, text -> the contract's rows."""
    trees = {}
    for d in docs:
        trees.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, slow_leaf(d), d))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        tops.append(slow_climb([x[2] for x in trees[name]], 0)[0])
    root, out = slow_climb(tops, 0)[0] if tops else None, []
    for at, name in enumerate(names):
        for place, (_, _, leaf, d) in enumerate(trees[name]):
            path = slow_climb([x[2] for x in trees[name]], place)[1] + slow_climb(tops, at)[1]
            node = leaf
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                node = slow_leaf([*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])])
            for left, right in path:
                node = sha(left, node, right)
            out.append((d[0], leaf, tops[at], root, sha(*[s for p in path for s in p]), node, node == root))
    return out


def run_manifest(table):
    shown = manifest.audit(table, table["doc_id"].isNotNull() & (id_remainder(5) == 0))
    return [tuple(r) for r in shown.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_manifest(spark):
    data = [(i * 37 % 1000, None if i % 11 == 0 else ("wiki", "web", "Zeta", "é", "a")[i * i % 5], "en", i, f"Text É {i}")
            for i in range(700)]
    data += [(5000 + i, f"s{i}", None, None, None) for i in range(40)]
    table = rows(spark, data, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = run_manifest(table)
    assert sorted(got) == sorted(slow_manifest(data))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    table = odd.withColumns({c: F.lit("x") for c in ("leaf", "rank", "size", "digest", "children", "segments", "asked", "slot_")})
    data = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(run_manifest(table), key=repr) == sorted(slow_manifest(data), key=repr)
    assert run_manifest(empty) == []
    for few in (1, 2, 17):
        same = [(3, "a", "en", 1, "Same")] * few
        made = rows(spark, same, "doc_id bigint, source string, lang string, n_chars bigint, text string")
        assert sorted(run_manifest(made)) == sorted(slow_manifest(same))


# ---------------------------------------------------------------- whitening
@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [7, 7, 3, 3, 3, 0], [1e6, 1, 1e-6], [4], [2, 2 - 1e-9, 1], list(range(1, 41))])
def test_spectral_division(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    a = q @ np.diag(values).astype(float) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.eigenvectors(a)
    size = max(values)
    assert np.abs(got - np.sort(values)[::-1]).max() <= 1e-13 * size * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13 * len(values)
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * size * len(values)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=4, max_size=4), min_size=4, max_size=12))
def test_spectral_division_of_any_gram(data):
    a = np.array(data, float).T @ np.array(data, float)
    got, vectors = whitening.eigenvectors(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert np.abs(got - want).max() <= 1e-11 * max(1, want[0])
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_polar_factor_of_singular_shift():
    u = whitening.polar_factor(np.diag([3.0, 1e-9, -2.0]))
    assert np.abs(u - np.diag([1, 1, -1])).max() < 1e-6


def slow_whitening(data, most=16):
    """(id, vector) -> {(id, component): (n, deviation, |whitened|, explained)} with exact sums and numpy's solver."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in data
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total)])
        for k in range(min(most, len(x))):
            out.append((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, total)),
                        abs(centred @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def check_whitening(got, data):
    want = {r[:2]: r[2:] for r in slow_whitening(data)}
    assert {r[:2] for r in got} == set(want)
    for r in got:
        n, far, white, share = want[r[:2]]
        assert (r[2], int(r[3])) == (n, far)
        assert abs(abs(r[4]) - white) < 1e-8 and abs(r[5] - share) < 1e-10 * share and 0 <= r[6] < 1e-9


def test_whitening_query(spark):
    got = [tuple(r) for r in QUERIES["op13_embedding_whitening"](spark, SMALL).collect()]
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(got, data)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.standard_normal(5).tolist()) for i in range(60)] + [(100, [0.5] * 5)] * 30
    odd = [(200, None), (201, []), (202, [None] * 5), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0])]
    schema = "vec_id bigint, embedding array<double>, x string, c string, w string, component string, deviation string"
    table = rows(spark, [(*d, *"abcde") for d in data + odd], schema)
    got = [tuple(r) for r in whitening.whiten(table).collect()]
    assert len(got) == 90 * 5
    check_whitening(set(got), data)
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 100")).count() == 0
    assert whitening.whiten(table.where("vec_id IN (100, 1)")).select("component").distinct().count() == 1
    wide = rows(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert whitening.whiten(wide).count() >= 3


def test_products_are_exact_beyond_doubles(spark):
    whole = rows(spark, [([3 << 29, 1],), ([-(5 << 28), 7],)], "x array<bigint>")
    assert whitening.products(whole, [1, 2]) == [
        [((3 << 29) - 1) ** 2 + (-(5 << 28) - 1) ** 2, -((3 << 29) - 1) + 5 * (-(5 << 28) - 1)],
        [-((3 << 29) - 1) + 5 * (-(5 << 28) - 1), 26]]
