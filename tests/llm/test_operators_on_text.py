"""Each operator against brute force, on small tables and on odd rows."""

import collections
import functools
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest_rows import odd_rows, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from legwise.llm import (
    binary_search, language, mixing, near_dedup, ngrams, packing, page_text, quality_rules, spans, toxicity,
)
from legwise.llm.text import id_remainder


def tokens(text):
    return (text or "").encode().lower().split()


# ---------------------------------------------------------------- near copies
def slow_fingerprint(text):
    w = tokens(text)
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, radius):
    """(id, code) -> smallest id reachable, by comparing all pairs."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(items)), 2):
        if bin(items[i][1] ^ items[j][1]).count("1") <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, (doc, _) in enumerate(items):
        groups[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(doc, code, least[find(i)]) for i, (doc, code) in enumerate(items)]


@pytest.mark.parametrize("shard_codes", [32_768, 20])
def test_near_groups(docs, shard_codes):
    got = near_dedup.near_groups(docs, shard_codes=shard_codes).collect()
    want = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()], 2)
    assert sorted((r.doc_id, r.code % (1 << 64), r.component_id) for r in got) == sorted(want)


def test_near_groups_of_odd_rows(odd, empty):
    got = near_dedup.near_groups(odd).collect()
    want = slow_components([(r[0], slow_fingerprint(r[1])) for r in odd_rows()], 2)
    assert sorted(map(repr, ((r.doc_id, r.code % (1 << 64), r.component_id) for r in got))) == sorted(map(repr, want))
    assert near_dedup.near_groups(empty).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_keep_one_loses_no_unique_text(spark):
    def story(word):
        return " ".join(f"{word}{i}" for i in range(60))

    data = [(1, story("a")), (5, story("a")), (5, story("b")), (6, story("c")), (6, story("d")), (6, story("d")),
            (None, story("e")), (None, story("f")), (None, story("f")), (None, story("a")), (7, story("b"))]
    got = [tuple(r) for r in near_dedup.keep_one(rows(spark, data, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, story("a")), (5, story("b")), (6, story("c")), (6, story("d")), (None, story("e")),
         (None, story("f")), (None, story("f"))], key=repr)


def test_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ np.uint64((1 << int(a)) | (1 << int(b)))
                                    for a, b in rng.integers(0, 63, (20, 2))])
    codes = np.unique(near)
    tree = near_dedup.fit_tree(codes[::3], 5)
    found = near_dedup._Forest(codes)
    for _, own, ask in near_dedup.deal(tree, codes, codes[:0], 2):
        part = near_dedup._Forest(np.unique(np.concatenate([own, ask])))
        near_dedup.link_shard(own, ask, 2, part)
        tied = part.root != np.arange(len(part.root))
        found.link(part.codes[tied], part.codes[part.root[tied]])
    want = slow_components([(i, int(c)) for i, c in enumerate(codes)], 2)
    assert found.root.tolist() == [w[2] for w in want]


# ---------------------------------------------------------------- page text
def test_page_text_parts():
    page = ('<html><head><title>No</title></head><body><header><h1>Site</h1></header><div id="menu">a b</div>'
            '<div class="content"><h1>T &amp; x</h1><p>one <b>two</b>three<p>four<ul><li>i<li>j</ul></div>'
            '<div class="user-comments"><p>no</p></div><form>q</form><script>var a="<p>";</script></body>')
    assert page_text.main_text(page) == "T & x one twothree four i j"
    assert page_text.main_text("<nav>a</nav><article><h1>H</h1><p>b&nbsp; c<aside>d</aside></article><p>e") == "H b c"
    assert page_text.main_text(None) == page_text.main_text("") == ""
    for page in ('<div class="content has-sidebar"><nav>n</nav><article>Text</article></div>', '<main class="page with-sidebar">Text</main>',
                 '<article class="post share-enabled">Text</article>', '<article><p id="related-work">Text</p></article>',
                 '<article>Text<div id="comments">no</div></article><div class="sidebar"><article>x</article></div>'):
        assert page_text.main_text(page) == "Text"
    assert page_text.main_text("no tags &lt;here&gt;") == "no tags <here>"
    assert page_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_page_text_learns_the_site(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><p>buy now</p></div><div><span>story {i} of many</span></div></body>")
             for i in range(12)]
    got = page_text.extract(rows(spark, pages, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"story {i} of many" for i in range(12)}


def test_page_text_learns_inside_and_outside_the_article(spark):
    page = ("<body><em>buy now</em><article><h1>T {i}</h1><div><u>read it in our app</u></div><p>teaser {i}</p></article>"
            "<section><span>story {i} of many</span></section></body>")
    pages = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(12)] + [
        (90, "http://few.example/", "<article>teaser</article><div>a story that is longer</div>"),
        (91, "http://less.example/", "<article>a story that is longer</article><div>teaser</div>")]
    got = page_text.extract(rows(spark, pages, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"T {i} teaser {i} story {i} of many" for i in range(12)} | {
        90: "teaser a story that is longer", 91: "a story that is longer"}


def test_page_text_of_a_very_deep_site(spark):
    deep = "<div>" * 5000
    pages = [(i, f"http://h.example/{i}", f"<body><section>buy now</section><p>story {i}</p>{deep}end {i}") for i in range(6)]
    got = page_text.extract(rows(spark, pages, "page_id bigint, url string, html string")).collect()
    assert all(r.text.startswith(f"story {r.page_id}") for r in got) and len(got) == 6


def test_page_text_of_odd_rows(spark):
    odd_pages = [(1, None, None), (2, "x", ""), (2, "x", ""), (None, "http://A/", "<p>a"), (4, "http://a/", "<p>" + "b " * 90_000)]
    made = rows(spark, odd_pages, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS noise", "3 AS text")
    got = page_text.extract(made).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 1, 179_999]
    assert page_text.extract(made.where("false")).count() == 0


# ---------------------------------------------------------------- language model
def slow_scores(items):
    seqs = [(d, tokens(t) + [b"\n"]) for d, t in items]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in items]
    single, pair = collections.Counter(), collections.Counter()
    for (_, s), out in zip(seqs, held):
        if not out:
            single.update(s)
            pair.update(zip([b"\n", *s], s))
    n, v = sum(single.values()), len(single)
    d = min(0.75, max(sum(c == 1 for c in single.values()), 0.5) / max(v, 1))
    size = lambda c: math.ceil(math.log2(c + 1))
    after, once = collections.Counter(), collections.Counter()
    for w, c in single.items():
        after[size(c)] += c
    for (u, _), c in pair.items():
        once[size(single[u])] += c == 1
    fail = lambda u: (once[size(single[u])] + 1) / (after[size(single[u])] + 2) if single[u] else 1.0
    root = lambda w: (single[w] - d if single[w] else d * v) / n if n else 1.0
    out = []
    for (doc, s), h in zip(seqs, held):
        score = sum(math.log10((1 - fail(u)) * (pair[u, w] / single[u] if single[u] else 0) + fail(u) * root(w))
                    for u, w in zip([b"\n", *s], s))
        out.append((doc, h, len(s), sum(single[w] > 0 for w in s), n, sum(math.log10((single[w] + 1) / (n + v + 1)) for w in s), score))
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("chunk, shard", [(1 << 25, 2_000_000), (1 << 16, 9000)])
def test_scores(docs, monkeypatch, chunk, shard):
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", shard)
    got = ngrams.score(docs).collect()
    same_scores(got, slow_scores([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows(odd, empty):
    same_scores(ngrams.score(odd).collect(), slow_scores([(r[0], r[1]) for r in odd_rows()]))
    assert ngrams.score(empty).count() == 0


def test_chances_add_up():
    stats = [10.0, 4.0, 2.0, *[0.0] * 128]
    machine = ngrams.Automaton(stats)
    counts = np.array([1, 1, 3, 5])
    assert machine.root(counts).sum() + machine.root(np.array([0]))[0] == pytest.approx(1.0)


# ---------------------------------------------------------------- top k
def test_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 64))
    vectors[100:180] = vectors[3]  # one code held by many rows
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None])]
    made = rows(spark, data, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS w0")
    got = binary_search.search(made, made.where("vec_id % 50 = 0"), k=7, part_codes=20).collect()
    bits = {i: np.array([x is not None and x > 0 for x in v] + [False] * (64 - len(v))) for i, v in data if v is not None}
    want = [(q, k + 1, i, d) for q in bits if q % 50 == 0
            for k, (d, i) in enumerate(sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:7])]
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "id", "distance")) for r in got) == sorted(want)
    assert binary_search.search(made.where("false"), made.where("false")).count() == 0
    few = made.where("vec_id < 3")
    assert binary_search.search(few, few, k=10).count() == 9


def test_hostile_pages_take_no_square_of_their_length():
    import time

    started = time.time()
    assert page_text.main_text("<i>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert page_text.main_text("<a x=" + "y" * 3_000_000 + ">t") == "t"
    assert time.time() - started < 5


# ---------------------------------------------------------------- quality
def slow_counts(text):
    text = text or ""
    w, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(odd, docs, empty):
    for table in (odd, docs):
        got = quality_rules.judge(table).collect()
        want = [(r.doc_id, *slow_counts(r.text)) for r in table.collect()]
        assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.base_failed and r.kept for r in got)
    assert quality_rules.judge(empty).count() == 0


def test_quality_limits_follow_the_group(spark):
    """The same text is kept where symbols are common and turned away where they are rare."""
    plain = " ".join(f"w{i}" for i in range(80))
    data = [(1000 * g + i, f"{plain} {i} " + "#" * (i % 4 * (1 + 20 * g)), "en", "ab"[g]) for g in (0, 1) for i in range(200)]
    data += [(5000 + g, plain + " #" * 60, "en", "ab"[g]) for g in (0, 1)]
    made = rows(spark, data, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(made).collect()}
    assert [d for d, kept in got.items() if not kept] == [5000]
    found = {r.source: r.symbol_rate_high for r in quality_rules.limits(
        quality_rules.sketches(quality_rules._bins(quality_rules.measure(made)))).collect()}
    assert found["b"] > 2 * found["a"]


def test_quality_sketch_takes_parents_with_a_fixed_weight(spark):
    sketch = rows(spark, [("en", "a", "line_rate", 5, 200), ("en", "b", "line_rate", 9, 600), ("de", "a", "line_rate", 1, 200)],
                  "lang string, source string, rate string, bin int, n bigint")
    got = {(r.lang, r.source, r.bin): r.w / quality_rules.UNIT for r in quality_rules.merged_sketches(sketch).collect()}
    assert got[("en", "a", 5)] == 200 + 50 * 0.25 + 50 * 0.2 and got[("en", "a", 9)] == 50 * 0.75 + 50 * 0.6
    assert got[("de", "a", 1)] == 200 + 50 + 50 * 0.2 and len(got) == 9


# ---------------------------------------------------------------- toxicity
def test_toxicity_pairs(spark, odd, empty):
    data, said = [], []
    for i in range(400):
        insult, group = i % 2, i // 2 % 2
        data.append((i, f"{'fool' if insult else 'pal'} {'them' if group else 'us'} n{i}", "en", "a"))
        said.append((i, int(insult and group)))
    made = rows(spark, data, "doc_id bigint, text string, lang string, source string")
    labels = rows(spark, [*said, (5, None), (None, 1), (3, 1)], "doc_id bigint, toxic int")
    machine = toxicity.train(made, labels)
    score = {r.doc_id: r.score for r in toxicity.predict(made, machine).collect()}
    wrong = [i for i, y in said if i != 3 and (score[i] >= 0.5) != bool(y)]
    assert not wrong  # neither word alone is toxic
    assert toxicity.predict(odd, machine).count() == len(odd_rows())
    assert toxicity.train(empty, labels) is None
    assert {r.score for r in toxicity.predict(odd, None).collect()} == {0.0}


def test_toxicity_of_pairs_only(spark):
    said = [(i, i % 2 ^ i // 2 % 2) for i in range(400)]
    data = [(i, f"{'fool' if i % 2 else 'pal'} {'them' if i // 2 % 2 else 'us'} n{i}") for i, _ in said]
    made = rows(spark, data, "doc_id bigint, text string")
    machine = toxicity.train(made, rows(spark, said, "doc_id bigint, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.predict(made, machine).collect()}
    assert not [i for i, y in said if (score[i] >= 0.5) != bool(y)]  # each word is in as many toxic as clean texts


def test_terms_that_matter_beside_a_strong_one(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 12)
    sets = []
    for i in range(2000):
        insult, group = i % 10 == 0, i // 10 % 5
        toxic = int(insult and group == 0)
        # the group words of toxic texts are as frequent in clean ones; 200 other terms say nothing
        sets.append((toxic, [*([1] if insult else []), 10 + i // 50 % 4 if group == 0 else 20 + i % 4, 1000 + i * 7 % 200]))
    kept = toxicity.kept_buckets(rows(spark, sets, "label int, active array<bigint>"))
    assert {1, 10, 11, 12, 13} <= set(kept)


# ---------------------------------------------------------------- packing
def check_packing(got, source, capacity=2048):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for doc, text in source:
        ids = np.array([*made.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


def test_packing(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    used, least = check_packing(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least * 1.05


def test_packing_of_odd_rows(odd, empty):
    check_packing(packing.pack(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert packing.pack(empty).count() == 0


@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sé1!")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    both = packing_encoder()
    assert both(text).tolist() == both.exact.encode(text, add_special_tokens=False).ids


@functools.cache
def packing_encoder():
    return packing.Encoder(packing.default_tokenizer())


def test_special_strings_and_other_vocabularies():
    import public_tokenizers

    both = packing_encoder()
    assert both.fast is not None
    assert both("a <|endoftext|> b").tolist() == both.exact.encode("a <|endoftext|> b", add_special_tokens=False).ids
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None
    assert other("Ab c").tolist() == other.exact.encode("Ab c", add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n"])
def test_ids_of_very_long_blank_runs(run):
    both = packing_encoder()
    text = "a" + run * 2_000_000 + "b"
    assert both(text).tolist() == both.exact.encode(text, add_special_tokens=False).ids


def test_configurations():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 100, 40))
    counts = rng.integers(1, 50, len(lengths))
    made, bound = packing.configurations(lengths, counts, 100)
    held = np.zeros(len(lengths), int)
    for chosen, number in made:
        assert lengths[list(chosen)].sum() <= 100
        np.add.at(held, list(chosen), number)
    assert (held == counts).all()
    assert bound <= sum(n for _, n in made) <= bound * 1.1 + 2


# ---------------------------------------------------------------- language
def test_language(docs, odd, empty):
    model = language.train(docs.where(id_remainder(5) != 0))
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model, keep=(docs.doc_id,)).collect()}
    held = docs.where(id_remainder(5) == 0).collect()
    assert sum(got[r.doc_id] == r.lang for r in held) >= 0.95 * len(held)
    named = language.predict(odd, model, keep=(odd.doc_id, odd.text)).collect()
    for r in named:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.score <= 1
    kept = language.keep_named(odd, model)
    assert kept.dtypes == odd.dtypes
    assert kept.count() == sum(r.lang_pred != "und" for r in named)
    none = language.train(empty)
    assert {r.lang_pred for r in language.predict(odd, none, keep=(odd.doc_id,)).collect()} == {"und"}
    assert language.predict(empty, model, keep=(empty.doc_id,)).count() == 0


def test_code_length_of_a_context_tree(spark):
    """Escape probabilities by hand: 'aab' after three blanks, then the text 'a'."""
    model = language.train(rows(spark, [("aab", "x")], "text string, lang string"))
    # in the context of three blanks 'a' was seen once, so it has 1 of 1 + 1 escape
    assert model.code_lengths(b"a")[0] == pytest.approx(1.0)
    assert model.code_lengths(b"aab")[0] > model.code_lengths(b"aa")[0] > 1.0


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "FLUSH", 7)
    cut = language.gram_counts(rows(spark, [("abcabcabcabcabcabc", "x")], "text string, lang string")).collect()
    assert sum(r.n for r in cut) == 18


# ---------------------------------------------------------------- mixing
def test_mixing(docs, odd, empty):
    shown = mixing.mix(docs, order=True).collect()
    tokens_of = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    per, mixed = collections.Counter(), collections.Counter()
    for r in docs.collect():
        per[r.source] += tokens_of[r.doc_id]
    for r in shown:
        mixed[r.source] += r.n_tokens
        assert r.n_tokens == tokens_of[r.doc_id]
    assert {r.doc_id for r in shown} == set(tokens_of)
    assert max(mixed[s] / per[s] for s in per) <= mixing.MOST_REPEATS + 1e-9
    spread = lambda c: -sum(v / sum(c.values()) * math.log(v / sum(c.values())) for v in c.values())
    assert spread(mixed) >= spread(per) - 0.02
    # an epoch starts again only after all documents of the source were shown
    for s in per:
        times = collections.Counter(r.doc_id for r in shown if r.source == s)
        assert max(times.values()) - min(times.values()) <= 1
    assert mixing.mix(odd).columns == odd.columns
    assert {r.doc_id for r in mixing.mix(odd).collect()} == {r[0] for r in odd_rows()}
    assert mixing.mix(empty).count() == 0


def test_mixing_budget(docs):
    measured = mixing.settle(mixing._measured(docs))
    budget = measured.agg({"tokens": "sum"}).first()[0] // 2
    shown = mixing.mix(docs, budget=budget, order=True).collect()
    total = sum(r.n_tokens for r in shown)
    assert 0.5 * budget < total <= budget  # whole documents only, of few and unequal ones


def test_exponent_meets_both_conditions(spark):
    shares = rows(spark, [("a", 0.7), ("b", 0.2), ("c", 0.1)], "origin string, share double")
    p = np.array([0.7, 0.2, 0.1])

    def reach(a):
        w = p ** a / (p ** a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.fit_exponent(shares, 0.9, 100.0)
    assert reach(a) >= 0.9 * math.log(3) > reach(a + 2e-6)
    b = mixing.fit_exponent(shares, 1.0, 2.0)
    assert 7 ** (1 - b) <= 2.0 < 7 ** (1 - b + 2e-6)


# ---------------------------------------------------------------- repeated passages
def slow_spans(items):
    import re

    ends = ".!?\n\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4"
    cut = {}
    for doc, text in items:
        cut[doc, text] = [(m, m.translate(str.maketrans("\t\n\x0b\f\r", " " * 5)).strip(" "), len(m.encode().split()))
                          for m in re.findall(rf"[^{ends}]*[{ends}]+[\x20\x09-\x0D]*|[^{ends}]+", text or "")]
    runs = collections.defaultdict(list)
    order = sorted(cut, key=lambda k: (k[0] is None, k[0] or 0))
    for key in order:
        s = cut[key]
        for i in range(len(s)):
            stops = [i + 1] if s[i][2] >= 25 else []
            if i + 1 < len(s) and s[i][2] + s[i + 1][2] >= 10:
                stops.append(i + 2)
            else:
                long = [j for j in range(i + 1, min(len(s), i + 40) + 1) if sum(x[2] for x in s[i:j]) >= 30]
                stops += long[:1]
            for stop in set(stops):
                runs[tuple(x[1] for x in s[i:stop])].append((key, i, stop))
    gone = {(k, j) for found in runs.values() for k, i, stop in found[1:] for j in range(i, stop)}
    return {k: None if k[1] is None else "".join(m for i, (m, *_) in enumerate(s) if (k, i) not in gone) for k, s in cut.items()}


def test_spans_of_odd_rows(odd, empty):
    got = spans.drop_repeated(odd)
    assert got.columns == odd.columns
    want = slow_spans([(r[0], r[1]) for r in odd_rows()])
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(
        repr((r[0], want[r[0], r[1]])) for r in odd_rows())
    assert spans.drop_repeated(empty, counts=True).count() == 0


def test_spans_of_short_long_and_other_sentences(spark):
    short = "Ja! Nein. Und du? Wir auch. " * 3 + "".join(f"Wort {i}. So geht {i}! " for i in range(12))
    long = "one sentence " + " ".join(f"w{i}" for i in range(30)) + ". "
    other = "".join(f"\u5b57{i} \u8bcd{i} \u53e5{i}\u3002" for i in range(12))
    made = rows(spark, [(d, f"Start {d} of its own. {x}End {d}.") for d, x in enumerate([short, short, long, long, other, other])],
                "doc_id bigint, text string")
    items = [(r.doc_id, r.text) for r in made.collect()]
    got = {r.doc_id: r.text for r in spans.drop_repeated(made).collect()}
    want = slow_spans(items)
    assert got == {d: want[d, t] for d, t in items}
    assert long not in got[3] and long in got[2] and got[2] == items[2][1]
    assert len(got[1]) < 80 and len(got[5]) < 60 and got[3].startswith("Start 3 of its own. ") and got[3].endswith("End 3.")


@pytest.mark.parametrize("hot_rows", [2_000, 2])
def test_spans(docs, monkeypatch, hot_rows):
    monkeypatch.setattr(spans, "HOT_ROWS", hot_rows)
    want = slow_spans([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in spans.drop_repeated(docs).collect()}
    assert got == {d: want[d, text[d]] for d in text}


def test_spans_deal_runs_once(docs):
    found = spans.covered(spans._key(docs, "text"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the table of runs is the widest one; every shuffle of it costs half the input on disk
    assert plan.count("Exchange hashpartitioning(h#") == 1
    assert "regexp_extract_all" not in spans.runs(spans._key(docs, "text"), "text")._jdf.queryExecution().executedPlan().toString()


def test_spans_of_frequent_runs_in_parts(spark, monkeypatch):
    """All runs are dealt in one pass whose join gives a row for each run; parts of frequent ones find the same first place."""
    monkeypatch.setattr(spans, "HOT_ROWS", 20)
    common = "This sentence stands in every one of the texts. It has ten words or more, like its neighbour. "
    items = [(d % 150, f"Text {d % 150} begins with some words of its own here. {common}{'' if d % 3 else common}The end of {d % 50} is near by now.")
             for d in range(160)]
    made = rows(spark, [*items, (None, items[0][1])], "doc_id bigint, text string")
    found = spans.runs(spans._key(made, "text"), "text")
    often = found.groupBy("h", "h2").count().where("count > 20")
    ranked = spans._ranked(found, often)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"HashJoin \[.*\], (\w+), Build", plan) == ["LeftOuter"] and plan.count("Exchange hashpartitioning(h#") == 2  # one counts
    assert ranked.count() == found.count() and ranked.where("spot IS NOT NULL").count() > 150
    assert ranked.where("spot IS NOT NULL").select("h", "spot").distinct().count() > 100
    want = slow_spans([(r.doc_id, r.text) for r in made.collect()])
    got = spans.drop_repeated(made).collect()
    assert len(got) == 161 and {(r.doc_id, r.text) for r in got} == {(k[0], t) for k, t in want.items()}
