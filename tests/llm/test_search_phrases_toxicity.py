"""Phrase mining, ranked search and toxic spans against plain versions, on small tables with awkward rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumastack.llm import lexical, phrases, toxicity

SCHEMA = "doc_id long, text string, lang string, score string, term string, n int, label string, h1 string, ids string, item_id string, key string"
CLASH = ("x", "x", 1, "x", "x", "x", "x", "x")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "red", "deer", "été", "日本", "naïve", "x1", "İn"] + [f"w{i}" for i in range(30)]
    joints = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", "\r\n", ";"]
    texts = ["".join(rng.choice(vocabulary[: rng.choice((4, 10, 40))]) + rng.choice(joints) for _ in range(rng.randint(0, 160))) for _ in range(120)]
    texts += [texts[3], texts[3], "", None, " \n ", "the " * 5000, "red deer" * 3, "!!!", "a\x00b c\x7fd"]
    out = [(i, t, ("en", "de", None, "und")[i % 4], *CLASH) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, texts[7], "en", *CLASH), (None, texts[8], None, *CLASH), (None, None, None, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                inside[p[:2]], inside[p[1:]] = max(a, inside[p[:2]]), max(a, inside[p[1:]])
        kept = []
        for p, a in candidates.items():
            if len(p) == 2 and 100 * inside[p] >= 50 * a and p in inside and inside[p]:
                continue
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"max_words": 5}, {"max_part": 40}, {"max_words": 0, "max_part": 7}])
def test_phrases(spark, docs, rows, limits):
    got = sorted(map(tuple, phrases.phrases(docs, min_count=6, top=50, **limits).collect()))
    assert got == plain_phrases(rows, 6, 50)


def test_phrases_without_candidates(spark, docs):
    assert phrases.phrases(docs.limit(0)).count() == 0
    assert phrases.phrases(docs, min_count=10**6).count() == 0


def test_phrases_read_texts_three_times_however_many_tries(spark, docs, rows):
    read = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = sorted(map(tuple, phrases.phrases(docs.select("text", "lang").mapInArrow(task, "text string, lang string"), min_count=6, top=50, max_part=7).collect()))
    assert got == plain_phrases(rows, 6, 50)
    assert read.value == 3 * len(rows)


def test_tries_count_runs_that_reach_the_least_count():
    rng = np.random.default_rng(3)
    runs = rng.integers(0, 12, (3000, 3)).astype(np.uint64)
    counts = rng.integers(1, 4, 3000)
    for width in (2, 3):
        want = Counter()
        for r, n in zip(runs[:, :width].tolist(), counts.tolist(), strict=True):
            want[tuple(r)] += n
        *columns, n = phrases.trie_counts(list(runs[:, :width].T), counts, 6)
        got = dict(zip(zip(*(c.tolist() for c in columns), strict=True), n.tolist(), strict=True))
        assert got == {r: n for r, n in want.items() if n >= 6} and len(n) == len(got)


def test_trie_holds_its_candidates_only():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 60, (900, 3)).astype(np.uint64)
    sizes = rng.integers(1, 4, 900)
    seen = {tuple(int(v) for v in r[:s]) for r, s in zip(table, sizes, strict=True)}
    kept = sorted(seen)
    rows = np.array([[*p, *[0] * (3 - len(p))] for p in kept], np.uint64)
    trie = phrases.build_trie(rows, np.array([len(p) for p in kept]))
    text = rng.integers(0, 70, 5000).astype(np.uint64)
    joined = rng.random(5000) < 0.9
    joined[-1] = False
    words = phrases.Words(text, joined, text, text, text, text)
    for level, state in enumerate(trie.states(words)):
        for i in range(5000 - level):
            own = tuple(int(v) for v in text[i : i + level + 1])
            hit = state[i] >= 0 and trie.accepts[state[i]] >= 0
            assert hit == (own in seen and bool(joined[i : i + level].all()))
            if hit:
                assert kept[trie.accepts[state[i]]] == own


def plain_search(rows, items, k):
    bags = [(i, Counter(TERM.findall(_lower(t)))) for i, t, *_ in rows]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(TERM.findall(_lower(t)))
    out = []
    for item, own in terms.items():
        found = []
        for doc, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [(50, 10**6, 10**6), (3, 2000, 3), (7, 1, 1)])
def test_ranked_search(spark, docs, rows, limits, monkeypatch):
    k, segment_bytes, max_terms = limits
    monkeypatch.setattr(lexical, "VISIT", 4)
    items = [(1, "The red deer"), (2, "w1 w2 w3 w1 ÉTÉ été"), (3, None), (4, ""), (5, "unknown"), (6, "d"), (None, "naïve w9"), (None, "x1"), (7, "w4"), (7, "w5 the"), (8, "w4"), (8, "w4")]
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, term string")
    from lumastack.llm.scratch import stored

    index = stored(lexical.build_index(docs.repartition(3), segment_bytes=segment_bytes))
    got = lexical.search(index, table, k=k, max_terms=max_terms).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, k)


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_bounds_save_visits():
    """Strata whose bound is below the k-th best are not scored, and nothing is lost by it."""
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(5, 3000, 4000))
    docs = np.sort(rng.choice(4000, 3000, replace=False))
    segment = {"terms": np.array([5], np.uint64), "starts": np.array([0, 3000]), "sizes": sizes, "docs": docs, "tfs": rng.integers(1, 4, 3000), "ids": np.arange(4000), "null": np.zeros(4000, bool)}
    best = [lexical._Best(10)]
    scored = lexical._visit(segment, np.array([5], np.uint64), np.array([700]), [np.array([0])], best, 4000, int(sizes.sum()))
    m = 50 + 50 * sizes.astype(object) * 4000 // int(sizes.sum())
    want = sorted((-700 * (10**9 * int(t) // (1000 * int(t) + 20 * m[d])), d) for d, t in zip(docs.tolist(), segment["tfs"], strict=True))[:10]
    assert [(-s, d) for s, d in zip(best[0].score.tolist(), best[0].doc.tolist(), strict=True)] == want
    assert scored < 2000


def test_chain_marginals_by_all_paths():
    rng = np.random.default_rng(1)
    odds, steps, begin = rng.normal(0, 2, 11), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    first = np.zeros(11, bool)
    first[[0, 4, 5]] = True
    want = np.zeros(11)
    for a, b in ((0, 4), (4, 5), (5, 11)):
        weight, total = np.zeros(b - a), 0.0
        for tags in itertools.product((0, 1), repeat=b - a):
            w = math.exp(begin[tags[0]] + sum(odds[a + i] * t for i, t in enumerate(tags)) + sum(steps[s, t] for s, t in itertools.pairwise(tags)))
            total += w
            weight += w * np.array(tags)
        want[a:b] = weight / total
    assert np.allclose(toxicity.chain_marginals(odds, first, steps, begin), want)
    long = np.tile(odds, 400)
    starts = np.tile(first, 400)
    assert np.allclose(toxicity.chain_marginals(long, starts, steps, begin), np.tile(want, 400))


def _toxic_table(rng):
    clean = [f"{a}{b}" for a in ("ba", "de", "fo", "gu", "mi") for b in ("ron", "tal", "ves", "lin", "pod", "kas")]
    bad = ["vileness", "rottenly", "grossout"]
    out, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return out, labels, bad


def test_toxic_spans(spark):
    rng = random.Random(9)
    rows, labels, bad = _toxic_table(rng)
    extra = [(1000, "Ünï Vileness, tal"), (1001, "vileness " * 4000), (1002, None), (1003, "  "), (None, "baron rottenly"), (5, rows[5][1]), (1004, "vilenesses dered")]
    docs = spark.createDataFrame([(*r, 1, "x", "x", "x") for r in [*rows, *extra]], "doc_id long, text string, label int, key string, score string, toxic string")
    table = spark.createDataFrame([*labels, (None, 1), (3, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(rows) + len(extra)
    truth, texts = dict(labels), dict(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    for r in held:
        assert [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] == re.findall("(?:(?:vileness|rottenly|grossout) ?)+(?<! )", texts[r["doc_id"]])
    by = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert [(s["start"], s["end"]) for s in by[1000]["spans"]] == [(4, 12)]
    assert by[1000]["predicted"] and by[1001]["predicted"] and by[None]["predicted"] and by[None]["held_out"]
    assert not by[1002]["predicted"] and not by[1003]["predicted"] and by[1002]["score"] == by[1003]["score"] and not by[1002]["spans"]
    assert by[1004]["predicted"]  # a form that the sample does not hold


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, one).collect()] == [1.0, 1.0]
