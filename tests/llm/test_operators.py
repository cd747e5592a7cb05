"""The operators on small tables with nulls, empties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumastack.llm import bpe_fst, html_tree, line_rules, mixing, near_dup, pii, quality_qda, records, sketch, token_scan
from lumastack.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, ids string, host string, shard string"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [_words(rng, rng.randint(30, 120)) for _ in range(12)]
    texts = base + base[:3] + [t.replace("a", "a", 1)[:-4] + "zzz" for t in base[:4]] + ["", None, " \n\t ", "one", "one two three", base[5] + "\n" + base[5], _words(rng, 9000), "mail bob@x.org, 4111111111111111 5500005555555559", "日本語 🎉 é\r\nend"]
    out = [(i * 3, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 5, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "a row without an id " + base[7], "en", "s1", 5, 5, "x", "x", "x", "x"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _order(rows):
    """Ascending ids, nulls first; ties by the texts' hashes as signed numbers."""
    signed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))


def test_near_duplicates(spark, docs, rows, empty):
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = near_dup.near_duplicates(docs, k=4, num=80, den=100, block=3).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert near_dup.near_duplicates(empty, k=4).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base, rows = _words(rng, 100).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(97)} for _, t in rows]
    comp = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, block=7).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(comp))
    assert len(set(comp)) > 1


def test_a_large_group_and_one_outsider_deal_few_rows(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("bucket"), "id", F.when(F.col("id") < n - 1, 0).otherwise(F.col("id")).alias("comp"), F.lit(1.0).alias("weight"))
    dealt = near_dup._with_blocks(rows, 600).cache()
    assert dealt.count() <= n + 2 * -(-n // 600) and dealt.where("outer").select("id").distinct().count() == 1
    assert dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 1000
    # each document meets the outsider once
    assert dealt.where("not outer").select("id").distinct().count() == n
    many = near_dup._with_blocks(rows.where("id < 500").withColumn("comp", F.col("id") % 5), 60)
    met = many.where("outer").select("i", "j", "id", "comp").toDF("i", "j", "x", "cx").join(many, ["i", "j"]).where("cx <> comp and (j = 0 or not outer)").select("x", F.col("id").alias("y"))
    both = met.union(met.select("y", "x")).distinct().count()
    assert both == 500 * 400


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long").repartition(7)
    got = {r["id"]: r["comp"] for r in near_dup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_token_records(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    marked = [(1000, "an <|endoftext|> inside", *rows[0][2:]), (1001, "<|endoftext|>", *rows[0][2:]), (1002, "a\nb,\nCd. x\n\ny", *rows[0][2:])]
    rows, docs = rows + marked, docs.union(spark.createDataFrame(marked, SCHEMA))
    want = {}
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = records.record_digests(docs, P.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is not None and r["doc_id"] for r in got] == sorted(r["doc_id"] is not None and r["doc_id"] for r in got)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0
    for key, found in want.items():
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == key) == sorted(found)
    assert records.record_digests(empty, P.path("byte_bpe_50k.json")).count() == 0
    files = f"file://{tmp_path}/shards"
    records.write_records(docs, files, P.path("byte_bpe_50k.json"), shards=3)
    index = records.write_index(spark, files, f"file://{tmp_path}/index")
    picks = index.where("key is not null").select("shard", "offset", "key", F.xxhash64("key").alias("place"))
    for r in records.read_picked(spark, files, picks).collect():
        text = next(x[1] for x in rows if x[0] == r["key"]) or ""
        assert r["ids"][:-1] == t.encode(text, add_special_tokens=False).ids and r["ids"][-1] == 0


def test_mixing(spark, docs, rows, empty):
    m = mixing.mix(docs, block=16, shard_slots=32, keep_text=True)
    got = mixing.taken_words(m).collect()
    assert len(got) == len(rows)
    taken, source = {}, {r[0]: r[3] for r in rows}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]] if r["doc_id"] is not None else "s1" if r["size"] else None
        taken.setdefault(s, [0, r["target"], r["source_size"], 0])
        taken[s][0] += r["taken"]
        taken[s][3] += r["size"]
    for words, target, size, total in taken.values():
        assert abs(words - target) <= 1 and size == total
    texts = mixing.mixed_documents(m).collect()
    assert sum(len(WORD.findall(r["text"])) for r in texts) == sum(r["taken"] for r in got)
    again = mixing.taken_words(mixing.mix(docs.repartition(5), block=16, shard_slots=32)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.taken_words(mixing.mix(empty)).count() == 0 and mixing.mixed_documents(mixing.mix(empty, keep_text=True)).count() == 0


def test_personal_data(docs, rows, empty):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r["n_email"])
    text = next(r[1] for r in rows if r[0] == one["doc_id"])
    spans = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in one["spans"].split(",")}
    assert spans == {"bob@x.org", "4111111111111111", "5500005555555559"}
    redacted = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert redacted[one["doc_id"]] == "mail <email>, <card> <card>"
    assert pii.personal_data(empty).count() == 0


def test_quality(spark, docs, rows, empty):
    ids = [r[0] for r in rows if r[0] is not None]
    labels = spark.createDataFrame([(i, int(n % 2), 0) for n, i in enumerate(ids)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_qda.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in quality_qda.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality_qda.quality_scores(empty, labels).count() == 0


def test_quadratic_discriminant_equals_plain_one():
    rng = np.random.default_rng(2)
    d = len(quality_qda.NAMES)
    x0, x1 = rng.normal(0, 1, (200, d)), rng.normal(0.7, 2, (300, d))
    parts = [(x - x.mean(0)).T @ (x - x.mean(0)) / len(x) for x in (x0, x1)]
    pooled = (parts[0] * 200 + parts[1] * 300) / 500
    dens = []
    model = quality_qda.Model(0.6, np.stack([x0.mean(0), x1.mean(0)]), [], [])
    for x, c in ((x0, parts[0]), (x1, parts[1])):
        c = 0.9 * c + 0.1 * pooled
        c = 0.95 * c + (0.05 * np.trace(c) / d + 1e-4) * np.eye(d)
        model.factors.append(np.linalg.inv(np.linalg.cholesky(c)))
        model.logdets.append(np.linalg.slogdet(c)[1])
        z = rng.normal(0, 1, (5, d)) if not dens else z  # noqa: F821
        dens.append(-0.5 * np.einsum("ni,ij,nj->n", z - x.mean(0), np.linalg.inv(c), z - x.mean(0)) - 0.5 * np.linalg.slogdet(c)[1])
    want = 1 / (1 + np.exp(-(dens[1] - dens[0] + np.log(0.6 / 0.4))))
    assert np.allclose(model.score(z), want)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op5_quadratic_discriminant"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)


def test_bpe(docs, rows, empty):
    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.read_ranks(open(ranks).read()), special_tokens={})
    want = sorted((str(r[0]), len(i := library.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    got = bpe_fst.code_digests(docs, ranks, P.PATTERN, block=7).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    back = bpe_fst.decode(bpe_fst.encode(docs, ranks, P.PATTERN), ranks, block=5).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe_fst.code_digests(empty, ranks, P.PATTERN).count() == 0


def test_fingerprints(docs, rows, empty):
    order = [(r[0], r[1] or "") for r in _order([(r[0], r[1] or "") for r in rows])]
    want = []
    for i, (doc, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        new = sketch.edited(text, nxt)
        a, b, c = (sketch.sketch(t.encode()) for t in (text, new, nxt))
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), sketch.written(a), sketch.written(b), sketch.likeness(a, b), sketch.likeness(a, c)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sketch.fingerprints(docs).collect())
    assert sketch.fingerprints(empty).count() == 0
    one = sketch.fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_line_rules(spark, rows, docs, empty):
    got = line_rules.line_rules(docs.drop("host").withColumnRenamed("source", "host")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            text = next(x[1] or "" for x in rows if x[0] is None and len(WORD.findall(x[1] or "")) == r["n_words"])
        else:
            text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert line_rules.line_rules(empty.drop("host").withColumnRenamed("source", "host")).count() == 0
    rng = random.Random(9)
    noise = [(i, "The same long line of nine words is here\n" + ("" if i % 2 else _words(rng, 30)), "h") for i in range(40)]
    out = {r["doc_id"]: r for r in line_rules.line_rules(spark.createDataFrame(noise, "doc_id long, text string, host string"), min_words=1).collect()}
    assert all(out[i]["removed_words"] == 9 and out[i]["kept"] == (i % 2 == 0) or i % 2 for i in out)


def test_pages(spark):
    body = "<html><body><nav>M</nav><article><h1>T{0}</h1><p>Text {0}</p><div class='tail'>Same for all pages</div></article><footer>F</footer></body></html>"
    rows = [(i, "http://h.org/x", body.format(i), 1, "x") for i in range(8)] + [(90, None, None, 1, "x"), (91, "http://h.org/", "", 1, "x"), (92, "http://o.org/", "<p>No article</p><div class='menu'>x</div>", 1, "x"), (93, "::", "<article>", 1, "x"), (0, "http://h.org/x", body.format(0), 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, low int, host string")
    got = html_tree.main_texts(pages).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "T3\nText 3" and text[90] == text[91] == text[93] == "" and text[92] == "No article"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_tree.main_texts(pages.where("false")).count() == 0
    tree = {r["label"]: r["importance"] for r in html_tree.style_tree(pages).collect() if r["host"] == "h.org"}
    assert tree["div[class=tail]"] < 0.3 < tree["p"]
    urls = {"http://A.b:80/x": "a.b", None: "", "//u:p@[2001:db8::1]:8/x": "2001:db8::1", "no/host": "", "https://X.y?q": "x.y"}
    hosts = spark.createDataFrame([(u,) for u in urls], "url string").select("url", html_tree.host_of(F.col("url")).alias("host"))
    assert {r["url"]: r["host"] for r in hosts.collect()} == urls


def test_style_tree_equals_plain_counts(spark):
    """Pages, presentations and contents of every node, counted plainly over distinct bodies, and their entropies."""
    rng, rows = random.Random(2), []
    for i in range(30):
        parts = "".join(f"<p>{_words(rng, rng.choice([3, 30, 90]))}</p>" for _ in range(rng.randint(1, 4)))
        rows.append((i, f"http://{'ab'[i % 2]}.org/{i}", f"<body><div><a>Home</a></div><div>{parts}<ul><li>{i % 3}</li></ul></div></body>"))
    rows.append((99, "http://a.org/copy", rows[0][2]))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = {}
    for _, url, page in rows:
        blocks, elements = html_tree.parsed(page)
        body = "\n".join(t for _, t, e in blocks if not e.never)
        for e in elements:
            if e.block:
                node = seen.setdefault((url[7:12], e.key), (set(), {}, {}))
                node[0].add(body)
                node[1].setdefault(" ".join(html_tree.shape(e)), set()).add(body)
        for top, t, _ in blocks:
            seen[url[7:12], top.key][2].setdefault(t, set()).add(body)
    want = {}
    for key, (bodies, shapes, texts) in seen.items():
        m, counts = len(bodies), [len(s) for s in shapes.values()]
        shape = min(1.0, -sum(c / sum(counts) * np.log(c / sum(counts)) for c in counts) / np.log(m))
        content = 1 - min(1.0, np.mean([np.log(len(s)) / np.log(m) for s in texts.values()])) if texts else None
        want[key] = m, shape if content is None else 0.1 * shape + 0.9 * content
    got = {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in html_tree.style_tree(pages).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_the_tree_finds_articles_without_names_or_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", ' class="[^"]*"', ""), "<(/?)(article|nav|footer)", "<$1div"))
    texts = lambda df, **kw: {r["page_id"]: r["text"] for r in html_tree.main_texts(df, **kw).collect()}
    want, got, off = texts(pages), texts(bare), texts(bare, min_pages=10**9)
    host = {r["page_id"]: r["host"] for r in pages.select("page_id", html_tree.host_of(F.col("url")).alias("host")).collect()}
    known = [k for k in want if sum(h == host[k] for h in host.values()) >= 6]  # few pages tell nothing
    assert len(known) > 100 and sum(got[k] == want[k] for k in known) >= 0.95 * len(known)
    assert sum(off[k] == want[k] for k in want) < 0.05 * len(want)
    assert all(set(want[k].split("\n")) <= set(off[k].split("\n")) for k in want)


def test_token_scan(spark, docs, rows, empty, tmp_path):
    got = sorted(map(tuple, token_scan.counted(docs).select("ordinal", "start", "n_tokens").collect()))
    sizes = {}
    for r in rows:
        sizes.setdefault(r[0], []).append(len(WORD.findall(r[1] or "")))
    assert [g[0] for g in got] == list(range(len(rows)))
    assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(got, got[1:], strict=False))
    assert sorted(g[2] for g in got) == sorted(n for v in sizes.values() for n in v)
    assert token_scan.counted(empty).count() == 0
    ids = np.array([5, 5, 0, 0, 7, 7, 7, 7, 7, 7, 7, 0, 9, 9], "<u2")
    (tmp_path / "flat").mkdir()
    for i, (a, b) in enumerate(((0, 2), (2, 2), (2, 9), (9, 14))):
        ids[a:b].tofile(tmp_path / f"flat/part-{i:05d}")
    got = sorted(map(tuple, token_scan.scan(spark, f"file://{tmp_path}/flat", block=3).collect()))
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 7, True), (3, 12, 2, False)]


def _plain_taken(rows, block, cycle=(1, 2, 3), most=3):
    """Words that a mix takes of each row (key, text, source): blocks of words laid out and slots filled one by one."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    words = {s: [k for k, _, n in sorted(((k, k[0], len(WORD.findall(t or ""))) for k, t, q in rows if q == s), key=lambda z: (z[0][0] is not None, z[0][0] or 0, z[2])) for _ in range(n)] for s in names}
    total, target = sum(map(len, words.values())), {}
    share = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target.update({s: 0.0 for s in names if not words[s]})
    left = [s for s in names if words[s]]
    rest = float(total)
    while left:
        part = {s: rest * share[s] / sum(share[q] for q in left) for s in left}
        above = [s for s in left if part[s] > most * len(words[s])]
        target.update({s: most * len(words[s]) for s in above} if above else part)
        rest -= sum(most * len(words[s]) for s in above)
        left = [s for s in left if s not in target]
    taken = dict.fromkeys((r[0] for r in rows), 0)
    for i, s in enumerate(names):
        w, n = words[s], int(np.floor(target[s] + 0.5))
        blocks = -(-len(w) // block) if w else 0
        slots = n // len(w) * blocks + -(-(n % len(w)) // block) if w else 0
        for j in range(slots):
            turn, at = divmod(j, blocks)
            if at < len(w) // block:
                at = int(mixing.permuted(np.array([at]), len(w) // block, (1_000_003 + i) * 101 + turn)[0])
            cut = (n % len(w) - 1) % block + 1 if j == slots - 1 and n % len(w) else block
            for k in w[at * block : min(at * block + cut, (at + 1) * block)]:
                taken[k] += 1
    return target, taken


def test_mix_equals_plain_layout(docs, rows):
    keyed = [((r[0], i), r[1], r[3]) for i, r in enumerate(rows)]
    target, taken = _plain_taken(keyed, 16)
    got = mixing.taken_words(mixing.mix(docs, block=16, shard_slots=32)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["taken"]) for r in got) == sorted((k[0] is not None, k[0] or 0, len(WORD.findall(t or "")), taken[k]) for k, t, _ in keyed)
    assert sorted(round(r["target"], 6) for r in got) == sorted(round(target[s], 6) for _, _, s in keyed)


def _plain_scores(stats, labels):
    """Scores of a quadratic discriminant on ``stats`` {id: vector}, fitted on ``labels`` {id: 0 or 1}."""
    names = quality_qda.NAMES
    d, parts = len(names), []
    x = {k: np.array([stats[i] for i, q in labels.items() if q == k]) for k in (0, 1)}
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x.values()) / sum(map(len, x.values()))
    for v in x.values():
        cov = (1 - quality_qda.POOL) * np.cov(v.T, bias=True) + quality_qda.POOL * pooled
        cov = (1 - quality_qda.RIDGE) * cov + (quality_qda.RIDGE * np.trace(cov) / d + quality_qda.FLOOR) * np.eye(d)
        parts.append((v.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1], len(v)))
    out = {}
    for i, v in stats.items():
        dens = [-0.5 * (v - m) @ c @ (v - m) - 0.5 * s + np.log(n) for m, c, s, n in parts]
        out[i] = 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -500, 500)))
    return out


def _stats_and_labels(spark, d, rows):
    stats = {r["doc_id"]: np.array([r[c] for c in quality_qda.NAMES]) for r in quality_qda.measured(rows).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in stats}
    return stats, labels


def test_fit_of_the_discriminant_equals_plain_one(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = _plain_scores(*_stats_and_labels(spark, d, docs))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op5_quadratic_discriminant"](spark, d).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_fingerprints_estimate_true_containment(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    order = sorted(texts)
    shingles = lambda t: {t[i : i + sketch.WIDTH] for i in range(max(1, len(t) - sketch.WIDTH + 1))} if t else set()
    errors = []
    for r in sketch.fingerprints(docs).collect():
        own, nxt = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        a, b = shingles(own), shingles(nxt)
        if min(len(a), len(b)) > 800:  # fifty hashes and more
            errors.append(r["near_next"] - len(a & b) / min(len(a), len(b)))
            c = shingles(sketch.edited(own.decode(), nxt.decode()).encode())
            errors.append(r["near_edited"] - len(a & c) / min(len(a), len(c)))
            assert abs(len(r["fingerprint"]) / 8 / (len(a) / 16) - 1) < 0.6
    assert len(errors) > 50 and np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02


def test_pipeline_stages(spark, docs, empty):
    """Each stage's rows against a plain version, on the rows that the stage before it kept."""
    import tiktoken

    d = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "personal_data", "source_mix", "bpe_tokens"]
    now, none, kept = spark.read.parquet(f"{d}/documents.parquet"), empty, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append((now, now.collect()))
        now, none = corpus_pipeline.stored(stage(spark, now, d)), stage(spark, none.select(*corpus_pipeline.COLUMNS), d)
        assert none.count() == 0
        if i < 4:
            assert now.columns == corpus_pipeline.COLUMNS
            none = none.select(*corpus_pipeline.COLUMNS)
    kept.append((now, now.collect()))
    rows = [r for _, r in kept]
    by_id = [{r["doc_id"]: r for r in part} for part in rows]
    # quality: what a plain discriminant accepts, as it was
    scores = _plain_scores(*_stats_and_labels(spark, d, kept[0][0]))
    assert by_id[1] == {k: r for k, r in by_id[0].items() if round(scores[k], 9) >= 0.3}
    # near duplicates: the least id of each group of all pairs' links, as it was
    sets = {}
    for k, r in by_id[1].items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or ""))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[a]:
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert by_id[2] == {k: r for k, r in by_id[1].items() if root(k) == k}
    # personal data: every span of the text, base ones and others, replaced by its kind
    weights = pii.trained(kept[2][0])
    for k, r in by_id[2].items():
        text, at, out = r["text"] or "", 0, []
        for kind, s, e in sorted(pii.spans_of(text, weights)[1], key=lambda z: (z[1], -z[2])):
            if s >= at:
                out += [text[at:s], f"<{pii.KINDS[kind]}>"]
            at = max(at, e)
        assert by_id[3][k]["text"] == "".join([*out, text[at:]]) and pii.matches(by_id[3][k]["text"])[0] == []
    assert by_id[3].keys() == by_id[2].keys()
    # the mix: each document's words in all passes are as many as a plain layout takes of it, and its own
    _, taken = _plain_taken([((r["doc_id"], 0), r["text"], r["source"]) for r in rows[3]], mixing.BLOCK)
    words = {k: 0 for k in by_id[3]}
    for r in rows[4]:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        own = WORD.findall(by_id[3][r["doc_id"]]["text"])
        assert set(WORD.findall(r["text"])) <= set(own) and r["source"] == by_id[3][r["doc_id"]]["source"]
    assert words == {k: taken[k, 0] for k in words}
    # tokens: the library's ids of each row's text
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.read_ranks(open(P.path("byte_bpe_50k.tiktoken")).read()), special_tokens={})
    want = sorted((r["doc_id"], r["source"] or "", library.encode_ordinary(r["text"])) for r in rows[4])
    assert sorted((r["doc_id"], r["source"] or "", r["ids"]) for r in rows[5]) == want and all(r["n_tokens"] == len(r["ids"]) for r in rows[5])


def test_pipeline_on_rows_with_nulls_repeats_and_clashing_columns(spark, docs, rows):
    d = "/root/testdata/sf0.001"
    now, counts = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, d))
        counts.append(now.count())
    assert counts[0] <= len(rows) and counts[0] >= counts[1] == counts[2] and counts[3] == counts[4] > 0
    given = {r[0] for r in rows}
    assert {r["doc_id"] for r in now.collect()} <= given


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, d).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
