"""The plain functions below the operators, against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from lumastack.llm import bpe_fst, html_tree, mixing, near_dup, pii, records, sketch, textops
from lumastack.llm.chunked import ChunkEncoder

TEXTS = ["", " ", "a", "a b", "The cat sat on the mat.\nThe cat sat on the mat.", "é ß 日本 🎉", "x\x0b\x0cy\tz", "A" * 3000, " lead", "end ", "a  b   c", "\n \n x", "a \n b", "don't 's", None]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_slices():
    column, seen = pa.array(TEXTS * 3), []
    for row, offsets, data in textops.text_slices(column, 50):
        starts, ends, rows = textops.word_spans(offsets, data)
        assert row == len(seen)
        found = [[] for _ in range(len(offsets) - 1)]
        for s, e, r in zip(starts, ends, rows, strict=True):
            found[r].append(bytes(data[s:e]).decode())
        seen += found
    assert seen == [WORD.findall(t or "") for t in TEXTS * 3]
    assert list(textops.text_slices(pa.array([], pa.string()))) == []


def test_span_hashes_depend_on_bytes_alone():
    data = np.frombuffer(b"abc abd abc", np.uint8)
    h = textops.span_hashes(data, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1]


def _sets(texts, k):
    out = []
    for _, sets, offsets in near_dup.shingle_sets(pa.array(texts, pa.string()), k):
        out += [set(sets[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def test_shingle_sets():
    for text, s in zip(TEXTS, _sets(TEXTS, 4), strict=True):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        assert len(s) == (len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}) if len(w) >= 4 else int(bool(w)))


def test_superminhash_estimates_jaccard():
    rng, err = np.random.default_rng(5), []
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 400
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64)])) for _ in range(2))
        s = near_dup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
        err.append(abs((s[0] == s[1]).mean() - len(common) / (len(a) + len(b) - len(common))))
        assert (np.sort(s[0].astype(int)) >= 0).all() and np.isfinite(s).all()
    assert max(err) < 0.15
    few = near_dup.superminhash(np.array([7], np.uint64), np.array([0, 1, 1]), 16)
    assert sorted(few[0].astype(int)) == list(range(16)) and np.isinf(few[1]).all()


def test_transducer_equals_merge_loop_and_library():
    import tiktoken

    ranks_text = open(P.path("byte_bpe_50k.tiktoken")).read()
    ranks = bpe_fst.read_ranks(ranks_text)
    fst, chunks = bpe_fst.made(ranks_text, P.PATTERN, 2000, 50)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcde éñ日🎉\n\t .,!9'") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    decoder = bpe_fst.StreamDecoder(fst.of)
    for text, data in zip(texts, chunks.encode_texts(texts), strict=True):
        ids = np.frombuffer(data, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        k = rng.randint(1, 5)
        parts = [decoder.feed(ids[i : i + k]) for i in range(0, len(ids), k)]
        for part in parts:
            part.decode()  # whole characters only
        assert b"".join(parts) + decoder.close() == text.encode()
    for _ in range(300):
        piece = "".join(rng.choice("aeinothrsl") for _ in range(rng.randint(1, 25))).encode()
        assert [fst.of[i] for i in fst.encode(piece)] == (bpe_fst.merged(ranks, piece) if piece not in ranks else [piece])


def test_stream_decoder_on_broken_bytes():
    d = bpe_fst.StreamDecoder({0: b"\xe6", 1: b"\x97", 2: b"\xa5", 3: b"a", 4: b"\xff"})
    assert [d.feed([0]), d.feed([1]), d.feed([2]), d.feed([0, 3])] == [b"", b"", "日".encode(), b"\xe6a"]
    assert d.feed([4, 0]) + d.close() == b"\xff\xe6"


def test_chunk_encoder_limits():
    e = ChunkEncoder(lambda xs: [[ord(c) for c in x] for x in xs], "<u4", 3)
    for t in ("a b c d", "a b", "x  y", "", " "):
        assert np.frombuffer(e.encode_texts([t])[0], "<u4").tolist() == [ord(c) for c in t]


def test_records_round_trip_and_damage():
    payloads = [b"", b"x", bytes(range(256)) * 9]
    data = b"".join(records.frame(p) + b"\n" for p in payloads)
    at, got = 0, []
    while at < len(data):
        p, at = records.unframe(memoryview(data), at)
        got.append(bytes(p))
    assert got == payloads
    for i in (0, 9, 14, len(data) - 3):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises((ValueError, struct.error)):
            at = 0
            while at < len(bad):
                _, at = records.unframe(memoryview(bytes(bad)), at)
    assert records.masked(0) == 0xA282EAD8


def test_permutations_and_targets():
    for n in (1, 2, 3, 7, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n))
    assert not (mixing.permuted(np.arange(1000), 1000, 1) == mixing.permuted(np.arange(1000), 1000, 2)).all()
    t = mixing.capped_targets(np.array([10, 1000, 1000, 0]), np.array([3.0, 1, 2, 1]), 2010, 3)
    assert t[0] == 30 and t[3] == 0 and abs(t.sum() - 2010) < 1e-9 and abs(t[2] - 2 * t[1]) < 1e-9


def _plain_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            s = m.group()
            d = [c for c in s if c in "0123456789"]
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in s.split("."))) or (k == 2 and 13 <= len(d) <= 19 and pii.luhn("".join(d))) or (k == 3 and 9 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1.23@+-() 9,4") for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["1" * 4000, "a@" * 500, "+1" * 900, "1.2.3.4.5.6.7.8"]
    for t in texts:
        assert pii.matches(t)[0] == _plain_spans(t)


def test_crf_parts_what_patterns_swallow():
    text = "call +1 (826) 555-4081 190.137.223.204 now, card 4111111111111111 5500005555555559 end"
    base, every = pii.spans_of(text, pii.PRIOR)
    assert base == _plain_spans(text) and set(base) <= set(every)
    got = {text[s:e]: k for k, s, e in every}
    assert got == {"+1 (826) 555-4081": 3, "190.137.223.204": 1, "4111111111111111": 2, "5500005555555559": 2}
    assert pii.spans_of("no data here", pii.PRIOR) == ([], []) and pii.spans_of("", pii.PRIOR) == ([], [])
    assert pii.spans_of("year 2024 and 4111111111111112", pii.PRIOR)[1] == []


def test_best_path_equals_exhaustive_search():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randint(1, 7)
        scored = [(i, j, rng.randrange(4), rng.uniform(-2, 3)) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]

        def best(at, scored=scored, n=n):
            if at >= n:
                return 0.0, []
            top = best(at + 1)
            for i, j, k, s in scored:
                if i == at and (rest := best(j))[0] + s > top[0]:
                    top = rest[0] + s, [(i, j, k), *rest[1]]
            return top

        want, got = best(0), pii.best_path(n, scored)
        value = sum(max(s for i, j, k, s in scored if (i, j, k) == g) for g in got)
        assert abs(value - want[0]) < 1e-9 and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_training_finds_what_patterns_and_prior_miss():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    (rows,) = pii._pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))
    read = lambda q: [(pii.KINDS.index(k), int(s), int(e)) for k, s, e in (z.split(":") for z in q.split(","))] if q else []
    halves = [[], []]
    for r in sorted(rows.to_pylist(), key=lambda r: (r["h"], r["piece"])):
        halves[int(r["h"], 16) % 2].append((r["piece"], read(r["spans"])))
    weights = pii.fit(halves[0])
    planted = pii.examples(halves[1], seed=5)
    missed, wrong = {}, {}
    for name, spans in (("base", lambda t: pii.matches(t)[0]), ("prior", lambda t: pii.spans_of(t, pii.PRIOR)[1]), ("trained", lambda t: pii.spans_of(t, weights)[1])):
        missed[name] = sum(len(set(gold) - set(spans(t))) for t, gold in planted)
        wrong[name] = sum(len(set(spans(t)) - set(gold)) for t, gold in planted)
    assert missed["base"] >= missed["prior"] > 4 * missed["trained"] and wrong["trained"] <= wrong["prior"] + 2
    # no span is added to the given texts but numbers that a pattern swallowed
    for t in texts.to_pylist():
        base, every = pii.spans_of(t or "", weights)
        for k, s, e in set(every) - set(base):
            assert any(s < b and e > a for a, b in pii.matches(t)[1]), t[s:e]


def test_crf_gradient():
    atoms, cands = pii.segments("x 4111111111111111 y", 2, 18)
    gold = {(i, j, k) for i, j, k, _ in cands[:1]}
    w = pii.PRIOR * 0.1
    grad, like = pii.gradient(w, len(atoms), cands, gold)
    for f in (0, 1, 2):
        step = np.zeros_like(w)
        step[2, f] = 1e-5
        assert abs((pii.gradient(w + step, len(atoms), cands, gold)[1] - like) / 1e-5 - grad[2, f]) < 1e-3


def test_sketches():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)).encode()
    a, part = sketch.sketch(text), sketch.sketch(text[:5000])
    assert sketch.containment(part, a) > 0.99 and abs(sketch.containment(a, part) - 5000 / len(text)) < 0.1
    assert sketch.likeness(a, a) == 1 and len(sketch.sketch(b"")) == 0 and len(sketch.sketch(b"x")) == 1
    assert sketch.likeness(sketch.sketch(b""), sketch.sketch(b"")) == 1 and sketch.likeness(a, sketch.sketch(b"")) == 0
    assert set(sketch.merged(sketch.sketch(text[:9000]), sketch.sketch(text[9000:]))) <= set(a)
    assert sketch.written(sketch.sketch(text)) == sketch.written(sketch.sketch(bytes(text)))
    assert sketch.edited("abcdefgh", "XYZ") == "abcdefXY" and sketch.edited("abcdefgh", "") == "abcdef"


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; all</h1><p><b>One   two<br><p>Three&nbsp;four<form>Sign</form></p><aside>Side</aside>
<div class="comments"><p>Reader says</p></div><p>Last</article><footer>Foot</footer></body></html>"""


def test_html_blocks():
    blocks, _ = html_tree.parsed(PAGE)
    kept = [t for top, t, e in blocks if not e.never and top.inside]
    assert kept == ["Head & all", "One two", "Three four", "Last"]
    for cut in range(0, len(PAGE), 7):
        html_tree.parsed(PAGE[:cut])  # cut anywhere
    for odd in ("", "plain", "<", "<p", "</p></div>", "<p>a</p", "<a href='x>y", "<script>never ends", "<p>" * 3000):
        html_tree.parsed(odd)
    blocks, elements = html_tree.parsed("<div class='ad'>" * 20_000 + "x</p>" * 50)
    assert len(elements) == 20_001 and all(e.never for _, _, e in blocks)


def test_hash_of_no_spans():
    assert hashlib.sha256(pii._joined([]).encode()).hexdigest().startswith("e3b0c442")


def test_pairs_kept_are_bounded_by_the_limit():
    """A small transducer keeps few pairs too, and still encodes as the merges do."""
    with open(P.path("byte_bpe_50k.tiktoken")) as f:
        ranks = bpe_fst.read_ranks(f.read())
    fst, rng = bpe_fst.Transducer(ranks, 50), np.random.default_rng(3)
    for _ in range(300):
        piece = bytes(rng.integers(97, 123, 12).astype(np.uint8))
        assert [fst.of[i] for i in fst.encode(piece)] == (bpe_fst.merged(ranks, piece) if piece not in ranks else [piece])
    assert len(fst.fits) <= 101
