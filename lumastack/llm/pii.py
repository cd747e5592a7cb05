"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. Stretches of text near digits and at signs are cut into atoms (runs of digits, of letters,
single marks), and a semi-Markov CRF segments each: a segment is a span of at most ``MAX_ATOMS`` atoms with a kind, scored as
a whole by features that no single atom has (how many digits and groups of them, whether a card's check digit holds, whether
each part of an address is in range, whether separators agree, what stands on either side); all other atoms are segments of
kind none with score 0. A candidate needs only the raw matter of its kind (four numbers, an at mark with letters behind it,
so many digits); its form is for the weights to judge. Dynamic programming over bounded segments picks boundaries and kinds
jointly. Segments of the best path that touch no base span are added; base spans always stay.

The weights are trained here, by gradient ascent on the conditional likelihood with forward and backward sums over bounded
segments, on what the patterns miss: base spans of a bounded sample of texts (``TRAIN_ROWS`` texts by hash, of which at most
``SNIPPETS`` pieces of at most ``SNIPPET`` characters are used), also with other separators or marks, with no gap to another
span, and, as examples of no span, cut short, with a wrong check digit or with parts out of range; and stretches of the
same texts that no pattern touches. Without such texts a prior that asks for strict forms is used.

Offsets are code points, ends exclusive. Cases: a null or empty text has no spans; texts of any length are scanned in linear
time; equal texts have equal spans; of segmentations with equal scores the one
with fewer spans, then the first found, counts; repeated rows give a row each; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in order and the patterns of the base.
KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

MAX_ATOMS, ROUNDS, RATE, DECAY = 24, 60, 0.5, 0.002
TRAIN_ROWS, SNIPPETS, SNIPPET = 20_000, 1500, 300
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
_AT = re.compile(r"@|[(\[]at[)\]]")
_DOT = re.compile(r"\.|[(\[](?:dot|\.)[)\]]")
_SEED = re.compile(r"(?:[0-9@+(\[]|at[)\]])(?:[0-9@+().:,;#$%&*!|\"'\x20\[\]_/-]|at[)\]]|dot[)\]])*")
_LIVE = re.compile(r"[0-9@]|at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (kind, start, end) by kind then start, and the spans of dropped matches."""
    found, dropped = [], []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))
        (found.append((1, *m.span())) if good else dropped.append(m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        (found.append((2, *m.span())) if 13 <= len(digits) <= 19 and luhn(digits) else dropped.append(m.span()))
    for m in _PHONE.finditer(text):
        (found.append((3, *m.span())) if 9 <= sum(c.isdigit() for c in m.group()) <= 15 else dropped.append(m.span()))
    return found, dropped


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of digits, at signs and their marks, grown to the ends of the words that they touch; they do not overlap."""
    last = -1
    for m in _SEED.finditer(text):
        a, b = m.span()
        if b <= last or not _LIVE.search(m.group()):
            continue
        while a > 0 and not text[a - 1].isspace() and a > last:
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        yield max(a, last), b
        last = b


FEATURES = ["bias", "valid", "length", "grouping", "usual", "lead", "open_left", "open_right", "spaces", "mixed", "odd", "atoms"]
_USUAL = [".", ".", "- ", "-. ()"]  # fixed values: the marks that each kind usually has between its parts


def features(text: str, start: int, end: int, kind: int, atoms: int) -> np.ndarray | None:
    """The whole-span features of a segment, or None where the raw matter of the kind is not there."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    n = sum(map(len, groups))
    left, right = text[start - 1 : start], text[end : end + 1]
    x = np.zeros(len(FEATURES))
    x[0] = 1
    if kind == 0:
        marks = list(_AT.finditer(span))
        if len(marks) != 1 or not 0 < marks[0].start() or marks[0].end() >= len(span):
            return None
        local, domain = span[: marks[0].start()].strip(), span[marks[0].end() :].strip()
        parts = [q.strip() for q in _DOT.split(domain)]
        x[1] = len(parts) > 1 and all(q and q.isascii() and q.replace("-", "").isalnum() for q in parts) and bool(local) and all(c in _LOCAL for c in local)
        x[2] = 2 <= len(parts[-1]) <= 24 and parts[-1].isalpha()
        x[3], x[4] = len(parts) > 1, marks[0].group() == "@"
        x[5] = bool(local) and local[0].isalnum()
        x[6], x[7] = bool(left) and left in _LOCAL, right.isalnum() or right == "-"
        seps = [m.group() for m in _DOT.finditer(domain)]
        x[8] = any(c.isspace() for c in span)
    else:
        if any(c.isalpha() for c in span):
            return None
        seps = [q for q in re.split(r"[0-9]+", span)[1:-1]]
        x[6] = left.isdigit() or (left in ("+", ".", "-") and kind == 1 and text[start - 2 : start - 1].isdigit()) or left == "+"
        x[7] = right.isdigit() or (kind == 1 and right == "." and text[end + 1 : end + 2].isdigit())
        x[8] = any(len(q) > 1 and q.strip(" ") == "" or q[:1] == q[-1:] == " " and len(q) > 1 for q in seps)
        if kind == 1:
            if len(groups) != 4 or not span[0].isdigit():
                return None
            x[1], x[2] = all(len(g) <= 3 and int(g) <= 255 for g in groups), n >= 5
            x[3], x[5] = all(g == "0" or g[0] != "0" for g in groups), all("." in q for q in seps)
        elif kind == 2:
            if not 13 <= n <= 19 or not span[0].isdigit():
                return None
            x[1], x[2] = luhn("".join(groups)), n in (13, 14, 15, 16, 19)
            x[3] = len(groups) == 1 or all(len(g) == 4 for g in groups[:-1])
            x[5] = groups[0][0] in "23456"
        else:
            if not 7 <= n <= 15 or not (span[0].isdigit() or span[0] in "+("):
                return None
            x[1], x[2] = span[0] == "+" or span.startswith("00"), n in (10, 11, 12, 13)
            x[3] = 3 <= len(groups) <= 6 and max(map(len, groups)) <= 4
            x[5] = span.count("(") == span.count(")") == 1
        x[4] = all(q.strip() in ("", *_USUAL[kind]) or set(q) <= set(_USUAL[kind]) for q in seps)
    plain = {q.strip() or q[:1] for q in seps}
    x[9] = len(plain) > 1
    x[10] = any(len(q) > 3 for q in seps)
    x[11] = 0.1 * atoms
    return x


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, np.ndarray]]]:
    """The atoms of a run, and its candidate segments (first atom, one past the last, kind, features)."""
    atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
    out = []
    for i, (a, _) in enumerate(atoms):
        c = text[a]
        number = c in "0123456789+("
        if not (number or c in _LOCAL):
            continue
        digits = groups = letters = 0
        mark = False
        for j in range(i, min(i + MAX_ATOMS, len(atoms))):
            s, b = atoms[j]
            first = text[s]
            if first.isdigit():
                digits, groups = digits + b - s, groups + 1
            elif first.isalpha():
                letters += 1
                if text[s:b] == "at" and text[s - 1 : s] in ("(", "["):
                    mark = True
                    continue
            elif first == "@":
                mark = True
            if not (first.isdigit() or first.isalpha()):
                continue
            kinds = [0] if mark else []
            if number and not letters and first.isdigit():
                kinds += [1] if groups == 4 and digits <= 12 else []
                kinds += [2] if 13 <= digits <= 19 else []
                kinds += [3] if 7 <= digits <= 15 else []
            for kind in kinds:
                x = features(text, a, b, kind, j + 1 - i)
                if x is not None:
                    out.append((i, j + 1, kind, x))
    return atoms, out


def best_path(n: int, scored: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The segments (first atom, one past the last, kind) of the best segmentation of n atoms."""
    by_end: dict[int, list] = {}
    for i, j, kind, s in scored:
        by_end.setdefault(j, []).append((i, kind, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
    return out[::-1]


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def _packed(cands: list, gold: set) -> tuple:
    """Candidates as (kinds, features, ends to sum over forward and backward, which are gold)."""
    kinds, x = np.array([c[2] for c in cands]), np.array([c[3] for c in cands])
    order = sorted(range(len(cands)), key=lambda q: cands[q][1])
    back = sorted(range(len(cands)), key=lambda q: -cands[q][0])
    return kinds, x, [(q, *cands[q][:2]) for q in order], [(q, *cands[q][:2]) for q in back], np.array([c[:3] in gold for c in cands])


def _gradient(weights: np.ndarray, n: int, packed: tuple) -> tuple[np.ndarray, float]:
    kinds, x, order, back, hit = packed
    score = (weights[kinds] * x).sum(axis=1)
    s = score.tolist()
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    at = 0
    for j in range(1, n + 1):
        v = forward[j - 1]
        while at < len(order) and order[at][2] == j:
            q, i, _ = order[at]
            v = _log_sum(v, forward[i] + s[q])
            at += 1
        forward[j] = v
    at = 0
    for i in range(n - 1, -1, -1):
        v = backward[i + 1]
        while at < len(back) and back[at][1] == i:
            q, _, j = back[at]
            v = _log_sum(v, s[q] + backward[j])
            at += 1
        backward[i] = v
    p = np.zeros(len(s))
    for q, i, j in order:
        p[q] = math.exp(forward[i] + s[q] + backward[j] - forward[n])
    grad = np.zeros_like(weights)
    np.add.at(grad, kinds, (hit - p)[:, None] * x)
    return grad, float(score[hit].sum() - forward[n])


def gradient(weights: np.ndarray, n: int, cands: list, gold: set) -> tuple[np.ndarray, float]:
    """Of the log likelihood of the gold segments (first atom, one past the last, kind) of one run."""
    return _gradient(weights, n, _packed(cands, gold))


# Asks for strict forms, with the usual marks and closed sides; where training starts.
PRIOR = np.array(
    [
        [-9.0, 4.0, 3.0, 1.0, 3.0, 0.5, -6.0, -6.0, -6.0, -1.0, -3.0, 0.0],
        [-11.0, 5.0, 1.0, 1.0, 3.0, 3.0, -6.0, -6.0, -6.0, -4.0, -3.0, 0.0],
        [-10.0, 6.0, 1.0, 1.0, 4.0, 1.0, -6.0, -6.0, -6.0, -4.0, -3.0, 0.0],
        [-10.0, 6.0, 2.0, 1.0, 3.0, 0.5, -6.0, -6.0, -6.0, 0.0, -3.0, 0.0],
    ]
)


def varied(kind: int, span: str, rng: random.Random) -> str:
    """A base span as a pattern would miss it: with other separators or marks."""
    if kind == 0:
        local, _, domain = span.partition("@")
        at = rng.choice(["(at)", "[at]", " @ ", "@ "])
        dot = rng.choice([".", "(dot)", "[.]"]) if at[0] in "([" else "."
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice([". ", " . ", "[.]", " ."]))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        return rng.choice([".", "/", "  ", " - ", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    head, tail = digits[:-10], digits[-10:]
    parts = [tail[:3], tail[3:6], tail[6:]]
    lead = rng.choice(["00" + head + " ", "+" + head + "/", "+" + head + "  "]) if head else "+"
    return lead + rng.choice(["/", ".", " / ", "  "]).join(parts)


def spoilt(kind: int, span: str, rng: random.Random) -> str:
    """What looks like a base span and is none."""
    if kind == 0:
        local, _, domain = span.partition("@")
        return rng.choice([f"{local}@{domain.partition('.')[0]}", f"{local} (at {domain})", f"@{domain}"])
    if kind == 1:
        parts = span.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return rng.choice([".".join(parts), ",".join(span.split(".")), "-".join(span.split(".")), " ".join(span.split("."))])
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        i = rng.randrange(len(digits))
        wrong = digits[:i] + str((int(digits[i]) + rng.randint(1, 9)) % 10) + digits[i + 1 :]
        return rng.choice([wrong, digits[: rng.randint(8, 12)], " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4))])
    return rng.choice([digits[: rng.randint(4, 6)], " ".join(digits), f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"({digits[:3]}) {digits[3:6]}"])


def examples(pieces: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, gold spans): the pieces as they are, and with their spans varied, joined to another one, or spoilt."""
    rng, out = random.Random(seed), []
    held = [(k, text[s:e]) for text, spans in pieces for k, s, e in spans]
    for text, spans in pieces:
        out.append((text, spans))
        for k, s, e in spans:
            before, span, after = text[max(0, s - 40) : s], text[s:e], text[e : e + 40]
            if any(a < s and b > s - 40 or a < e + 40 and b > e for _, a, b in spans if (a, b) != (s, e)):
                before, after = "of ", " and"
            new = varied(k, span, rng)
            out.append((before + new + after, [(k, len(before), len(before) + len(new))]))
            ok, other = rng.choice(held)
            glue = rng.choice([" ", ", ", "/", "; "])
            at = len(before) + len(span) + len(glue)
            out.append((before + span + glue + other + after, [(k, len(before), len(before) + len(span)), (ok, at, at + len(other))]))
            out.append((before + spoilt(k, span, rng) + after, []))
    return out


def training_runs(labelled: list[tuple[str, list[tuple[int, int, int]]]]) -> list[tuple[int, list, set]]:
    """(atoms, candidates, gold) of the stretches of labelled texts; those that cannot express their gold are left out."""
    out = []
    for text, spans in labelled:
        for a, b in runs(text):
            atoms, cands = segments(text, a, b)
            if not cands:
                continue
            first, last = {s: i for i, (s, _) in enumerate(atoms)}, {e: i + 1 for i, (_, e) in enumerate(atoms)}
            inside = [(k, s, e) for k, s, e in spans if s < b and e > a]
            gold = {(first.get(s), last.get(e), k) for k, s, e in inside}
            if gold <= {c[:3] for c in cands}:
                out.append((len(atoms), cands, gold))
    return out


def fit(pieces: list[tuple[str, list[tuple[int, int, int]]]], *, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights (kind x feature) from pieces of text with their base spans, pulled towards the prior."""
    data, weights = [(n, _packed(cands, gold)) for n, cands, gold in training_runs(examples(pieces))], PRIOR.copy()
    if not data:
        return weights
    for _ in range(rounds):
        grad = sum(_gradient(weights, *run)[0] for run in data) / len(data)
        weights += rate * (10 * grad - decay * (weights - PRIOR))
    return weights


def added(text: str, weights: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Segments of the best paths that touch no base span."""
    out = []
    for a, b in runs(text):
        atoms, cands = segments(text, a, b)
        if cands:
            for i, j, kind in best_path(len(atoms), [(i, j, k, float(weights[k] @ x)) for i, j, k, x in cands]):
                s, e = atoms[i][0], atoms[j - 1][1]
                if all(e <= x or s >= y for _, x, y in base):
                    out.append((kind, s, e))
    return out


_DIGIT = re.compile(r"[0-9@]|at[)\]]")


def spans_of(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, by kind then start."""
    if not _DIGIT.search(text):
        return [], []
    base = matches(text)[0]
    return base, sorted(base + added(text, weights, base))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _found(weights: np.ndarray) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                base, every = spans_of(value.as_py() or "", weights)
                rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            counts = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(counts, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return task


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of text around base spans, and stretches near which no pattern found or dropped a match, with a hash each."""
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            found, dropped = matches(text) if _DIGIT.search(text) else ([], [])
            for a, b in [(s, e) for _, s, e in found] or list(runs(text)):
                a, b = max(0, a - 40), b + 40
                # a dropped match that no span explains may hide personal data: it is no example of none
                unclear = any(s < b and e > a and e - s > 6 and not any(x < e and y > s for _, x, y in found) for s, e in dropped)
                if b - a <= SNIPPET and not unclear:
                    spans = [(k, s - a, e - a) for k, s, e in found if s >= a and e <= b]
                    rows.append((text[a:b], _joined(spans), hashlib.blake2b(text[a:b].encode(), digest_size=8).hexdigest(), bool(spans)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["piece", "spans", "h", "held"])


def trained(docs: DataFrame, *, rows: int = TRAIN_ROWS, snippets: int = SNIPPETS) -> np.ndarray:
    """Weights from about ``rows`` texts, chosen by hash: ``snippets`` pieces with base spans and as many without."""
    n = docs.count()
    chosen = docs.select("text", F.xxhash64("doc_id").alias("h"))
    if n > rows:
        chosen = chosen.where(F.col("h") < int(-(2**63) + 2**64 * (rows / n)))
    found = chosen.select("text").mapInArrow(_pieces, "piece string, spans string, h string, held boolean").distinct()
    pieces = [r for held in (True, False) for r in found.where(F.col("held") == held).orderBy("h", "piece").limit(snippets).collect()]
    read = lambda x: [(KINDS.index(k), int(s), int(e)) for k, s, e in (q.split(":") for q in x.split(","))] if x else []
    return fit([(r["piece"], read(r["spans"])) for r in pieces])


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; the counts are of base spans."""
    weights = trained(docs) if weights is None else weights
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found(weights), "doc_id long, " + schema)


def _redacted(weights: np.ndarray) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    parts, at = [], 0
                    for k, s, e in sorted(spans_of(text, weights)[1], key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            parts += [text[at:s], f"<{KINDS[k]}>"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return task


def redacted(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets; nulls stay."""
    weights = trained(docs) if weights is None else weights
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_redacted(weights), schema)
