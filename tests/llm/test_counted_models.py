"""Personal data, source divergence and centroid clustering against plain Python on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import clustering, divergence, personal

DOCS = "doc_id long, text string, lang string, source string, kind string, row long, found long, n long, p long, term string, spans string"


def sha(raw: str) -> str:
    return hashlib.sha256(raw.encode()).hexdigest()


def table(spark, rows: list[tuple]):
    """(doc_id, text, lang, source), beside columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 1, 1, 1, "x", "x") for r in rows], DOCS)


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def brute_base(text: str) -> list[tuple]:
    plain = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 13 <= len(plain(m)) <= 19 and luhn(plain(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(plain(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def personal_texts() -> list:
    draw = random.Random(11)
    bits = ["a@b.cd", "@", "+1 (212) 555-0199", "1.2.3.4", "4111 1111 1111 1111", ".", " ", "-", "5", "é", "🙂", "x", "+", "\n", "(", "256.1.1.1", "x@y", ".com", "00", "_", "%"]
    out = [None, "", " ", "a@b.c_d@e.fg", "1.2.3.4.5.6.7.8", "0000255.1.1.1 999.1.1.1", "4111-1111 1111-1111 4111111111111112", "+49 30 123456 +12 3", "é🙂 me@example.org 🙂"]
    out += ["".join(draw.choice(bits) for _ in range(draw.randint(1, 40))) for _ in range(400)]
    out += ["1" * 60_000, "a" * 60_000 + "@b.de", "1 " * 30_000, "1." * 40_000, "+1" + "(" * 60_000, "a.b-" * 20_000, "a@b.cd " * 3_000]
    out += [f"write to kim{k} [at] site [dot] org now, or call {k}12 555 01{k}7 after six" for k in range(10, 30)]
    out += [f"mail kim.{k}@site{k}.example.com or call +1 (212) 555-01{k}, from host 88.1.{k}.7" for k in range(10, 60)]
    return out


def test_personal_findings_and_added_spans(spark):
    own = personal_texts()
    rows = [(k, t, "en", "a") for k, t in enumerate(own)] + [(None, own[8], None, None), (None, None, None, None), (3, own[3], "en", "a"), (3, own[3], "en", "a")]
    want = Counter()
    for doc, text, *_ in rows:
        found = brute_base(text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want[doc, *(sum(k == kind for k, *_ in found) for kind in personal.BASE), sha(told)] += 1
    made = personal.digests(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in made) == want
    added = 0
    for r in made:
        found = brute_base(own[r.doc_id] or "") if r.doc_id is not None else []
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1]))
        if r.doc_id is not None:
            assert set(found) <= set(spans)
            extra = [s for s in spans if s not in found]
            assert not any(a < y and x < b for _, a, b in extra for _, x, y in found)
            added += len(extra)
    assert added
    clean = personal.digests(table(spark, [(1, "No digits here, nor signs.", "en", "a"), (2, "In 1999 it cost 20 % more.", "en", "a")])).collect()
    assert [r.spans for r in clean] == ["", ""]


def test_votes_are_weighed_by_expectation_maximisation(spark):
    """Reliabilities and scores against the same recurrences in numpy."""
    draw = np.random.default_rng(5)
    truth = draw.random(400) < 0.4
    right = np.array([0.9, 0.8, 0.75, 0.7, 0.6, 0.95])
    cast = draw.random((400, 6)) < 0.8
    votes = np.where(cast, np.where(draw.random((400, 6)) < right, truth[:, None], ~truth[:, None]) + 1, 0)
    features = draw.integers(0, 4, 400) + 4 * truth
    rows = Counter((2, int(v @ 3 ** np.arange(6)), int(f)) for v, f in zip(votes, features, strict=True))
    counts = spark.createDataFrame([(*k, n) for k, n in rows.items()], "kind int, votes int, features int, n long")
    prior, on, off = 0.5, np.full(6, 0.8), np.full(6, 0.8)

    def posterior():
        odds = np.log(prior / (1 - prior)) + np.where(votes == 2, np.log(on / (1 - off)), np.where(votes == 1, np.log((1 - on) / off), 0)).sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(personal.ROUNDS):
        t = posterior()
        new = (t.sum() + 1) / (len(t) + 2)
        on_new = ((t[:, None] * (votes == 2)).sum(axis=0) + 8) / ((t[:, None] * (votes > 0)).sum(axis=0) + 10)
        off = (((1 - t)[:, None] * (votes == 1)).sum(axis=0) + 8) / (((1 - t)[:, None] * (votes > 0)).sum(axis=0) + 10)
        prior, on = new, on_new
    models = personal.reliabilities(counts)
    model = models.first()["model"]
    assert np.allclose([model["prior"], *model["on"], *model["off"]], [prior, *on, *off])
    assert np.abs(on - right).max() < 0.12 and ((posterior() > 0.5) == truth).mean() > 0.9
    x = np.c_[np.ones(400), features[:, None] >> np.arange(10) & 1]
    w, t = np.zeros(11), posterior()
    for _ in range(personal.STEPS):
        w = w + 4 / 11 / 400 * (x.T @ (t - 1 / (1 + np.exp(-x @ w))) - personal.RIDGE * w)
    want = {int(f): 1 / (1 + np.exp(-r @ w)) for f, r in zip(features, x, strict=True)}
    got = {r.features: r.score for r in personal.classifier(counts, models).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], abs_tol=1e-5) for f in want)


# divergence of sources

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows: list[tuple], min_docs: int, top: int) -> Counter:
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [m.translate(LOWER) for m in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        p = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: share(counts[lang, s][t], n) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            words = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                for rank, (value, _, item) in enumerate(found, 1):
                    out[lang, s, part, item, -value, rank] += 1
    return out


def audit_rows() -> list[tuple]:
    draw = random.Random(6)
    words = ["Der", "der", "É", "é", "ÉA", "漢字", "x_y", "a1b", "🙂", "don't", "AT", "at", *(f"w{chr(97 + k)}{chr(97 + k // 2)}" for k in range(20))]
    rows = [(k, " ".join(draw.choice(words[: 8 + k % 24]) for _ in range(draw.randint(0, 60))), ["en", "de", None][k % 3], ["s", None, "t", "é", "z"][k % 5]) for k in range(200)]
    rows += [(None, None, "en", "s"), (None, "", "fr", "only"), (7, "der der", "xx", "a"), (7, "der der", "xx", "a"), (8, None, "xx", "b"), (9, "W" * 5000 + " tail", "en", "s")]
    return rows + [(10, "at der " * 4000, "en", "t")] * 2


@pytest.mark.parametrize(("digest_bits", "cells", "strip"), [(64, 1 << 17, 256), (3, 1 << 17, 256), (0, 64, 2)])
def test_divergence(spark, monkeypatch, digest_bits, cells, strip):
    """Also with digests so short that terms share them, small blocks, and counts written early."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "STRIP", strip)
    monkeypatch.setattr(divergence, "HELD", 50 if digest_bits < 64 else 400_000)
    monkeypatch.setattr(divergence, "SEND_ROWS", 2 if digest_bits == 3 else 500_000)
    rows = audit_rows()
    made = divergence.audit(table(spark, rows), min_docs=12, top=7, digest_bits=digest_bits).collect()
    assert Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in made) == brute_audit(rows, 12, 7)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    for text in ("", "   ", "abc", "a bc  def ghijklmnop q", "ABCDEFGHIJ klm", "é漢字 x1y " * 20, "a" * 50):
        plain = [t.translate(LOWER).encode() for t in TERM.findall(text)]
        assert [t for some in divergence.pieces(text.encode()) for t in some] == plain


def test_shares_are_exact(spark):
    cases = [(5, 5), (6, 7 * 10**12), (10**13, 10**13 + 1), (123456789, 987654321987), (0, 5)]
    frame = spark.createDataFrame(cases, "c long, d long").select("c", "d", divergence.share(F.col("c"), F.col("d")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.c // r.d for r in frame.collect())


# clusters

VECTORS = "vec_id long, embedding array<float>, cluster string, v long, key string, distance long"


def brute_clusters(rows: list[tuple], k: int, rounds: int, dimension: int) -> Counter:
    limit = clustering.LIMIT
    fits = lambda v: v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    own = [(i, [max(-limit, min(limit, math.floor(64 * float(np.float32(x))))) for x in v]) for i, v in rows if fits(v)]
    seeds = sorted((sha(f"1:{'' if i is None else i}"), v) for i, v in own)
    centres = [v for _, v in seeds[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in own]
        for c in set(at):
            mine = [v for (_, v), a in zip(own, at, strict=True) if a == c]
            centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in own]
    per = Counter()
    for _, d, c in last:
        per[c] += d
    return Counter((i, c, d, per[c], sum(per.values()), sha(",".join(map(str, centres[c])))) for i, d, c in last)


@pytest.mark.parametrize("rows_of_table", [4096, 3])
def test_clusters(spark, monkeypatch, rows_of_table):
    """Ties, repeated rows, null and repeated identifiers, awkward vectors; also with tables too small for the range."""
    monkeypatch.setattr(clustering, "TABLE_ROWS", rows_of_table)
    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in draw.normal(k % 5, 0.6, 4)]) for k in range(300)]
    rows += [(1000, [0.0] * 4), (1000, [0.0] * 4), (1000, [1.0] * 4), (None, [0.5, -0.5, 2.0, -3.0]), (None, [0.5, -0.5, 2.0, -3.0])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 1.0, 1.0]), (2004, [math.nan, 1.0, 1.0, 1.0]), (2005, [math.inf, 0.0, 0.0, 0.0]), (2006, [-0.001, 0.001, -0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], VECTORS)
    made = clustering.report(frame, k=7, dimension=4).collect()
    assert Counter(tuple(r) for r in made) == brute_clusters(rows, 7, 3, 4)
    few = [(1, [1e30, 0.0, -1e38, 2.0]), (2, [0.0] * 4), (3, [0.0] * 4)]
    made = clustering.report(spark.createDataFrame([(*r, "x", 1, "x", 1) for r in few], VECTORS), k=7, dimension=4).collect()
    assert Counter(tuple(r) for r in made) == brute_clusters(few, 7, 3, 4)
