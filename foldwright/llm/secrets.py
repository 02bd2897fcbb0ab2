"""Secret scan: fixed patterns, and a small character convolution over every other candidate.

Candidates are runs of at least 6 key characters with a digit, or of any such characters as a value (after a colon or
equals sign, a space or quote between or not); each is read over its whole length with the characters
around it. The network (one convolution, maximum over places, one linear unit) reads long ones in windows that
overlap, so that every place of the convolution is in one of them, and joins their maxima. It is trained on the candidates of
all documents, every different window once, whose labels are the patterns' own findings: a candidate in a finding is a secret,
any other is not. Windows are dealt by hash into buckets; a bucket trains in numpy in one task, and the nets of a round's buckets
are averaged. A third of the windows is held back to calibrate the scores and to set the threshold: the highest that still finds
``RECALL`` of all held-back secrets, from counts of all held-back windows per step of ``GRAIN``. All documents and all candidates
are then scored; a candidate above the threshold that touches no finding is added as ``cnn``. Without secrets or without others,
nothing is added.

Null text is empty: no findings. Offsets count code points. Repeated rows are scanned alike; other columns
are not read; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import map_text, text_of
from foldwright.session import materialise

KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: the same as runs of hex digits of which short ones are dropped
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"""(?<![A-Za-z0-9+/_.=-])(?:(?=[A-Za-z+/_.=-]*[0-9])|(?=[A-Za-z+/_.-]*=[A-Za-z+/_.-]{6})|(?<=:)|(?<=[:=][\x20"'])|(?<=[:=]\x20["']))[A-Za-z0-9+/_.=-]{6,}""")
#: About so many windows are trained in one task; more are gone through in so many rounds, each on its own part of them.
BUCKET, ROUNDS = 2048, 4
#: Windows that training goes through in all while there are few, the least and most times it goes through one.
VISITS, TIMES = 16_384, (3, 12)
#: Held-back windows are counted per step of this size in the net's sums, up to ``FAR`` on either side.
GRAIN, FAR = 1 / 256, 100
RECALL = 0.98
#: Characters before a candidate, at least of it (shorter ones are filled up), and after it.
BEFORE, CORE, AFTER = 20, 48, 8
WIDTH, FILTERS, EMBED = 5, 16, 8
#: Codes that the network reads at once.
SPAN = BEFORE + CORE + AFTER


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a finding touches it)."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    out = []
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # findings that begin before the candidate ends
        out.append((m.start(), m.end(), before > 0 and ends[before - 1] > m.start()))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a whole candidate in its surroundings, at least ``SPAN``; a candidate's codes are over 128."""
    core = text[start:end]
    left, right = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
    raw = (left + core.ljust(CORE, "\0") + right).encode("utf-32-le", "surrogatepass")
    code = np.minimum(np.frombuffer(raw, np.uint32), 127).astype(np.int16)
    code[BEFORE : BEFORE + len(core)] += 128
    return code


def cut(codes) -> tuple[np.ndarray, np.ndarray]:
    """The candidates' windows of ``SPAN`` codes, and the number of each candidate's first one.

    Neighbours share ``WIDTH`` - 1 codes, so no place of the convolution is lost; the last ends where its candidate's codes end.
    """
    made, first, n = [], [], 0
    for c in codes:
        part = c[None] if len(c) == SPAN else c[np.r_[0 : len(c) - SPAN : SPAN - WIDTH + 1, len(c) - SPAN][:, None] + np.arange(SPAN)]
        made.append(part)
        first.append(n)
        n += len(part)
    return np.concatenate(made) if made else np.zeros((0, SPAN), np.int16), np.array(first, np.int64)


def ragged(rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(rows), object)
    for i, row in enumerate(rows):
        out[i] = row
    return out


class CharNet:
    """Embedding, convolution, ReLU, maximum over places, linear unit; plain numpy, trained by Adam."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.p = {
            "embed": draw.normal(0, 0.5, (256, EMBED)), "conv": draw.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), "cb": np.zeros(FILTERS),
            "out": draw.normal(0, 0.3, FILTERS), "ob": np.zeros(1), "scale": np.ones(1), "shift": np.zeros(1),
        }
        self.threshold = 2.0

    def _forward(self, codes):
        """Windows, for each candidate and filter the window and place of the maximum, the maximum; and the candidates' sums."""
        windows, first = cut(codes)
        if not len(first):
            return windows, np.zeros((0, FILTERS), np.int64), np.zeros((0, FILTERS), np.int64), np.zeros((0, FILTERS)), np.zeros(0)
        places, tops = [], []
        for k in range(0, len(windows), 512):
            x = self.p["embed"][windows[k : k + 512]]
            patch = np.concatenate([x[:, j : SPAN - WIDTH + 1 + j] for j in range(WIDTH)], axis=2)
            conv = patch @ self.p["conv"] + self.p["cb"]
            places.append(conv.argmax(1))
            tops.append(np.take_along_axis(conv, places[-1][:, None], 1)[:, 0])
        place, each = np.concatenate(places), np.concatenate(tops)
        top = np.maximum.reduceat(each, first)
        own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(windows)]))
        at = np.minimum.reduceat(np.where(each == top[own], np.arange(len(windows))[:, None], len(windows) - 1), first)
        return windows, at, np.take_along_axis(place, at, 0), top, np.maximum(top, 0) @ self.p["out"] + self.p["ob"][0]

    def score(self, codes) -> np.ndarray:
        """Calibrated probabilities."""
        return self._curve(self._forward(codes)[4])

    def _curve(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.p["scale"][0] * logit + self.p["shift"][0], -50, 50)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, rounds: int = 12, rate: float = 0.01, batch: int = 64, seed: int = 5, counts: tuple[int, int] | None = None) -> CharNet:
        """``counts``: secrets and others in all, of which these may be a part; both labels weigh the same in all."""
        draw = np.random.default_rng(seed)
        n1, n0 = counts or (labels.sum(), (~labels).sum())
        weigh = np.where(labels, 0.5 / max(1, n1), 0.5 / max(1, n0)) * (n1 + n0)
        names = ("embed", "conv", "cb", "out", "ob")
        m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for _ in range(rounds):
            for rows in np.array_split(draw.permutation(len(labels)), max(1, len(labels) // batch)):
                windows, where, place, top, logit = self._forward(codes[rows])
                error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[rows]) * weigh[rows] / len(rows)
                g_top = error[:, None] * self.p["out"] * (top > 0)
                g = {"out": np.maximum(top, 0).T @ error, "ob": np.array([error.sum()]), "cb": g_top.sum(0)}
                seen = windows[where[:, :, None], place[:, :, None] + np.arange(WIDTH)]
                at = self.p["embed"][seen].reshape(len(rows), FILTERS, WIDTH * EMBED)
                g["conv"] = np.einsum("nf,nfd->df", g_top, at)
                back = (g_top[:, :, None] * self.p["conv"].T).reshape(len(rows), FILTERS, WIDTH, EMBED)
                g["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(g["embed"], seen.ravel(), back.reshape(-1, EMBED))
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> CharNet:
        return self.settle(self._forward(codes)[4], labels, np.ones(len(labels)), recall)

    def settle(self, logit: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float = RECALL) -> CharNet:
        """Fit a logistic curve over the scores (Newton steps on smoothed labels, halved until they gain), then set the threshold. ``counts`` tells how often each occurs."""
        n1, n0 = counts[labels].sum(), counts[~labels].sum()
        aim = np.where(labels, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        x, w = np.c_[logit, np.ones(len(logit))], np.array([1.0, 0.0])

        def loss(w):
            z = x @ w
            return float((counts * (np.logaddexp(0, z) - aim * z)).sum() + 5e-4 * ((w - [1.0, 0.0]) ** 2).sum())

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (counts * (p - aim)) + 1e-3 * (w - [1.0, 0.0]))
            while np.abs(step).max() > 1e-12 and not loss(w - step) <= loss(w):  # labels that the net tells apart make whole steps too long
                step = step / 2
            w = w - step
        self.p["scale"], self.p["shift"] = w[:1], w[1:]
        hits = self._curve(logit[labels])
        order = np.argsort(hits, kind="stable")
        at = np.searchsorted(np.cumsum(counts[labels][order]), np.floor((1 - recall) * n1), side="right")
        self.threshold = float(hits[order][at])
        return self


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return ragged([np.frombuffer(c, np.uint8).astype(np.int64) for c in column.to_pylist()])


def learned(windows: DataFrame, net: CharNet, times: int, counts: tuple[int, int]) -> CharNet:
    """The average, weighted by windows, of what ``net`` becomes in each bucket of ``windows`` (codes, secret, draw, bucket).

    Parameters are added up as whole numbers, so the result does not depend on the order.
    """
    names = list(net.p)
    ends = np.cumsum([net.p[k].size for k in names])[:-1]

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("secret", "descending"), ("draw", "ascending"), ("codes", "ascending")])
        own = CharNet()
        own.p = {k: v.copy() for k, v in net.p.items()}
        own.fit(_codes(table["codes"]), table["secret"].to_numpy(), times, counts=counts)
        return pa.table({"n": [table.num_rows], "p": [np.concatenate([own.p[k].ravel() for k in names])]})

    made = windows.groupBy("bucket").applyInArrow(learn, "n long, p array<double>")
    whole = F.col("n") * F.round(F.col("p") * F.lit(float(1 << 30))).cast("decimal(19,0)")
    rows = made.select("n", F.posexplode("p").alias("at", "p")).groupBy("at").agg((F.sum(whole).cast("double") / F.sum("n") / F.lit(float(1 << 30))).alias("p"))
    flat = np.array([r["p"] for r in rows.orderBy("at").collect()])  # one row per parameter
    out = CharNet()
    out.p = {k: part.reshape(net.p[k].shape) for k, part in zip(names, np.split(flat, ends), strict=True)}
    return out


def train(docs: DataFrame) -> CharNet | None:
    """A net from all candidates of ``docs`` (doc_id, text), every different window once."""

    def label(ids: list, texts: list) -> dict:
        rows = [(text, c) for text in texts for c in candidates(text, base_spans(text))]
        codes = [window(t, c[0], c[1]).astype(np.uint8).tobytes() for t, c in rows]
        return {"codes": codes, "secret": [c[2] for _, c in rows], "held": [hashlib.blake2b(c, digest_size=1).digest()[0] % 3 == 0 for c in codes]}

    found = map_text(docs, label, "codes binary, secret boolean, held boolean").distinct()
    found = materialise(found.withColumn("draw", F.xxhash64("codes")), "secret-windows")
    sizes = {(r["held"], r["secret"]): r["n"] for r in found.groupBy("held", "secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 4:
        return None
    counts = sizes[False, True], sizes[False, False]
    rounds = 1 if sum(counts) <= BUCKET else ROUNDS
    buckets = -(-sum(counts) // (rounds * BUCKET))
    times = min(max(-(-VISITS * buckets // sum(counts)), TIMES[0]), TIMES[1])
    taught = found.where(~F.col("held")).withColumn("bucket", F.pmod(F.expr(f"draw div {rounds}"), F.lit(buckets)))
    net = CharNet()
    for k in range(rounds):
        net = learned(taught.where(F.pmod("draw", F.lit(rounds)) == k).select("codes", "secret", "draw", "bucket"), net, times, counts)

    def measure(batches):
        for batch in batches:
            steps = np.floor(np.clip(net._forward(_codes(batch["codes"]))[4], -FAR, FAR) / GRAIN).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"secret": batch["secret"], "step": steps})

    held = found.where("held").select("codes", "secret").mapInArrow(measure, "secret boolean, step long")
    told = held.groupBy("secret", "step").agg(F.count(F.lit(1)).alias("n")).orderBy("secret", "step").toArrow()  # at most 2 * FAR / GRAIN steps of either label
    return net.settle(told["step"].to_numpy() * GRAIN, told["secret"].to_numpy(), told["n"].to_numpy().astype(float))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: CharNet | None = None) -> DataFrame:
    """Per row its findings: doc_id, findings array of (kind, start, end, score), in order."""
    docs = text_of(docs, id_col, text_col)
    net = net or train(docs)

    def work(ids: list, texts: list) -> dict:
        found, where, codes = [], [], []
        for n, text in enumerate(texts):
            base = base_spans(text)
            found.append([(s, k, e, 1.0) for s, k, e in base])
            for s, e, touched in candidates(text, base) if net else ():
                if not touched:
                    where.append((n, s, e))
                    codes.append(window(text, s, e))
        if codes:
            for (n, s, e), p in zip(where, net.score(codes).tolist(), strict=True):
                if p >= net.threshold:
                    found[n].append((s, 3, e, p))
        told = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(f)] for f in found]
        return {"doc_id": ids, "findings": told}

    return map_text(docs, work, "doc_id long, findings array<struct<kind:string,start:int,end:int,score:double>>")


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the registered query, from the findings."""
    found = F.col("findings")
    base = F.filter(found, lambda f: f["kind"] != "cnn")

    def told(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def of(kind: str):
        return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(kind) for kind in KINDS]
    return scan(docs).select("doc_id", *count, F.sha2(told(base), 256).alias("base_sha256"), told(found).alias("spans"))
