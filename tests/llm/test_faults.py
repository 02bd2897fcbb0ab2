"""Cases that once failed: large samples, long runs, states opened again, clashing columns, many findings."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foldwright.llm import bpe, chat, exact_dedup, language, line_dedup, mixing, secrets, simhash
from foldwright.llm.common import drawn, free_names


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_small_shares_still_draw(spark):
    """One in 2^25 of 2^27 hashes is about four, where a grain of 2^-20 gave none."""
    keys = spark.range(1 << 27).select(F.xxhash64("id").alias("key"))
    assert 1 <= keys.where(drawn(F.col("key"), 2.0**-25)).count() <= 15
    assert keys.limit(1000).where(drawn(F.col("key"), 1.0)).count() == 1000


def test_languages_are_learned_from_a_small_share(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 40)
    words = {"en": "the house and water of green", "de": "das haus und wasser von gruen"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=30)), lang) for lang in words for k in range(300)]
    rows += [(k, "字" * 4000, "zh") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, log_prob = language.train(docs)
    usable = log_prob[np.isfinite(log_prob).all(axis=1)]
    assert langs == ["de", "en", "zh"] and (np.ptp(usable, axis=0) > 5).all()  # runs without spaces teach something too
    made = language.identify(spark.createDataFrame([(1, "the water"), (2, "das wasser"), (3, "字字")], "doc_id long, text string"), (langs, log_prob)).collect()
    assert {r.doc_id: r.lang_pred for r in made} == {1: "en", 2: "de", 3: "zh"}


def test_long_white_space_in_a_turn(spark):
    texts = [" " * 1_200_000, "\n" * 1_200_000 + "x", "a <s> b [/INST] \\</s>" + "\t" * 1000]
    rows = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    (made,) = chat.digests(rows).collect()
    assert (made.n_turns, made.loss_chars, made.loss_sha256) == (3, sum(map(len, texts)), sha("".join(texts)))


def test_a_run_of_many_chunks_is_encoded_few_times(monkeypatch):
    draw = random.Random(1)
    text = "x y " + "".join(draw.choice("abcdefgh") for _ in range(120_000)) + " z" + " word" * 3000
    split, seen = bpe.split_and_encode, []

    def counted(start, part, last, path):
        seen.append(len(part))
        return split(start, part, last, path)

    monkeypatch.setattr(bpe, "split_and_encode", counted)
    chunk, overlap = 2000, 100
    chunks = []
    for start in range(0, len(text), chunk):
        last = start + chunk + overlap >= len(text)
        chunks.append(split(start, text[start : start + chunk + overlap], last, bpe.RANKS) | {"text": text[start : start + chunk + overlap]})
        if last:
            break
    assert bpe.stitch(chunks, bpe.RANKS) == bpe.encoder(bpe.RANKS).text(text)
    assert len(seen) <= 10 and sum(seen) <= 5 * len(text)


@pytest.mark.parametrize("more", [False, True])
def test_exact_dedup_goes_on_from_its_folder(spark, tmp_path, more):
    def put(name, rows):
        pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "docs" / name)

    (tmp_path / "docs").mkdir()
    put("a.parquet", [(5, "one"), (3, "o ne"), (7, "two")])
    run = lambda: {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, str(tmp_path / "docs"), str(tmp_path / "state")).collect()}
    assert run() == {5: (3, 2), 3: (3, 2), 7: (7, 1)}
    if more:
        put("b.parquet", [(1, "on e"), (9, "t  wo"), (8, "three")])
        assert run() == {5: (1, 3), 3: (1, 3), 1: (1, 3), 7: (9, 2), 9: (9, 2), 8: (8, 1)}
    else:
        assert run() == {5: (3, 2), 3: (3, 2), 7: (7, 1)}


def test_line_state_opened_again(spark, tmp_path):
    line = "A line that is long enough to be counted, in many documents."
    docs = spark.createDataFrame([(k, f"{line}\nown {k}") for k in (10, 20, 30, 40, 100)], "doc_id long, text string")
    folder = str(tmp_path / "lines")
    line_dedup.LineDedup(spark, folder, min_docs=3).insert(docs).delete(docs.where("doc_id = 100"))
    again = line_dedup.LineDedup(spark, folder, min_docs=3)
    assert {(r.n, r["last"]) for r in again.counts().collect()} == {(4, 40)}
    kept = {r.doc_id: r.text for r in again.clean(docs.where("doc_id < 100")).collect()}
    assert kept == {10: "own 10", 20: "own 20", 30: "own 30", 40: f"{line}\nown 40"}
    again.delete(docs.where("doc_id = 40"))
    third = line_dedup.LineDedup(spark, folder, min_docs=3)
    kept = {r.doc_id: r.n_dropped for r in third.clean(docs.where("doc_id < 40")).collect()}
    assert kept == {10: 1, 20: 1, 30: 0}
    # what an update wrote before it broke is not read
    line_dedup.references(docs.select("doc_id", "text")).write.parquet(f"{folder}/refs/broken")
    assert {(r.n, r["last"]) for r in line_dedup.LineDedup(spark, folder, min_docs=3).counts().collect()} == {(3, 30)}


def test_columns_named_like_our_own(spark):
    names = ["_id", "_ID2", "_key", "_none", "_gone", "_gone_id", "_nth", "_plan", "_copy", "n_lines", "n_dropped"]
    rows = [(k, f"some words of document {k} " * 30, "a", *[f"{n}{k}" for n in names]) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    own = {r.doc_id: tuple(r[n] for n in names) for r in docs.collect()}
    for out in (simhash.one_of_each(docs), mixing.mixed_documents(docs), line_dedup.dedup_lines(docs, counts=False)):
        assert out.columns == docs.columns
        made = out.collect()
        assert made and all(tuple(r[n] for n in names) == own[r.doc_id] for r in made)
    counted = line_dedup.dedup_lines(docs)
    assert sorted(counted.columns) == sorted(docs.columns) and {r.n_lines for r in counted.collect()} == {1}
    assert free_names(docs, "_id", "free") == ["__id", "free"]


def test_candidates_beside_many_findings():
    text = " ".join(f"token=abcdef{k} run{k:06d}" for k in range(20_000))
    base = secrets.base_spans(text)
    start = time.perf_counter()
    found = secrets.candidates(text, base)
    assert time.perf_counter() - start < 3  # square work took minutes
    assert sum(not touched for _, _, touched in found) == 20_000
    for short in ("pwd: hunter2x", "pwd: 'correcthorse'", "key = letters", "x=abcdef"):
        assert [short[s:e] for s, e, _ in secrets.candidates(short, [])], short
    assert not secrets.candidates("plain words without any value, 12345 too short", [])


@pytest.mark.parametrize("bucket", [256, 1 << 20])
def test_secrets_are_learned_from_every_candidate(spark, monkeypatch, bucket):
    """More candidates of either label than the 1,000 that were once sampled; all teach or set the threshold."""
    draw = random.Random(4)
    key = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(32))
    texts = [f"the key {key()} was used" for _ in range(1500)] + [f"order {draw.randint(10**9, 10**10 - 1)} was paid" for _ in range(2500)]
    docs = spark.createDataFrame([(k % 7 or None, t) for k, t in enumerate(texts + texts[:900])], "doc_id long, text string").repartition(3)
    seen, learned, settle = Counter(), secrets.learned, secrets.CharNet.settle

    def spy_learned(windows, net, times, counts):
        seen["taught"] += windows.count()
        return learned(windows, net, times, counts)

    def spy_settle(net, logit, labels, counts, *more):
        seen["held"] += counts.sum()
        return settle(net, logit, labels, counts, *more)

    monkeypatch.setattr(secrets, "BUCKET", bucket)
    monkeypatch.setattr(secrets, "learned", spy_learned)
    monkeypatch.setattr(secrets.CharNet, "settle", spy_settle)
    net = secrets.train(docs)
    assert seen["taught"] + seen["held"] == 4000 and seen["held"] > 1000
    codes = [np.array([secrets.window(t, *secrets.candidates(t, [])[0][:2]) for t in part]) for part in (texts[:1500], texts[1500:])]
    assert (net.score(codes[0]) >= net.threshold).mean() >= secrets.RECALL - 0.01
    assert (net.score(codes[1]) >= net.threshold).mean() < 0.05
    again = secrets.train(docs.repartition(5))
    assert again.threshold == net.threshold and all((again.p[k] == net.p[k]).all() for k in net.p)
