"""Repeats, scoring, token files, decontamination, language, SentencePiece and chat against brute force or the libraries."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import WORDS, documents, find, plain_fingerprint, prose, texts
from saccadia.llm import chat, decontaminate, language_id, lm_score, piece_codec, repeats, token_files
from saccadia.llm.queries import SPARK

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- repeats

def covered(rows: list[str | None], length: int = 200) -> list[bytearray]:
    data = [(t or "").encode() for t in rows]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        marks = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                marks[p:p + length] = b"\1" * length
        out.append(marks)
    return out


def digest(text: str | None, marks: bytearray) -> tuple:
    data = (text or "").encode()
    runs = sum(1 for k, m in enumerate(marks) if m and not (k and marks[k - 1]))
    return len(data), sum(marks), runs, hashlib.sha256(bytes(b for b, m in zip(data, marks) if not m)).hexdigest()


def passages():
    rng = random.Random(3)
    shared = [prose(50 + k, 60) for k in range(4)]
    rows = [(k, " ".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng.randrange(10 ** 6), 15) for _ in range(rng.randint(1, 9)))) for k in range(120)]
    return rows + [(1000 + k, t) for k, (_, t) in enumerate(texts()) if len(t or "") < 20000]


@pytest.mark.parametrize("cap", [8192, 3])
def test_repeats_against_all_windows(spark, monkeypatch, cap):
    monkeypatch.setattr(repeats, "CAP", cap)  # the small cap sends common anchors through all finer cuts
    rows = passages()
    want = {i: digest(t, m) for (i, t), m in zip(rows, covered([t for _, t in rows]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.removal_digest(documents(spark, rows)).collect()}
    assert got == want


def test_memory_of_anchors_and_suffix_arrays():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    segments = [data[i:i + 300].tobytes() for i in range(0, 1_200_000, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(segments) // 2), 2)), pa.array(np.arange(len(segments))),
                                        pa.array(segments, pa.binary())], ["m", "sh", "body"])

    def peak(work) -> float:
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    assert peak(lambda: repeats.anchors(data, np.array([0, len(data)]), 64)) < 40
    assert peak(lambda: list(repeats._array_rows([batch]))) < 50


def test_repeated_and_nameless_rows(spark):
    rows = [r for r in texts() if len(r[1] or "") < 20000]
    want = Counter((i, *digest(t, m)) for (i, t), m in zip(rows, covered([t for _, t in rows])))
    assert Counter(tuple(r) for r in repeats.removal_digest(documents(spark, rows)).collect()) == want
    assert repeats.removal_digest(documents(spark).limit(0)).count() == 0


def test_suffix_array_and_interval_tree():
    rng = np.random.default_rng(1)
    for n in (1, 40, 200):
        symbols = rng.integers(97, 99, n)
        symbols = np.concatenate((symbols[:n // 2], [256], symbols[n // 3:], [257]))
        order, common = repeats.suffix_array(symbols, len(symbols))
        word = lambda k: tuple(symbols[k:k + int(np.flatnonzero(symbols[k:] > 255)[0]) + 1])
        prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert sorted(order.tolist()) == list(range(len(symbols)))
        assert [prefix(word(a), word(b)) for a, b in zip(order, order[1:])] == common.tolist()
        before = np.concatenate(([-1], symbols[:-1]))
        before = np.where((before < 0) | (before > 255), -1 - np.arange(len(symbols)), before)
        found = {(d, frozenset(order[a:b + 1].tolist())) for d, a, b in repeats.maximal_repeats(common, before[order], 3)}
        want = set()
        for start in range(len(symbols)):
            for size in range(3, len(word(start))):
                at = [k for k in range(len(symbols)) if word(k)[:size] == word(start)[:size]]
                nexts = {word(k)[size] for k in at}
                if len(at) > 1 and len(nexts) > 1 and len({int(before[k]) for k in at}) > 1:
                    want.add((size, frozenset(at)))
        assert found == want


def test_cut_texts_stay_valid(spark):
    rows = [(1, "é" * 150 + " eins " + prose(1, 40)), (2, "zwei " + "é" * 150 + " " + prose(2, 10)), (3, None), (4, prose(9, 5))]
    docs = documents(spark, rows)
    got = repeats.without_repeats(docs)
    assert got.columns == docs.columns
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[3]["text"] is None and out[4]["text"] == rows[3][1]
    for i in (1, 2):
        assert "é" * 50 not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"])


# ---------------------------------------------------------------- language-model scoring

def test_losses_against_counting(spark):
    rows = [(i, t) for i, t in {i: t for i, t in texts() if i != 22}.items() if i is not None]
    good = {10, 12, 18, 24, 30}
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(
        documents(spark, rows), spark.createDataFrame([(i,) for i in [*good, 10, None, 777]], "doc_id long"), shards=3).collect()}
    words = {i: decontaminate.words_of(t or "") for i, t in rows}
    single, double = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in words.items():
        for k in (0, 1) if i in good else (0,):
            single[k].update(w)
            double[k].update(zip(w, w[1:]))
    rare = {w for w, c in single[0].items() if c < 2}
    for i, w in words.items():
        assert got[i]["n_words"] == len(w) and got[i]["is_target"] == (i in good)
        if not w:
            assert got[i]["score"] is None
            continue
        own, pairs, losses = Counter(w), Counter(zip(w, w[1:])), []
        for k in (1, 0):
            mine = 1 if k == 0 or i in good else 0
            unknown = sum(single[k][x] for x in rare) - mine * sum(x in rare for x in w)
            total, loss = sum(single[k].values()) - mine * len(w), 0.0
            for at, x in enumerate(w):
                count = unknown if x in rare else single[k][x] - mine * own[x]
                p = (count + 1) / (total + len(single[0]) - len(rare) + 1)
                if at and x not in rare and w[at - 1] not in rare and (b := single[k][w[at - 1]] - mine * own[w[at - 1]]) > 0:
                    p = 0.7 * (double[k][w[at - 1], x] - mine * pairs[w[at - 1], x]) / b + 0.3 * p
                loss -= math.log(p)
            losses.append(loss / len(w))
        assert got[i]["loss_target"] == pytest.approx(losses[0], abs=1e-9) and got[i]["loss_background"] == pytest.approx(losses[1], abs=1e-9)
        assert got[i]["score"] == pytest.approx(losses[0] - losses[1], abs=1e-9)


def test_score_prefers_the_target_kind(spark):
    rng = random.Random(2)
    kinds = (WORDS[:32], WORDS[32:])
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(80)]
    ids = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(documents(spark, rows), ids).collect()}
    assert max(got[i] for i in range(40, 80, 2)) < min(got[i] for i in range(41, 80, 2))
    assert lm_score.cross_entropy_difference(documents(spark).limit(0), ids).count() == 0
    assert lm_score.cross_entropy_difference(documents(spark), ids.limit(0)).count() == len(texts())


# ---------------------------------------------------------------- token files

def test_token_files_round_trip(spark):
    rows = sorted({i: t for i, t in texts() if i is not None}.items())
    tokenizer = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.round_trip(documents(spark, rows), BPE).collect()}
    start = 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_keep_every_row(spark, tmp_path):
    made = token_files.write_token_files(documents(spark), BPE, f"file://{tmp_path}")
    read = token_files.read_token_files(made).collect()
    assert Counter(r["doc_id"] for r in read) == Counter(i for i, _ in texts())
    assert sum(r["n_tokens"] for r in read) == sum(p.stat().st_size for p in tmp_path.glob("*.bin")) // 2
    assert sorted(r["start"] for r in read)[0] == 0 and len({r["start"] for r in read}) == len(read)
    assert token_files.round_trip(documents(spark).limit(0), BPE).count() == 0


def test_chunks_encode_like_whole_texts():
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "I'll", "12", "é", " ", "　", "\x1c", ".", "!!", "日本", "😀", "\r\n", "word", " x"]
    sample = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [" ", "", " a", "a ", "\n a"]
    coder, plain = token_files.Encoder(BPE), Tokenizer.from_file(BPE)
    assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(sample)] == [e.ids for e in plain.encode_batch(sample, add_special_tokens=False)]


# ---------------------------------------------------------------- decontamination

def test_overlaps_survive_substitutions(spark):
    items = [(k, prose(700 + k, 18 + k)) for k in range(8)] + [(50, "kurz ist das"), (51, None), (52, ""), (None, "nicht benannt"), (0, prose(700, 18))]
    rng = random.Random(1)
    rows, want = [], set()
    for n in range(60):
        k = n % 8
        words = prose(700 + k, 18 + k).split()
        if n % 3:
            for p in rng.sample(range(len(words)), len(words) // (9 if n % 3 == 1 else 7)):
                words[p] = f"q{p}{n}"
        rows.append((n, prose(n + 5000, 40) + " " + " ".join(words) + " " + prose(n + 9000, 40)))
        want.add((n, k))
    rows += [(100 + k, prose(4000 + k, 200)) for k in range(40)] + [(200, "und KURZ, ist! das"), (201, "kurz ist"), (202, None), (203, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(200, 50)}
    assert len(got) == len(want) + 1 and all(r["share"] >= 0.75 for r in got)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in want} - {200}


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(700 + k, 20)) for k in range(30)], "item_id long, text string")
    rows = documents(spark, [(n, prose(n, 9) + " " + prose(700 + n % 40, 20)) for n in range(60)])
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows, items).collect()}
    one = pairs()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert pairs() == one and len(one) == 50
    assert decontaminate.clean(rows, items).count() == 10


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark), none).count() == 0
    assert decontaminate.clean(documents(spark), none).count() == len(texts())


def plain_window(equal, least: int) -> int:
    """Most equal words of a window of the least number and share, 0 without one."""
    n = len(equal)
    return max((e for a in range(n) for b in range(a + 1, n + 1) if (e := int(sum(equal[a:b]))) >= least and 4 * e >= 3 * (b - a)), default=0)


def test_best_window_against_all_windows():
    rng = np.random.default_rng(3)
    found = 0
    for k in range(600):
        equal = rng.random(rng.integers(1, 60)) < (0.55, 0.7, 0.85)[k % 3]
        least = int(rng.integers(1, 14))
        got, want = decontaminate.best_window(equal, least), plain_window(equal.tolist(), least)
        assert (got[0] if got else 0) == want
        if got:
            e, n, at = got
            assert equal[at] and equal[at + n - 1] and e == equal[at:at + n].sum() and 4 * e >= 3 * n
            found += 1
    assert 100 < found < 600


def test_masks_hit_every_window_of_twelve_to_twenty_words():
    for n in range(12, 21):
        different = n - max(12, -(-3 * n // 4))
        sets = list(itertools.combinations(range(n), different))
        gone = np.array(sets, np.int64).reshape(len(sets), different)
        patterns = np.ones((len(gone), n), bool)
        patterns[np.arange(len(gone))[:, None], gone] = False
        hit = np.zeros(len(gone), bool)
        for mask in decontaminate.MASKS:
            ones = np.array([c == "1" for c in mask])
            for at in range(n - len(mask) + 1):
                hit |= patterns[:, at:at + len(mask)][:, ones].all(axis=1)
        assert hit.all()


def test_overlaps_against_all_alignments(spark):
    """Every alignment of every text with every item, every window of it; an overlap does not vanish when it goes on with more changes."""
    rng = random.Random(5)
    items = [(k, prose(800 + k, 15 * (1 + k % 4))) for k in range(12)] + [(20, "vier kurze worte hier")]
    rows = []
    for n in range(90):
        words = prose(800 + n % 12, 15 * (1 + n % 12 % 4)).split()
        for p in range(len(words)):
            if rng.random() < (0.15, 0.22, 0.28, 0.35)[n % 4]:
                words[p] = f"x{p}q{n}"
        rows.append((n, " ".join([prose(n + 5000, 5), *words, prose(n + 9000, 5)])))
    whole = [f"wort{k}" for k in range(49)]
    thrice = [w if c == "1" else f"neu{k}" for k, (w, c) in enumerate(zip(whole, "00".join(["111011101110111"] * 3)))]
    items.append((30, " ".join(whole)))
    rows += [(200, " ".join(thrice[:15])), (201, " ".join(thrice)), (202, "und vier kurze worte hier")]
    want = set()
    for d, text in rows:
        t = decontaminate.words_of(text)
        for i, item in items:
            w = decontaminate.words_of(item)
            for shift in range(-len(w) + 1, len(t)):
                equal = [w[k] == t[k + shift] for k in range(len(w)) if 0 <= k + shift < len(t)]
                if sum(equal) >= min(12, len(w)) and plain_window(equal, min(12, len(w))):
                    want.add((d, i))
    got = decontaminate.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert {(200, 30), (201, 30), (202, 20)} <= want and 30 < len(want) < 93


# ---------------------------------------------------------------- language-model scoring

def test_losses_against_counting(spark):
    rows = [(i, t) for i, t in {i: t for i, t in texts() if i != 22}.items() if i is not None]
    good = {10, 12, 18, 24, 30}
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(
        documents(spark, rows), spark.createDataFrame([(i,) for i in [*good, 10, None, 777]], "doc_id long"), shards=3).collect()}
    words = {i: decontaminate.words_of(t or "") for i, t in rows}
    single, double = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in words.items():
        for k in (0, 1) if i in good else (0,):
            single[k].update(w)
            double[k].update(zip(w, w[1:]))
    rare = {w for w, c in single[0].items() if c < 2}
    for i, w in words.items():
        assert got[i]["n_words"] == len(w) and got[i]["is_target"] == (i in good)
        if not w:
            assert got[i]["score"] is None
            continue
        own, pairs, losses = Counter(w), Counter(zip(w, w[1:])), []
        for k in (1, 0):
            mine = 1 if k == 0 or i in good else 0
            unknown = sum(single[k][x] for x in rare) - mine * sum(x in rare for x in w)
            total, loss = sum(single[k].values()) - mine * len(w), 0.0
            for at, x in enumerate(w):
                count = unknown if x in rare else single[k][x] - mine * own[x]
                p = (count + 1) / (total + len(single[0]) - len(rare) + 1)
                if at and x not in rare and w[at - 1] not in rare and (b := single[k][w[at - 1]] - mine * own[w[at - 1]]) > 0:
                    p = 0.7 * (double[k][w[at - 1], x] - mine * pairs[w[at - 1], x]) / b + 0.3 * p
                loss -= math.log(p)
            losses.append(loss / len(w))
        assert got[i]["loss_target"] == pytest.approx(losses[0], abs=1e-9) and got[i]["loss_background"] == pytest.approx(losses[1], abs=1e-9)
        assert got[i]["score"] == pytest.approx(losses[0] - losses[1], abs=1e-9)


def test_score_prefers_the_target_kind(spark):
    rng = random.Random(2)
    kinds = (WORDS[:32], WORDS[32:])
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(80)]
    ids = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(documents(spark, rows), ids).collect()}
    assert max(got[i] for i in range(40, 80, 2)) < min(got[i] for i in range(41, 80, 2))
    assert lm_score.cross_entropy_difference(documents(spark).limit(0), ids).count() == 0
    assert lm_score.cross_entropy_difference(documents(spark), ids.limit(0)).count() == len(texts())


# ---------------------------------------------------------------- token files

def test_token_files_round_trip(spark):
    rows = sorted({i: t for i, t in texts() if i is not None}.items())
    tokenizer = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.round_trip(documents(spark, rows), BPE).collect()}
    start = 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_keep_every_row(spark, tmp_path):
    made = token_files.write_token_files(documents(spark), BPE, f"file://{tmp_path}")
    read = token_files.read_token_files(made).collect()
    assert Counter(r["doc_id"] for r in read) == Counter(i for i, _ in texts())
    assert sum(r["n_tokens"] for r in read) == sum(p.stat().st_size for p in tmp_path.glob("*.bin")) // 2
    assert sorted(r["start"] for r in read)[0] == 0 and len({r["start"] for r in read}) == len(read)
    assert token_files.round_trip(documents(spark).limit(0), BPE).count() == 0


def test_chunks_encode_like_whole_texts():
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "I'll", "12", "é", " ", "　", "\x1c", ".", "!!", "日本", "😀", "\r\n", "word", " x"]
    sample = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [" ", "", " a", "a ", "\n a"]
    coder, plain = token_files.Encoder(BPE), Tokenizer.from_file(BPE)
    assert [np.frombuffer(b, "<u2").tolist() for b in coder.encode(sample)] == [e.ids for e in plain.encode_batch(sample, add_special_tokens=False)]


# ---------------------------------------------------------------- decontamination

def test_overlaps_survive_substitutions(spark):
    items = [(k, prose(700 + k, 18 + k)) for k in range(8)] + [(50, "kurz ist das"), (51, None), (52, ""), (None, "nicht benannt"), (0, prose(700, 18))]
    rng = random.Random(1)
    rows, want = [], set()
    for n in range(60):
        k = n % 8
        words = prose(700 + k, 18 + k).split()
        if n % 3:
            for p in rng.sample(range(len(words)), len(words) // (9 if n % 3 == 1 else 7)):
                words[p] = f"q{p}{n}"
        rows.append((n, prose(n + 5000, 40) + " " + " ".join(words) + " " + prose(n + 9000, 40)))
        want.add((n, k))
    rows += [(100 + k, prose(4000 + k, 200)) for k in range(40)] + [(200, "und KURZ, ist! das"), (201, "kurz ist"), (202, None), (203, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(200, 50)}
    assert len(got) == len(want) + 1 and all(r["share"] >= 0.75 for r in got)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in want} - {200}


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(700 + k, 20)) for k in range(30)], "item_id long, text string")
    rows = documents(spark, [(n, prose(n, 9) + " " + prose(700 + n % 40, 20)) for n in range(60)])
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows, items).collect()}
    one = pairs()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert pairs() == one and len(one) == 50
    assert decontaminate.clean(rows, items).count() == 10


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark), none).count() == 0
    assert decontaminate.clean(documents(spark), none).count() == len(texts())


def test_best_segment_against_all_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 25)) < 0.6
        e, n, at = decontaminate.best_segment(equal)
        score = lambda a, b: equal[a:b].sum() - 2 * (~equal[a:b]).sum()
        assert score(at, at + n) == max(score(a, b) for a in range(len(equal) + 1) for b in range(a, len(equal) + 1)) and e == equal[at:at + n].sum()


# ---------------------------------------------------------------- language

def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = SPARK["op8_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 30 and (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_unlettered_and_long_texts(spark):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).filter("doc_id is not null").collect()}
    for i in (14, 15, 16, 17):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
    assert got[22]["lang_pred"] in ("aa", "bb") and 0 < got[22]["score"] <= 1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {14, 15, 16, 17} & {r["doc_id"] for r in kept.collect()}
    nothing = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_tables_equal_the_network():
    rng = np.random.default_rng(0)
    model = language_id.train([("a", "abc def"), ("b", "xyz uvw")] * 40, epochs=1)
    windows = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    params = {"embed": model.embed, "bias": model.bias, **{f"w{w}": f for w, f in model.filters.items()}}
    z = np.maximum(language_id._pooled(windows, params)[0], 0) @ model.dense + model.dense_bias
    assert np.allclose(language_id.Predictor(model).log_probabilities(windows), np.log(language_id._softmax(z)), atol=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = {"embed": rng.normal(size=(256, 8)), "bias": rng.normal(size=(3, 16)), "dense": rng.normal(size=(48, 3)), "dense_bias": rng.normal(size=3)}
    p |= {f"w{w}": rng.normal(size=(w, 8, 16)) for w in language_id.WIDTHS}
    windows, target = rng.integers(0, 256, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -np.log(language_id._softmax(np.maximum(language_id._pooled(windows, p)[0], 0) @ p["dense"] + p["dense_bias"]))[range(6), target].mean()
    for name, g in language_id._gradients(windows, target, p).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, p[name][at] = p[name][at], p[name][at] + 1e-6
        up = loss()
        p[name][at] = old
        assert (up - loss()) / 1e-6 == pytest.approx(g[at], rel=1e-3)


# ---------------------------------------------------------------- SentencePiece

def test_encoding_equals_the_library():
    coder, library = piece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    parts = ["a", "e", " ", "  ", "\n", "▁", "é", "中", "😀", "1", ".", "ing", " the", "\t", "\x00", "А", "==", "<s>", "<0x41>"]
    pieces = list(coder.ids)
    sample = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    sample += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    sample += [" " * n + "b" * (n % 2) for n in range(70)] + ["ab" * 3000, "a" * 4001] + [t or "" for _, t in texts()]
    assert [coder.encode(t) for t in sample] == library.encode(sample)


def test_encoded_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_codec.encode(documents(spark), PIECES).collect()
    want = Counter()
    for i, t in texts():
        ids = [*library.encode(t or ""), library.eos_id()]
        want[i, tuple(ids), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r[0], tuple(r[1]), *r[2:]) for r in got) == want
    assert piece_codec.encode(documents(spark).limit(0), PIECES).count() == 0


# ---------------------------------------------------------------- chat

def conversations(spark):
    talk = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(c, t, r, x) for c, n in ((1, 1), (2, 2), (3, 4), (4, 3), (9, 4)) for t, (r, x) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "other"), (6, 0, None, None), (6, 0, None, None), (7, 5, "system", "<|im_end|> x"), (7, None, "user", "first"),
             (8, 0, "user", ""), (None, 0, "user", "nobody"), (None, 1, "assistant", "known")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, position long, h1 string")


def test_snapshots_collapse(spark):
    got = {r["conv_id"]: r for r in chat.render(conversations(spark)).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}
    assert (got[3]["n_turns"], got[3]["n_copies"]) == (4, 2)
    assert got[3]["text"].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert got[6]["n_turns"] == 2 and "<| im_end|> x" in got[7]["text"] and got[7]["text"].startswith("<|im_start|>user\nfirst")
    assert chat.render(conversations(spark).limit(0)).count() == 0


def test_chat_stays_native(spark):
    plan = chat.render(conversations(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_chat_equals_sql(spark):
    rows = [tuple(r) for r in conversations(spark).select("conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null").collect()]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = {r[0]: r for r in con.execute(chat.SQL).fetchall()}
    got = {r["conv_id"]: tuple(r) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want


# ---------------------------------------------------------------- pipeline

def test_pipeline_against_its_parts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state, columns = docs, docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for k, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = state
        function(spark, state, sf).write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
        assert state.columns == columns
        rows, after = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in state.collect()}
        if k == 1:
            fps, parent = {i: plain_fingerprint(t) for i, t in rows.items()}, {i: i for i in rows}
            for a, b in itertools.combinations(rows, 2):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
            assert set(after) == {i for i in rows if find(parent, i) == i} and len(after) < len(rows)
        if k == 2:
            want = dict(zip(rows, covered(list(rows.values()))))
            assert set(after) == set(rows)
            assert all(after[i].encode() == bytes(b for b, m in zip(rows[i].encode(), want[i]) if not m) for i in rows if not any(want[i]) or rows[i].isascii())
        if k == 3:
            assert set(after) <= set(rows)
    final = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, state, sf).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {i: library.decode(ids) for i, ids in final.items()} == {r["doc_id"]: library.decode(library.encode(r["text"])) for r in state.collect()}


def test_pipeline_takes_awkward_documents(spark, sf):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "aa").otherwise("bb"))
    for rows in (docs, docs.limit(0)):
        state = rows
        for _, function in corpus_pipeline.STAGES:
            state = function(spark, state, sf)
        state.count()


def test_arrow_helpers():
    from saccadia.llm.common import each_group, whole_groups
    batches = [pa.RecordBatch.from_pydict({"g": g}) for g in ([1, 1], [], [1, 2, 3], [3], [3, 4, 4])]
    assert [t.column("g").to_pylist() for t in each_group(batches, "g")] == [[1, 1, 1], [2], [3, 3, 3], [4, 4]]
    assert sum(t.num_rows for t in whole_groups(batches, ["g"])) == 9
