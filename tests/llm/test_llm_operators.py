"""Training-data operators against brute force on small fixtures: nulls, empty and odd texts, ties, repeats, empty tables."""

import hashlib
import itertools
import math
import random
import re
import string
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from genolake.llm import chat, common, decontaminate, licenses, multiset_hash, sentencepiece_lattice, sharding, shingle_dedup, simhash, suffix_dedup, token_files, toxicity

DOCS = "doc_id long, text string, lang string, row int, hits string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "cat", "mat", "éa", "on", "big", "dog", "xyz", "run"]) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


PASSAGE = words(30, 99)
TEXTS = [
    (0, "Alpha beta. " + PASSAGE + " tail one.\nnext line"), (1, None), (2, ""), (3, "Alpha beta. " + PASSAGE + " tail one.\nnext line"), (4, "x"),
    (5, "Other start, " + PASSAGE + " ünd anders"), (6, words(900, 1)), (7, words(900, 1).replace("cat", "cot", 1)), (8, "  \n\t "), (9, "a" * 300), (10, "b" + "a" * 120), (5, "Repeated id, " + PASSAGE),
    (12, "<|startoftext|> odd ’s 漢字 Å J̌"), (-3, "same"), (14, "same"), (15, "Zz " * 40),
    (16, "\x01 a\x01b \x01\x01 x<|endoftext|>y don't <| 7th\x00\x01 \x85 \u2003x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", k, "clash") for k, (i, t) in enumerate(TEXTS)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {x: x for e in edges for x in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: group[x] for x in linked}


def test_range_of_splits_by_quantiles(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    cuts = common.splitters(df, "k", 10)
    assert len(cuts) == 9
    got = df.select("k", common.range_of(F.col("k"), cuts).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["k"] for c in cuts) for r in got)
    assert common.splitters(df.where("k < 0"), "k", 10) == []


# 1


def _segmentations(lattice, text):
    def unit(u, j):
        if not j:
            yield b"", 0.0
        for last, (size, ids, w) in lattice.edges(u):
            if last + 1 == j:
                for rest, x in unit(u, j - size):
                    yield rest + ids, x + math.log(w)

    units = sentencepiece_lattice.UNIT.findall(" " + text)
    all_ = {b"".join(c[0] for c in combo): sum(c[1] for c in combo) for combo in itertools.product(*[list(unit(u, len(u))) for u in units])}
    total = math.log(sum(map(math.exp, all_.values())))
    return {ids: math.exp(x - total) for ids, x in all_.items()}


def test_samples_without_replacement():
    lattice = sentencepiece_lattice.Lattice(MODEL, 0.7)
    p = _segmentations(lattice, "the cat")
    n, first, weight = 1500, dict.fromkeys(p, 0), dict.fromkeys(p, 0.0)
    for key in range(n):
        got = sentencepiece_lattice.samples(lattice, [key], ["the cat"], 3)[0]
        assert len({x[1] for x in got}) == 3 and [x[4] for x in got] == sorted((x[4] for x in got), reverse=True)
        first[got[0][1]] += 1
        for _, ids, size, log_p, _, inclusion in got:
            assert abs(math.exp(log_p) - p[ids]) < 1e-9 and 0 < inclusion <= 1 and size == len(ids) // 2
            weight[ids] += p[ids] / inclusion / n
    top = sorted(p, key=p.get)[-3:]
    assert all(abs(first[x] / n - p[x]) < 0.05 and abs(weight[x] - p[x]) < 0.03 for x in top)
    assert len(sentencepiece_lattice.samples(lattice, [1], [""], 5)[0]) == 1
    assert sentencepiece_lattice.samples(lattice, [7], ["dog mat"], 2)[0] == sentencepiece_lattice.samples(lattice, [6, 7, 8], ["the", "dog mat", "of dogs"], 2)[1]
    few = sentencepiece_lattice.samples(lattice, [1], ["a"], 500)[0]
    assert len(few) == len(_segmentations(lattice, "a")) and few[0][5] == 1.0


@pytest.mark.parametrize("run", ["中文分词的结果应该保持不变", "ሀለሐመሠረሰሸቀበተቸ", "กขคงจฉช", "😀🦄🧬🫠", "𓀀𓀁𓀂", "é😀中ሀx", "ก"])
def test_short_units_do_not_underflow(run, monkeypatch):
    lattice = sentencepiece_lattice.Lattice(MODEL, 2.0)
    texts = [(run * 40)[:n] for n in (6, 8, 20, 34, 35, 39, 40, 41)]
    got = sentencepiece_lattice.samples(lattice, list(range(len(texts))), texts, 3)
    for t, rows in zip(texts, got):
        assert rows and all(lattice.decode(r[1]) == t and -math.inf < r[3] <= 0 for r in rows) and len({r[1] for r in rows}) == len(rows)
    monkeypatch.setattr(sentencepiece_lattice, "SHORT", 0)
    by_logs = sentencepiece_lattice.Lattice(MODEL, 2.0)
    for i, (t, rows) in enumerate(zip(texts, got)):
        again = sentencepiece_lattice.samples(by_logs, [i], [t], 3)[0]
        assert [r[1] for r in again] == [r[1] for r in rows] and np.allclose([r[3] for r in again], [r[3] for r in rows], rtol=1e-9, atol=1e-9)


def test_all_segmentations_however_unlikely():
    lattice = sentencepiece_lattice.Lattice(MODEL, 2.0)
    for text in ("a", "of", "cat", "the", "a of", "dog's"):
        p = _segmentations(lattice, text)
        got = sentencepiece_lattice.samples(lattice, [3], [text], len(p) + 5)[0]
        assert {r[1] for r in got} == set(p) and len(got) == len(p)
        assert all(math.isclose(math.exp(r[3]), p[r[1]], rel_tol=1e-9) and r[5] == 1.0 for r in got)
    assert min(_segmentations(lattice, "a").values()) < 1e-12


@pytest.mark.parametrize("bound", [0, 40])
def test_what_is_forgotten_has_no_say(monkeypatch, bound):
    texts = [words(30, i % 7) for i in range(40)]
    whole = sentencepiece_lattice.samples(sentencepiece_lattice.Lattice(MODEL, 2.0), list(range(40)), texts, 2)
    monkeypatch.setattr(sentencepiece_lattice, "REMEMBERED", bound)
    small = sentencepiece_lattice.Lattice(MODEL, 2.0)
    assert [x for i in range(0, 40, 5) for x in sentencepiece_lattice.samples(small, list(range(i, i + 5)), texts[i : i + 5], 2)] == whole


def test_encode_and_decode(docs, empty):
    got = sentencepiece_lattice.decode(sentencepiece_lattice.encode_samples(docs, MODEL), MODEL).collect()
    allowed = {(i, t or "") for i, t in TEXTS}
    assert {(r["doc_id"], r["text"]) for r in got} == allowed
    assert sentencepiece_lattice.encode_samples(empty, MODEL).count() == 0


# 2


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>", "~0~~1", None, "<|user|>x<|end|>", "", "plain"]
    given = [(c, t, "assistant" if t % 2 else "user", odd[(c + t) % 7]) for c in range(4) for t in range(5)] + [(9, 0, None, "x"), (9, 0, None, "x")]
    conv = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.as_tree(conv)).select("tree", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_mask(F.col("formatted")).alias("m"), "formatted").collect()
    assert len(out) == 5
    for r in out:
        want = [(x[2] or "", x[3] or "") for x in sorted((g for g in given if g[0] == r["tree"]), key=lambda g: g[1])]
        assert [(t["role"], t["text"]) for t in r["t"]] == want
        assert len(r["m"]) == sum(w[0] == "assistant" for w in want)
    assert chat.format_trees(chat.as_tree(conv.limit(0))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(2)
    parents = {i: (None if i % 50 == 0 else rng.randrange(i // 50 * 50, i)) for i in range(150)}
    rows = [(i // 50, i, p, float(i % 7), "user", str(i)) for i, p in parents.items()] + [(9, 1, 2, 0.0, "u", "cycle"), (9, 2, 1, 0.0, "u", "cycle"), (9, 3, 2, 0.0, "u", "below")]
    found = chat.reply_paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")).collect()
    want = {}
    for leaf in set(parents) - set(parents.values()):
        path, at = [], leaf
        while at is not None:
            path.insert(0, at)
            at = parents[at]
        want[leaf] = path
    assert {r["leaf"]: r["path"] for r in found} == want
    for tree in range(3):
        mine = sorted((r for r in found if r["tree"] == tree), key=lambda r: r["rank"])
        assert [r["leaf"] for r in mine] == sorted((x for x in want if x // 50 == tree), key=lambda x: (-sum(n % 7 for n in want[x]), x))


# 3


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code\nmore"), ("a/b/d.py", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("e/f.py", None), ("a/b/COPYING.txt", words(500)), (None, ""), ("a/b/c.py", "code\nmore"), ("top", "")]
    got = licenses.scan(spark.createDataFrame([(*r, "clash") for r in rows], "path string, text string, license string")).collect()
    assert len(got) == len(rows)
    by = {r["path"]: (r["license"], r["origin"], r["from_dir"]) for r in got}
    assert by["a/LICENSE"] == ("MIT", "own", None) and by["a/b/c.py"] == ("MIT", "inherited", "a") and by["a/b/d.py"] == ("Apache-2.0", "own", None)
    assert by["e/f.py"] == (None, "none", None) and by[None] == (None, "none", None) and by["a/b/COPYING.txt"][1] == "inherited"
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def _cosines(files, templates, window=4):
    """Brute force: every run of lines and every whole file against every template, by dictionaries."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    n = len(files)
    seen = {w: sum(w in set(cut(t)) for t in files) for _, x in licenses.texts_of(templates) for w in cut(x)}
    weight = lambda w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1

    def vector(words_):
        return {w: words_.count(w) * weight(w) for w in set(words_)}

    def cosine(x, y):
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0

    out = []
    for t in files:
        lines = [cut(x) for x in (t or "").split("\n")]
        runs = [sum(lines[i : i + k], []) for i in range(len(lines)) for k in range(1, window + 1)] + [sum(lines, [])]
        out.append(max((cosine(vector(r), vector(cut(x))), name) for r in runs for name, x in licenses.texts_of(templates)))
    return out


def test_licences_against_brute_force(spark):
    rng = random.Random(11)
    notices = [x for _, x in licenses.texts_of(licenses.TEMPLATES)]
    files = [None, "", "\n\n", "the the the", "MIT", words(200, 5)]
    for k in range(60):
        notice = rng.choice(notices).split()
        changed = [w for w in notice if rng.random() > 0.02 * (k % 15)] + words(rng.randrange(1 + k % 7), k).split()
        for _ in range(rng.randrange(3)):
            changed.insert(rng.randrange(len(changed) + 1), "\n")
        files.append("\n".join([words(rng.randrange(1, 12), k + j) for j in range(k % 4)] + [" ".join(changed)] + [words(6, -k)] * (k % 3)))
    rows = [(f"d{k}/x{k}.c", t) for k, t in enumerate(files)]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect()}
    want = _cosines(files, licenses.TEMPLATES)
    assert 20 < sum(c >= 0.6 for c, _ in want) < len(want)
    for (path, _), (cosine, name) in zip(rows, want):
        r = got[path]
        assert abs(r["cosine"] - (cosine if cosine >= 0.6 else 0)) < 1e-9, path
        assert (r["own_license"] is None) == (cosine < 0.6)


def test_whole_licences_and_wrapped_notices(spark):
    """A full licence of over 400 words counts as a whole, and a notice that is wrapped over lines of a long file as one."""
    full = words(900, 4).replace(" big", "\nbig")
    header = "This Source Code Form is subject\nto the terms of the\nMozilla Public\nLicense, v. 2.0."
    rows = [("a/LICENSE", full), ("b/x.py", "\n".join(["code here"] * 300) + "\n" + header + "\n" + "\n".join(["more code"] * 300)), ("c/y.py", words(600, 8))]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string"), templates={**licenses.TEMPLATES, "Full": full.upper()}).collect()
    by = {r["path"]: (r["own_license"], r["line"], r["cosine"]) for r in got}
    assert by["a/LICENSE"][:2] == ("Full", 0) and by["a/LICENSE"][2] > 0.999
    alone = {r["path"]: (r["own_license"], r["line"]) for r in licenses.scan(spark.createDataFrame(rows[1:2], "path string, text string")).collect()}
    assert by["b/x.py"][:2] == ("MPL-2.0", 301) and alone["b/x.py"] == ("MPL-2.0", 301)


# 4


def test_chain_against_enumeration():
    rng = np.random.default_rng(1)
    transitions = rng.normal(size=(2, 2))
    for n in (1, 2, 7):
        scores = rng.normal(size=n) * 3
        total, ones = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s for s, t in zip(scores, tags) if t) + sum(transitions[a, b] for a, b in zip(tags, tags[1:])))
            w *= sum(0.5 * math.exp(transitions[a, tags[0]]) for a in (0, 1))  # the start's even message passes the transitions too
            total += w
            ones += w * np.array(tags)
        got = toxicity.Chain(transitions).run(np.tile(scores, 2), np.array([n, 0, n]))[0]
        assert np.allclose(got, np.tile(ones / total, 2))
    long = rng.normal(size=1000)
    joined = toxicity.Chain(transitions).run(long, np.array([1000]))[0]
    assert np.allclose(joined[:400], toxicity.Chain(transitions).run(long[:500], np.array([500]))[0][:400])


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows = [(words(60, i) + (" you idiot " + words(5, i) if i % 3 == 0 else "") + (" vequ" + rng.choice("abcd") if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(rows)
    out = {(r["doc_id"], r["text"]): r for r in toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert all(0 <= r["score"] < 0.3 and not r["spans"] for r in out.values())
    bad = spark.createDataFrame([(1, "So, you IDIOT there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(bad, model).collect()}
    assert got[1]["score"] >= 0.3 and "So, you IDIOT there"[got[1]["spans"][0]["start"] : got[1]["spans"][0]["end"]].endswith("IDIOT") and got[2]["score"] < 0.3
    assert toxicity.keep_clean(bad, model).count() == 1 and toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.fit([]).document_scores([np.empty(0)])[0] < 0.3


def test_held_out(spark):
    got = spark.range(50).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


# 5


def _covered(texts, length):
    seen = {}
    for i, t in texts:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            seen[raw[s : s + length]] = min(seen.get(raw[s : s + length], i), i)
    out = []
    for i, t in texts:
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] < i:
                hit[s : s + length] = True
        out.append((i, len(raw), int(hit.sum()), bytes(np.frombuffer(raw, np.uint8)[~hit])))
    return sorted(out)


@pytest.mark.parametrize("together", [1000, 0])
def test_suffix_dedup(docs, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    for length in (50, 20):
        got = suffix_dedup.dedup(docs, length=length).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), bytes(r["kept"])) for r in got) == _covered(TEXTS, length)


def test_suffix_dedup_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 300)
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(20, 90))) for _ in range(25)]
    texts = [(i, "".join(rng.choice(parts) for _ in range(4))) for i in range(40)]
    got = suffix_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), bytes(r["kept"])) for r in got) == _covered(texts, 50)


@pytest.mark.parametrize("together", [1000, 2, 0])
def test_suffix_dedup_repeats_within_a_document(spark, monkeypatch, together):
    """The least document of a stretch holds it more than once; each copy is compared with what a smaller document has."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(5)
    x, y, a, b = ("".join(rng.choices(string.ascii_letters, k=120)) for _ in range(4))
    texts = []
    for i, size in enumerate((55, 80, 150, 400)):
        p = "".join(rng.choices(string.ascii_letters, k=size))
        texts += [(10 * i, x[i:] + p + y), (10 * i + 1, a[i:] + p + b + a[i:] + p + b + a[i:] + p + b), (10 * i + 2, b + a[i:] + p + b)]
    got = suffix_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), bytes(r["kept"])) for r in got) == _covered(texts, 50)


def test_suffix_dedup_edges(spark, docs, empty):
    assert suffix_dedup.dedup(empty).count() == 0
    nulls = spark.createDataFrame([(None, "q" * 90), (1, "q" * 90), (None, None)], "doc_id long, text string")
    assert all(r["n_bytes"] == len(r["kept"]) for r in suffix_dedup.dedup(nulls).collect())
    out = suffix_dedup.rewrite(docs, chars_col="row")
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert {r["text"] for r in out.where("doc_id = 3").collect()} == {""} and out.where("doc_id = 1 AND text IS NULL").count() == 1


def test_rewrite_of_equal_ids_and_sizes(spark):
    rng = random.Random(6)
    p, q, r = ("".join(rng.choices(string.ascii_letters, k=100)) for _ in range(3))
    rows = [(0, p), (1, p + "mine"), (1, q + "then"), (1, r[:50] + p[:50] + "last")]
    out = suffix_dedup.rewrite(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, out.collect())) == sorted([(0, p), (1, "mine"), (1, q + "then"), (1, r[:50] + "last")])


def test_suffix_dedup_rows_of_many_buckets():
    """What a record ships hardly grows when a block's records go to many buckets, as they do in larger tables."""
    rng = random.Random(12)
    parts = [bytes(rng.choices(b"abcdefgh ", k=60)) for _ in range(300)]
    texts = [b"".join(rng.choice(parts) + bytes(rng.choices(b"abcd", k=30)) for _ in range(8)) for _ in range(1500)]
    text = suffix_dedup._Text(texts, 50)
    words, _, first, count = suffix_dedup._records(text)
    ids = np.arange(len(texts)) * 7 + 10**6
    own = ids[np.searchsorted(text.offsets, first, "right") - 1]
    size = {}
    for buckets in (1, 150):
        at = suffix_dedup._spread(suffix_dedup._mix(words[0]), buckets)
        shipped = list(suffix_dedup._ship(3, ids, text.offsets, at, first, [], [count.astype(np.uint8)], count, suffix_dedup.RECORDS))
        size[buckets] = sum(r.column(2).nbytes for r in shipped)
        assert len(shipped) == buckets
        back = [c for r in shipped for _, c in suffix_dedup._opened([(r.column(1)[0].as_py(), r.column(2)[0].as_py())])]
        got = sorted(zip(*[np.concatenate(c).tolist() for c in list(zip(*back))[1:]]))
        assert got == sorted(zip(own.tolist(), first.tolist(), count.tolist()))
    assert size[150] - size[1] < 4 * len(first), (size, len(first))


def test_workers_let_go_what_another_operator_kept(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "_OWNER", [])

    def run(batches):
        yield from batches

    for module, left in (("a", 1), ("a", 1), ("b", 0)):
        run.__module__ = module
        if module == "a":
            common.taken_over("a")
            common.kept(("model",), dict)
        list(common.lean(run)(iter([])))
        assert len(common._KEPT) == left


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_shuffles_go_with_checkpoints(spark, docs):
    """A round's shuffle is off the disk when its result is checkpointed; rows before a checkpoint can still be asked for."""
    dealt = spark.range(1000).repartition(4, "id")
    assert common.checkpoint(dealt).count() == 1000 and dealt.where("id < 10").count() == 10
    assert spark.conf.get(common.FREED) == "false"
    given = common.checkpoint(docs)  # they are dealt out by a shuffle of their own
    before = _shuffle_files(spark)
    found = suffix_dedup.covered_windows(given)
    left = lambda: sum(size for name, size in _shuffle_files(spark).items() if name not in before)
    for _ in range(50):  # they go in the background
        if left() < 1000:
            break
        time.sleep(0.1)
    assert left() < 1000  # a count's
    assert sum(bool(r["hits"]) for r in found.collect())


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    assert (suffix_dedup.multikey_order(keys) == np.lexsort(keys[::-1])).all()


# 6


@pytest.mark.parametrize("hot", [0, 400])
def test_sharding(spark, hot):
    rng = random.Random(1)
    rows = [(i, words(rng.randrange(1, 60), i % 250)) for i in range(600)] + [(1000 + i, "hot text") for i in range(hot)] + [(None, None), (5, "")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    assert len(got) == len(rows) and all(r["size"] >= 1 for r in got)
    totals = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(totals) - min(totals) < 0.05 * sum(totals) / 8
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    shards = {}
    for r in got:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for crc, x in shards.items() if crc != zlib.crc32(b"hot text"))
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7


def test_multiset_hash(spark, docs, empty):
    got = multiset_hash.fingerprint_documents(docs).collect()
    ordered = sorted(TEXTS, key=lambda x: (x[0], x[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    prints = {}
    for r in got:
        prints.setdefault(tuple(r["fingerprint"]), set()).add(r["doc_id"])
    assert all(x in prints.values() for x in ({0, 3}, {-3, 14}, {1, 2}))
    assert multiset_hash.fingerprint_documents(empty).count() == 0
    two = spark.createDataFrame([("A b. C d.\nE",), ("E\nC d. A b.",)], "t string").select(multiset_hash.fingerprint(multiset_hash.units(F.col("t"))).alias("f"))
    assert two.distinct().count() == 1
    extra = F.array(F.lit("new"), F.lit("new"))
    back = two.select((multiset_hash.delete(multiset_hash.insert(F.col("f"), extra), extra) == F.col("f")).alias("ok"), (multiset_hash.insert(F.col("f"), extra) != F.col("f")).alias("other"))
    assert all(r["ok"] and r["other"] for r in back.collect())


# 8


def _simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, _simhash(t)) for i, t in TEXTS]
    assert sorted((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == sorted(prints)
    assert simhash.near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in simhash.representatives(docs).select("doc_id").collect()} >= {0, 4, 6} and 3 not in {r["doc_id"] for r in simhash.representatives(docs).collect()}


@pytest.mark.parametrize("pairwise", [32, 2])
def test_simhash_links(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for b in base for _ in range(9)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = common.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    group = {v: v for v in signed}
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a % (1 << 64)) ^ (b % (1 << 64))).bit_count() <= 2]
    for _ in range(20):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert {r["node"]: r["component"] for r in found.collect()} == {v: group[v] for v in {x for p in pairs for x in p}}


# 9


@pytest.mark.parametrize("bound", [1_000_000, 1])
def test_near_copies_by_shingles(spark, empty, monkeypatch, bound):
    """Recall and precision at similarity 0.8 against brute force; also a line that all have, and many copies of one text."""
    monkeypatch.setattr(shingle_dedup, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(shingle_dedup, "REMEMBERED", bound)
    monkeypatch.setattr(shingle_dedup, "LEADERS", min(bound, 16))
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    rows = [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (904, "a b c d e f")]
    for base in range(40):
        text = [word() for _ in range(rng.randrange(60, 300))]
        for copy in range(12 if base == 0 else 3):
            changed = list(text)
            for _ in range(copy and rng.randrange(1, max(2, len(text) // 30))):
                changed[rng.randrange(len(text))] = word()
            rows.append((20 * base + copy, "all of the texts have this line in common " + " ".join(changed)))
    rng.shuffle(rows)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    n_links = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            n_links += a < 800
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert n_links > 60
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(given).collect()}
    assert got == {i: top(i) for i in sets}
    assert {r["doc_id"] for r in shingle_dedup.representatives(given).collect()} == {i for i in sets if top(i) == i}
    import corpus_pipeline

    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, given, "").collect()} == {i for i in sets if top(i) == i}
    assert shingle_dedup.near_duplicates(empty).count() == 0


def test_sketches_rule_out_no_similar_pair(spark):
    """The bound on differing shingles is never too high; texts that share one line are dropped before their sets travel."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(1 << 63), 1 << 63, n)) for n in (1, 5, 64, 65, 700, 1000)]
    for x, y in itertools.product(sets, sets):
        for shared in (0, len(x) // 2, len(x) - len(x) // 20, len(x)):
            z = np.unique(np.concatenate((x[:shared], y[shared:])))
            assert shingle_dedup._differing(shingle_dedup._sketch(x), shingle_dedup._sketch(z)) <= len(np.setxor1d(x, z))
    line = rng.integers(-(1 << 63), 1 << 63, 20)
    rows = [np.unique(np.concatenate((line, rng.integers(-(1 << 63), 1 << 63, 300)))) for _ in range(20)]
    rows += [np.unique(np.concatenate((r[:295], rng.integers(-(1 << 63), 1 << 63, 10)))) for r in rows]
    sketches = spark.createDataFrame([(i, len(r), shingle_dedup._sketch(r)) for i, r in enumerate(rows)], "node long, n long, sketch binary")
    pairs = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "a long, b long")
    assert sorted(map(tuple, shingle_dedup._promising(pairs, sketches).collect())) == [(i, 20 + i) for i in range(20)]


def test_sets_travel_to_few_cells(spark):
    """Texts with the same sixteen leaders bring their sets to a cell once, not once a leader; no pair is lost."""
    pairs = {(a, b) for a in range(16) for b in range(16, 1016)} | {(5000, b) for b in range(5001, 5400)} | {(a, a + 7000) for a in range(9000, 9100)}
    out = {(r["a"], r["b"], r["cell"]) for r in shingle_dedup._cells(spark.createDataFrame(sorted(pairs), "a long, b long").repartition(3)).collect()}
    assert {(min(a, b), max(a, b)) for a, b, _ in out} == pairs and len(out) == len(pairs)
    travel = {(node, cell) for a, b, cell in out for node in (a, b) if node < 1016}
    per_cell = {}
    for a, b, cell in out:
        per_cell.setdefault(cell, set()).update((a, b))
    assert len(travel) < 4 * 1016 and max(map(len, per_cell.values())) < 4 * shingle_dedup.CELL


def test_prefixes_of_repeated_shingles(spark, monkeypatch):
    """Counts over the whole table, in chunks and ranges, against brute force; what one text only has gets no bucket."""
    monkeypatch.setattr(shingle_dedup, "CHUNK", 200)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(60)] for _ in range(6)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*bases, *[b[:30] + [word()] + b[31:] for b in bases], *[[word() for _ in range(40)] + passage for _ in range(20)], passage, passage[:9], ["one"], []])]
    sets = {shingle_dedup._node(x): x.tolist() for x in (shingle_dedup.shingles(t) for _, t in rows)}
    texts = {}
    for x in itertools.chain(*sets.values()):
        texts[x] = texts.get(x, 0) + 1
    want = set()
    for node, found in sets.items():
        ordered = sorted(found, key=lambda x: (texts[x], x))
        alone = sum(texts[x] == 1 for x in found)
        want |= {(x, node, len(found), at, alone) for at, x in enumerate(ordered[: len(found) - math.ceil(0.8 * len(found)) + 1]) if texts[x] > 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked, keyed = shingle_dedup._marked(docs, "doc_id", "text", 5)
    assert {(r["key"], r["node"], r["n"], r["at"], r["alone"]) for r in keyed.collect()} == want
    assert 13 < len({w[1] for w in want}) < 20  # texts with the passage and as much of their own have no row
    assert {(r["doc_id"], r["node"], r["n"]) for r in marked.collect()} == {(i, shingle_dedup._node(x), len(x)) for i, x in ((i, shingle_dedup.shingles(t)) for i, t in rows)}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch, bound):
    """Copies with up to eight edits, most of them not similar to most others: pairs grow with the texts, and no link is lost."""
    monkeypatch.setattr(shingle_dedup, "DRIVER_LINKS", bound, raising=False)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    base, rows = [word() for _ in range(150)], []
    for i in range(400):
        changed = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 9)):
            changed[at] = word()
        rows.append((i, " ".join(changed)))
    sets = {i: set(shingle_dedup.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    made, promising = [], shingle_dedup._promising
    monkeypatch.setattr(shingle_dedup, "_promising", lambda pairs, *a: made.append(pairs.count()) or promising(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_duplicates(docs).collect()} == {i: top(i) for i in sets}
    assert made[1] < len(rows)  # left after the leaders


def test_near_copies_come_through_simhash(spark, monkeypatch):
    """The stage's nearest copies are found by fingerprints and their pigeonring join; its links are then verified."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    rows = []
    for base in range(12):
        text = [word() for _ in range(400)]
        rows += [(10 * base + copy, " ".join([*text[:-1], word()] if copy else text)) for copy in range(4)]
    sets = {i: shingle_dedup.shingles(t) for i, t in rows}
    prints = {shingle_dedup._node(x): simhash.majority(x.view(np.uint64)) for x in sets.values()}
    near = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    given = spark.createDataFrame([(node, fp - (1 << 64) if fp >> 63 else fp) for node, fp in prints.items()], "node long, fp long")
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in shingle_dedup.simhash_pairs(given).collect()}
    assert len(near) > 20 and pairs <= near

    def groups(edges):
        found = common.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()
        return {r["node"]: r["component"] for r in found}

    assert groups(pairs) == groups(near)
    import corpus_pipeline

    joined, compared = [], []
    links, verified = shingle_dedup.links, shingle_dedup._verified
    monkeypatch.setattr(shingle_dedup, "links", lambda *a: joined.append(a) or links(*a))
    monkeypatch.setattr(shingle_dedup, "_verified", lambda *a: compared.append(out := verified(*a)) or out)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {10 * base for base in range(12)}
    assert len(joined) == 1 and {tuple(sorted((r["a"], r["b"]))) for r in compared[0].collect()} >= pairs


def test_perfect_hash():
    for n in (0, 1, 2, 37, 5000):
        hashes = np.array([token_files.key_hash(i) for i in range(n)], np.uint64)
        _, slots = token_files.build_index(hashes)
        assert sorted(slots.tolist()) == list(range(n))


def test_other_tokenizers_encode_whole_texts(monkeypatch):
    """A tokenizer that keeps spaces is not asked run by run."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = token_files.Encoder(path)
    assert not own.by_runs and token_files.Encoder(public_tokenizers.path("word_bpe_49k.json")).by_runs
    texts = ["Two  words", " a\n b", None, "é 漢"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts, None)] == want


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write(docs, folder, path)
    got = sorted(token_files.read(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in TEXTS) and manifest["ids"] == sum(r["n_tokens"] for r in got)
    want = sorted((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS)
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want
    assert all(r["start"] == sum(x["n_tokens"] for x in got[:k]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for k, r in enumerate(got))
    assert token_files.lookup(folder, 6).tolist() == next(x for i, x in want if i == 6) and token_files.lookup(folder, 777) is None
    assert token_files.lookup(folder, 5, 1) is not None and token_files.lookup(folder, 5, 2) is None
    files = token_files.TokenFiles(folder)
    rows = {}
    for r in got:
        rows.setdefault(r["doc_id"], []).append(r["ids"])
    assert all(files.lookup(i, k).tolist() == ids for i, all_ in rows.items() for k, ids in enumerate(all_))
    assert all(files.lookup(i) is None for i in (-10, 11, 10**12, None))
    nulls = spark.createDataFrame([(None, "x"), (None, "y z"), (4, "q"), (-(1 << 63), "least")], "doc_id long, text string")
    token_files.write(nulls, f"{folder}-nulls", path)
    again = token_files.TokenFiles(f"{folder}-nulls")
    assert {tuple(again.lookup(None, k).tolist()) for k in (0, 1)} == {(*tokenizer.encode(t, add_special_tokens=False).ids, 2) for t in ("x", "y z")}
    assert again.lookup(-(1 << 63)).tolist() == [*tokenizer.encode("least", add_special_tokens=False).ids, 2] and again.lookup(None, 2) is None
    token_files.remove(f"{folder}-nulls")
    assert not (tmp_path / "tokens-nulls").exists()
    token_files.write(empty, f"{folder}-empty", path)
    assert token_files.read(spark, f"{folder}-empty").count() == 0


# 10


def _contamination(texts, items):
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for window, names in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit.update(range(s, s + len(window)))
                    found |= names
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_decontamination(spark, docs, empty, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    items = [(1, PASSAGE), (2, "ALPHA beta"), (3, None), (4, ""), (5, "zz zz zz"), (10, words(40, 1)), (11, "nowhere to be seen at all in any of these texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == _contamination(TEXTS, items)
    clean = {i for i, _, hit, _ in _contamination(TEXTS, items) if not hit}
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    spans = decontaminate.remove_spans(docs, bench).collect()
    assert len(spans) == len(TEXTS) and {r["text"].strip() for r in spans if r["doc_id"] == 15} == {""}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    given = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "sentencepiece":
            assert docs.columns == given.columns and 0 < docs.count() <= given.count()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    decoded = sentencepiece_lattice.decode(docs, MODEL).toPandas()
    assert isinstance(decoded, pd.DataFrame) and set(decoded.doc_id) == set(texts) and all(texts[i] == t for i, t in zip(decoded.doc_id, decoded.text))
