"""The training-data operators against brute force, exact round trips and planted cases."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tablewright.llm.components import connected_components
from tablewright.llm.shared import CHARS_A_WORD, Memory
from tablewright.llm import (embedding_dedup, license_scan, lm_scoring, ngram_join, packing, quality_classifier, quality_rules,
                             sentencepiece_bpe, suffix_dedup, toxicity)

DOCS = "doc_id long, text string, kept string, n_words string"  # two columns that clash with results


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(parts)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "a text without an id " * 8), (70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "é " * 40), (75, "x" * 60000),
       (76, prose(1, 60)), (76, prose(1, 60)), (77, prose(1, 60))]


# -- quality rules

def plain_counts(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed)


def test_quality_rules_count_as_plain_python_does(spark):
    rows = ODD + [(1, prose(2, 30) + "\n" + prose(2, 30)), (2, "a#b $% é\n\na#b $% é\nlast"), (3, prose(3, 200))]
    got = sorted((tuple(r)[:7] for r in quality_rules.quality_rules(frame(spark, rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted(((i, *plain_counts(t)) for i, t in rows), key=str)


def test_quality_rules_reject_noise_and_repeats(spark):
    r = random.Random(4)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9)) for _ in range(500))
    block = " ".join(f"{prose(5, 5)} n{i}" for i in range(300))
    kept = {x.doc_id: x.kept for x in quality_rules.quality_rules(frame(spark, [(1, noise), (2, block)])).collect()}
    assert kept == {1: False, 2: False}
    same = quality_rules.keep_good(frame(spark, ODD))  # the rows of ordinary words stay, repeated ones too
    assert same.columns == ["doc_id", "text", "kept", "n_words"] and sorted(r.doc_id for r in same.collect()) == [76, 76, 77]


def test_quality_rules_keep_long_clean_texts_and_reject_long_noise(spark):
    sf = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    texts = {}
    for r in good.select("doc_id", "lang", "text").orderBy("doc_id").collect():
        texts.setdefault(r.lang, {})[r.text] = None
    rows = []
    for lang in ("de", "es", "fr"):
        joined = "\n".join(texts[lang])
        rows += [(len(rows) + k, joined[:n]) for k, n in enumerate((500_000, 1_000_000)) if len(joined) >= n]
    assert rows
    r = random.Random(6)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9)) for _ in range(60_000))
    got = {x.doc_id: x for x in quality_rules.quality_rules(frame(spark, [*rows, (900, noise), (901, rows[0][1] * 2)])).collect()}
    assert not got[900].kept and not got[901].kept
    assert [(i, got[i].whole_ratio, got[i].block_ratio) for i, _ in rows if not got[i].kept] == []


def test_quality_rules_reject_varied_repeats_across_blocks(spark):
    # passages of clean text over one block long, one word in seven of each copy replaced, beside the clean text itself
    sf = "/root/testdata/sf0.1"
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    texts = {}
    for r in good.select("doc_id", "lang", "text").orderBy("doc_id").collect():
        texts.setdefault(r.lang, {})[r.text] = None
    rows, clean = [], []
    for lang in ("de", "en", "es", "fr"):
        mixed = random.Random(1).sample(list(texts[lang]), len(texts[lang]))  # near copies have neighbouring ids
        words = "\n".join(mixed).split(" ")
        for size in (66_000, 100_000, 300_000):
            passage, r = " ".join(words)[:size].split(" "), random.Random(size)
            clean.append((len(clean), " ".join(passage)))
            for copies in (2, 5, 16):
                rows.append((1000 + len(rows), " ".join(r.choice(words) if r.random() < 1 / 7 else w for _ in range(copies) for w in passage)))
    got = {x.doc_id: x for x in quality_rules.quality_rules(frame(spark, rows + clean)).collect()}
    assert [(i, got[i].whole_ratio) for i, _ in rows if got[i].kept] == []
    assert sum(not got[i].base_failed and got[i].block_ratio >= 0.375 for i, _ in rows) >= 8  # seen by the whole ratio alone
    assert [(i, got[i].whole_ratio, got[i].block_ratio) for i, _ in clean if not got[i].kept] == []


def test_quality_rules_of_an_empty_table(spark):
    assert quality_rules.quality_rules(frame(spark, []).limit(0)).count() == 0 and quality_rules.keep_good(frame(spark, []).limit(0)).count() == 0


# -- classifiers

@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_models_without_two_classes(module):
    for texts, labels in (([], []), (["a b"], [1])):
        scores = module.fit(texts, labels).scorer()(["a", "", None])
        assert all(0 <= s <= 1 for s in scores)


def test_toxic_words_are_found_whatever_the_length(spark):
    clean = [prose(i, 60, 3000) for i in range(300)]
    bad = [prose(1000 + i, 30, 3000) + " you horrible wretch " + prose(2000 + i, 30, 3000) for i in range(300)]
    model = toxicity.fit(clean + bad, [0] * 300 + [1] * 300)
    rows = [(1, prose(5000, 3000, 3000)), (2, prose(5001, 2000, 3000) + " wretch " + prose(5002, 10, 3000)), (3, "wretched"), *ODD]
    scores = {(r.doc_id, r.score >= 0.5) for r in toxicity.toxicity_scores(frame(spark, rows), model).collect() if r.doc_id in (1, 2)}
    assert scores == {(1, False), (2, True)}
    assert toxicity.keep_civil(frame(spark, rows), model).where("doc_id = 2").count() == 0


@pytest.mark.parametrize("name, label, modulus, remainder, least", [
    ("op4_quality_classifier", "quality", 3, 1, 0.9), ("op6_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = entry.queries()[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in tested) / len(tested) >= least


# -- tokens

def test_packing_holds_every_id_once(spark):
    rows = ODD + [(i, prose(i, 37 * i % 900)) for i in range(1, 40)] + [(90, "two  spaces "), (91, "<|endoftext|> x"), (92, "a \n b")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=str)
    pieces = packing.packed(frame(spark, rows)).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    for doc, ids in want:
        found = {p.ids_crc32 for p in by_doc[(doc, len(ids))] for x in [ids[p.start:p.start + p.length]]
                 if p.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes())}
        assert found
    assert len(by_sequence) * 1024 < sum(p.length for p in pieces) + 4 * 1024


def test_sum_of_squares_step():
    p = packing.Packer(10)
    for doc, size in enumerate([6, 6, 4]):
        p.add(doc, size)
    # two sequences at level 6: filling one of them lowers the sum of squares, opening a third does not
    assert sorted(x[0] for x in p.out) == [1, 2] and p.level[6] == 1


def test_packing_encodes_whole_texts_without_memory(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, coder = Tokenizer.from_file(path), packing.WordEncoder(path)
    r = random.Random(4)
    texts = ["".join(r.choice("abethé's 'll\n\t  ,.12中９\u00a0\u0085\u2028#") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    texts += ["a" + " " * 3000 + "b", "x\n\n", "two  spaces ", "<|endoftext|> x", "a" * 5000, None, ""]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    seen = []
    monkeypatch.setattr(coder, "whole", lambda t, whole=coder.whole: seen.append(t) or whole(t))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder(texts)] == want
    assert seen == ["<|endoftext|> x"]
    blanks = "a" + "\n" * 2_000_000 + "b"  # more than the pattern of the faster library can take
    assert np.frombuffer(coder([blanks])[0], "<u4").tolist() == tok.encode(blanks, add_special_tokens=False).ids


def test_sentencepiece_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(7)
    texts = ["", None, " ", "   a", "a   ", "\n\n  x  y", " ▁ a▁▁b", "日本😀 é", "<s> </s>", "a\x00b\tc", " " * 40 + "a" + " " * 33]
    texts += ["".join(r.choice("abcdefthenoru  ,.\né中129=#*▁") for _ in range(r.randint(1, 80))) for _ in range(2000)]
    texts += ["".join(model.id_to_piece(r.randrange(259, 32000)).replace("▁", " ") for _ in range(r.randint(1, 20))) for _ in range(2000)]
    rows = {x.doc_id: x for x in sentencepiece_bpe.sentencepiece_digests(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_eos=True)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_what_is_remembered_is_bounded_in_characters():
    memory = Memory(100)
    for k in range(200):
        for w in memory.missing([chr(19968 + k) * 900, "often"]):
            memory.young[w] = len(w)
        assert memory.young["often"] == 5
        assert sum(map(len, [*memory.young, *memory.old])) <= 2 * 100 * CHARS_A_WORD + 2 * 905
    r = random.Random(12)
    han = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(5000)) for _ in range(6)] + ["", None, "plain words"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder(han)] == [tok.encode(t or "", add_special_tokens=False).ids for t in han]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = sentencepiece_bpe.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for t in han:
        ids = library.encode(t or "", add_eos=True)
        assert codec.digest_parts(t or "") == (len(ids), " ".join(map(str, ids)), library.decode(ids).encode())



# -- duplicates

def plain_near_duplicates(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    return {rows[k][0]: (links[k], min(rows[j][0] for j in range(len(rows)) if root[j] == root[k])) for k in range(len(rows))}


def test_ngram_join_finds_every_link(spark):
    r, base, rows = random.Random(9), [prose(i, 70) for i in range(12)], []
    for i in range(260):
        words = (base[0] if i % 2 else r.choice(base)).split()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            words[r.randrange(len(words))] = f"w{r.randrange(400)}"
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "a b c")]
    got = {x.doc_id: (x.n_links, x.class_id) for x in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_near_duplicates(rows)
    assert ngram_join.near_duplicates(frame(spark, ODD)).count() == len(ODD)
    assert ngram_join.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_ids_with_different_texts_link_by_their_texts(spark):
    a, b, c = (prose(100 + k, 70) for k in range(3))
    near = lambda t: t.replace(t.split()[-1], "other")
    rows = [(7, a), (7, b), (3, b), (20, near(a)), (5, a), (2, c), (2, near(b)), (30, near(c)), (8, a + " end"), (8, a), (7, None)]
    got = sorted(((x.doc_id, x.n_links, x.class_id) for x in ngram_join.near_duplicates(frame(spark, rows)).collect()), key=str)
    by_row = plain_near_duplicates([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, (_, root) in by_row.items():
        least[root] = min(rows[k][0], least.get(root, rows[k][0]))
    assert got == sorted(((rows[k][0], n, least[root]) for k, (n, root) in by_row.items()), key=str)
    groups = {root for _, root in by_row.values()}
    stay = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    index = {r: k for k, r in enumerate(rows)}
    assert sorted(by_row[index[x.doc_id, x.text]][1] for x in stay) == sorted(groups)  # one row of every group
    assert all(x.doc_id == least[by_row[index[x.doc_id, x.text]][1]] for x in stay)


def plain_passages(rows, size=50):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - size + 1 if i is not None else 0):
            w = b[p:p + size]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1 if i is not None else 0):
            if least[b[p:p + size]] < i:
                gone[p:p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_removes_exactly_the_repeated_bytes(spark):
    r, rows = random.Random(3), []
    for i in range(150):
        t = "".join(r.choice(["ab", "cd", "the ", "xyz", "é", "\n", " q", "\0"]) for _ in range(r.randint(0, 120)))
        if rows and r.random() < 0.6:
            other = r.choice(rows)[1]
            a, n = r.randint(0, max(0, len(other) - 1)), r.choice([20, 45, 50, 51, 60, 200])
            t = t[:r.randint(0, len(t))] + other[a:a + n] + t[r.randint(0, len(t)):]
        rows.append((i, t))
    rows += [(5, "a" * 500), (900, "a" * 300), (901, None), (None, "a" * 100), (902, ""), (903, "ab" * 200), (7, "ab" * 100)]
    assert sorted(map(tuple, suffix_dedup.repeated_passages(frame(spark, rows)).collect()), key=str) == plain_passages(rows)
    cut = suffix_dedup.without_repeats(frame(spark, rows))
    assert cut.columns == ["doc_id", "text", "kept", "n_words"] and cut.count() == len(rows)
    assert suffix_dedup.repeated_passages(frame(spark, []).limit(0)).count() == 0


def test_suffix_order_is_right_even_if_hashes_collide(monkeypatch):
    text = np.random.default_rng(1).integers(97, 99, (200, 12)).astype(np.uint8)
    group = np.sort(np.random.default_rng(2).integers(0, 9, 200))
    for symbols in (suffix_dedup._symbols, np.zeros(256, np.uint64)):  # the second makes all hashes equal
        monkeypatch.setattr(suffix_dedup, "_symbols", symbols)
        order, common = suffix_dedup.Suffixes(text).order(group)
        want = sorted(range(200), key=lambda k: (group[k], text[k].tobytes()))
        assert [(group[k], text[k].tobytes()) for k in order] == [(group[k], text[k].tobytes()) for k in want]
        for a, b, n in zip(order, order[1:], common[1:]):
            if group[a] == group[b]:
                assert n == next((j for j in range(12) if text[a][j] != text[b][j]), 12)


def test_linked_vectors_equal_brute_force(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(30, 16))
    x = [(centre[i % 30] + r.normal(size=16) * (0.05 if i % 3 else 0.4)).tolist() for i in range(300)] + [centre[0].tolist()] * 5
    rows = [(i, v, "c") for i, v in enumerate(x)] + [(990, None, "c"), (991, [0.0] * 16, "c"), (992, [float("nan")] * 16, "c"),
                                                   (993, [1.0, None] * 8, "c"), (994, [1.0], "c"), (995, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.linked_vectors(df).collect()}
    u = embedding_dedup.unit(np.array(x))
    near = u @ u.T >= 0.95
    i, j = np.nonzero(np.triu(near, 1))
    root = embedding_dedup.roots_of(len(x), i, j)
    assert got == {k: (int(near[k].sum()) - 1, int(root[k])) for k in range(len(x))} | {k: (0, k) for k in range(990, 996)}


def test_linked_vectors_of_uneven_spectra_and_of_every_length(spark):
    r, rows = np.random.default_rng(6), []
    for n, width, power in ((500, 64, 1.5), (400, 384, 1.5), (120, 96, 1.0), (20, 8, 1.0)):
        scale = np.arange(1, width + 1.0) ** -power  # links differ along the main directions of the data
        half = embedding_dedup.unit(r.normal(size=(n // 2, width)) * scale)
        away = r.normal(size=half.shape) * scale
        away = embedding_dedup.unit(away - (away * half).sum(1, keepdims=True) * half)
        rows += np.concatenate([half, 0.955 * half + np.sqrt(1 - 0.955 ** 2) * away]).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {g.vec_id: g.n_links for g in embedding_dedup.linked_vectors(df).collect()}
    want = {}
    for width in (64, 384, 96, 8):
        ids = [k for k, v in enumerate(rows) if len(v) == width]
        u = embedding_dedup.unit(np.array([rows[k] for k in ids]))
        want |= dict(zip(ids, ((u @ u.T >= 0.95).sum(1) - 1).tolist()))
    assert got == want and min(want.values()) >= 1


def test_linked_vectors_of_repeated_ids_and_of_any_magnitude(spark):
    r = np.random.default_rng(8)
    a, b, c, d = r.normal(size=(4, 16))
    near = lambda v: v + 0.01 * r.normal(size=16)
    vectors = [(1, a), (1, b), (2, near(a)), (3, near(b)), (7, c * 1e300), (9, near(c) * 1e-320 * 1e10), (9, c * 1e300), (5, d), (5, d), (4, near(b))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>")
    u = embedding_dedup.unit(np.array([v for _, v in vectors]))
    near = u @ u.T >= 0.95
    root = embedding_dedup.roots_of(len(u), *np.nonzero(np.triu(near, 1)))
    want = [(i, int(near[k].sum()) - 1, min(j for (j, _), x in zip(vectors, root) if x == root[k])) for k, (i, _) in enumerate(vectors)]
    got = sorted((g.vec_id, g.n_links, g.component_id) for g in embedding_dedup.linked_vectors(df).collect())
    assert got == sorted(want) and (1, 1, 1) in got and (1, 2, 1) in got
    assert embedding_dedup.linked_vectors(df.limit(0)).count() == 0


def test_linked_vectors_over_many_blocks_and_with_equal_fingerprints(spark, monkeypatch):
    r = np.random.default_rng(9)
    base = r.normal(size=(150, 40))
    x = np.concatenate([base, base + 0.1 * r.normal(size=base.shape), np.repeat(base[:1], 300, 0), base[1] + 0.02 * r.normal(size=(90, 40))]).astype(np.float32)
    x[-1] = -0.0
    x[-1, 0], x[-2] = 1, 0.0
    x[-2, 0] = 1  # the last two differ in the sign of zeros only
    u = embedding_dedup.unit(x.astype(np.float64))
    near = u @ u.T >= 0.95
    root = embedding_dedup.roots_of(len(x), *np.nonzero(np.triu(near, 1)))
    want = [(k, int(near[k].sum()) - 1, int(root[k])) for k in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for name, value in (("NUMBERS", 1024), ("LEAST", 64), ("HELD", 100), ("AREA", 1 << 10)):  # the last two hold in this process only
        monkeypatch.setattr(embedding_dedup, name, value)
    row = {"vectors": x.tobytes(), "n": 40, "copies": np.ones(len(x), "<i8").tobytes(), "first": 0, "cells": [0], "ends": [len(x)]}
    block = embedding_dedup.Block(row, "<f4", None, embedding_dedup.leading_axes(u))
    found = embedding_dedup._links(block, block, 0.95, 0).to_pydict()
    assert dict(zip(found["key"], zip(found["links"], found["root"]))) == {k: (n, m) for k, n, m in want if n}
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in embedding_dedup.linked_vectors(df).collect()) == want
    monkeypatch.setattr(embedding_dedup, "fingerprint", lambda v: F.pmod(F.xxhash64(v), F.lit(50)))
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in embedding_dedup.linked_vectors(df).collect()) == want


RECORDS = """
import sys
import numpy as np
from tablewright.llm import embedding_dedup
from tablewright.session import build_session

spark = build_session("records", "local[4]", 4, spark__eventLog__enabled="true", spark__eventLog__compress="false",
                      spark__eventLog__dir=sys.argv[1])
x = np.random.default_rng(3).normal(size=(3000, 64))
df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
assert embedding_dedup.linked_vectors(df).where("n_links = 0").count() == 3000
spark.stop()
"""


def test_linked_vectors_are_not_shuffled_for_every_cell_they_go_to(folder):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", RECORDS, folder], check=True, timeout=300, cwd=root, env=os.environ | {"PYTHONPATH": root})
    written = 0
    for name, _, files in os.walk(folder):
        for line in (x for f in files if not f.endswith(".crc") for x in open(f"{name}/{f}")):
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd":
                written += (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
    assert 3000 <= written < 10 * 3000


def test_components_of_hubs_and_paths(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, 5000) for k in range(400, 900)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {k: 0 for k in range(400)} | {k: 400 for k in [*range(400, 900), 5000]} | {k: 1000 for k in range(1000, 1061)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup_leaves_other_columns_alone_whatever_their_name(spark):
    shared = prose(31, 40)
    rows = [(i, f"{prose(40 + i, 30)} {shared} {prose(60 + i, 30)}", 7 + i, 90 + i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, __chunk int")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert [(got[i].chunk, got[i]["__chunk"]) for i in range(3)] == [(7 + i, 90 + i) for i in range(3)]
    assert got[0].text == rows[0][1] and all(shared not in got[i].text for i in (1, 2))


# -- licences and language model

def test_license_scan_on_odd_texts(spark):
    rows = ODD + [(1, prose(1, 900) + "\nReleased under the MIT License.\n" + prose(2, 900)), (2, "all RIGHTS reserved"), (3, "under the MIT")]
    got = {(x.doc_id, x.license_id) for x in license_scan.license_matches(frame(spark, rows), license_scan.templates(spark)).collect()}
    assert got == {(1, "MIT"), (2, "reserved")}


def test_license_scan_takes_the_best_template_and_version(spark):
    r = [
        (1, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (2, "// SPDX-License-Identifier: MIT"), (3, "# SPDX-License-Identifier: GPL-2.0-or-later"),
        (4, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
        (5, "This work is licensed under the GNU General Public License, version 3."),
        (6, "Licensed under the GNU General Public License, version 3."),
        (7, "SPDX-License-Identifier: GPL-2.0 and SPDX-License-Identifier: GPL-3.0"), (None, "All rights reserved."), (None, "SPDX-License-Identifier: MIT")]
    got = sorted(((x.doc_id, x.license_id, x.containment) for x in license_scan.license_matches(
        frame(spark, r), license_scan.templates(spark)).collect()), key=str)
    assert got == sorted([(1, "GPL-3.0", 1.0), (2, "MIT", 1.0), (3, "GPL-2.0", 1.0), (4, "ISC", 1.0), (5, "GPL-3.0", 1.0), (6, "GPL-3.0", 1.0),
                          (7, "GPL-2.0", 1.0), (7, "GPL-3.0", 1.0), (None, "reserved", 1.0), (None, "MIT", 1.0)], key=str)
    long = prose(77, 24, 5000).split()  # four of four shingles of one template, twenty-four of thirty of the other
    two = [("L", " ".join(long[:8])), ("L", " ".join(long + prose(78, 5, 5000).split()))]
    best = license_scan.license_matches(frame(spark, [(1, " ".join(long))]), license_scan.templates(spark, two)).collect()
    assert [(x.n_shared, x.n_shingles) for x in best] == [(4, 4)]
    assert license_scan.license_matches(frame(spark, []).limit(0), license_scan.templates(spark)).count() == 0
    assert license_scan.license_matches(frame(spark, r), license_scan.templates(spark).limit(0)).count() == 0


def test_backoff_chunks_go_by_bytes_of_text_and_not_by_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000, raising=False)
    rows = [(i % 40, prose(i, 60, 50)) for i in range(80)]
    size = sum(len(t) for _, t in rows)
    found = []
    for parts in (1, 7):
        scored = lm_scoring.stupid_backoff(frame(spark, rows, parts))
        modulus = re.search(r"pmod\(xxhash64\([^)]*\), (\d+)\)", scored._jdf.queryExecution().optimizedPlan().toString())
        found.append((int(modulus[1]), sorted(map(tuple, scored.collect()))))
    assert found[0] == found[1] and found[0][0] == -(-size // 2000)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 1 << 30, raising=False)
    assert sorted(map(tuple, lm_scoring.stupid_backoff(frame(spark, rows)).collect())) == found[0][1]


def test_words_that_go_on_in_the_next_piece(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE", 3)
    for text in ("", "   ", "a", "abcdefgh ij  k\u00e9lm\n nopqr ", " ab cd efghijk", None):
        assert [w for part in lm_scoring.words_of(text) for w in part] == (text or "").encode().split()


def test_backoff_on_odd_texts(spark):
    rows = {x.doc_id: x for x in lm_scoring.stupid_backoff(frame(spark, ODD + [(1, "a b a b c"), (2, "")])).collect()}
    assert len(rows) == len({i for i, _ in ODD}) + 2
    assert (rows[1].n_words, rows[1].n_seen) == (5, 2) and (rows[2].n_words, rows[2].log_score, rows[2].mean_log_score) == (0, 0.0, None)
    assert lm_scoring.stupid_backoff(frame(spark, []).limit(0)).count() == 0


def test_trigrams_tell_shuffled_pairs_from_fluent_text(spark, folder):
    # the last two texts hold pairs that are all common; only the first of them holds common runs of three
    texts = ["a b c"] * 6 + ["d b e"] * 6 + ["a b c", "a b e"]
    frame(spark, list(enumerate(texts))).write.parquet(f"{folder}/documents.parquet")
    rows = {x.doc_id: x for x in entry.queries()["op10_lm_scoring_trigrams"](spark, folder).collect()}
    pairs = {x.doc_id: x for x in entry.queries()["op10_lm_scoring"](spark, folder).collect()}
    assert pairs[12].n_seen == pairs[13].n_seen == 2
    assert (rows[12].n_seen, rows[13].n_seen) == (1, 0)
    log = np.log
    first, second = log(8 / 42) + 2 * log(0.4), log(0.4)  # a: one word; b after a: 8 of 8
    assert abs(rows[12].log_score - (first + second + log(7 / 8))) < 1e-3
    assert abs(rows[13].log_score - (first + second + log(7 / 14) + log(0.4))) < 1e-3


# -- pipeline

def test_pipeline_stages(spark, folder):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k == 0:
            one = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in one.collect() if r.kept}
        if k == 2:
            want = plain_near_duplicates(sorted(before.items()))
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, root) in want.items() if root == i}
        if k == 3:
            removed = {i: n for i, _, n, *_ in plain_passages(sorted(before.items()))}
            assert {r.doc_id for r in docs.collect() if r.text != before[r.doc_id]} == {i for i, n in removed.items() if n}
        if k < 4:
            assert docs.columns == names and set(r.doc_id for r in docs.collect()) <= set(before)
    assert {r.doc_id for r in docs.collect()} == set(before)
