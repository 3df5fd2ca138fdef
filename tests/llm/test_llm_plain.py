"""Scores of the learned operators against plain loops, and their accuracy on rows that they haven't learned from."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from floorspan.llm import _bloom, chat_format, language_id, language_model, mixing, ngram_join, quality_rank, quality_rules, token_counts, toxicity
from floorspan.llm._common import id_remainder

M32 = 0xFFFFFFFF


def folder(sf):
    return f"/root/testdata/{sf}"


def plain_grams(text, sizes, bits):
    """(n, place, bucket) of a text's n-grams, by whole numbers."""
    s = f" {' '.join(text.lower().split())} " if text else " "
    h = [(ord(c) * 0x9E3779B1 + 0x7F4A7C15) & M32 for c in s]
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h = [(((x ^ (x >> 13)) * 0x85EBCA6B) + ord(s[i + n - 1]) * 0xC2B2AE35) & M32 for i, x in enumerate(h[: len(s) - n + 1])]
        if n in sizes:
            for i, x in enumerate(h):
                yield s[i : i + n], (((x ^ (x >> 15)) * 0x2C1B3C6D) & M32) >> (32 - bits)


TEXTS = ["An idiot, a CLOWN and another idiot", "", None, "x", "été à la plage\n\nça va", "a b", "word " * 300, "tail\tof\x0bspaces  "]


def test_toxicity_scores_are_mean_weights():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.3)
    for text, got in zip(TEXTS, model.scores(TEXTS), strict=True):
        own = [float(model.weight[b]) for g, b in plain_grams(text, toxicity.SIZES, toxicity.BITS) if " " not in g[1:-1]]
        assert abs(got - 1 / (1 + math.exp(-(sum(own) / max(1, len(own)) - 0.3)))) < 1e-6, text


def test_toxicity_counts_documents_with_each_gram():
    bags = [b for b, _ in toxicity.bags(TEXTS)]
    found = toxicity.presence(bags, [1, 0, 1, 0, 1, 0, 1, 0], [0, 1, 2, 3, 4, 0, 1, 2])
    for k, text in enumerate(TEXTS):
        want = {b for g, b in plain_grams(text, toxicity.SIZES, toxicity.BITS) if " " not in g[1:-1]}
        assert set(bags[k].tolist()) == want
    assert found[:, :, -1].sum() == len(TEXTS) and found[0, 1, :-1].sum() == len(bags[0])


def test_toxicity_border_can_be_nothing():
    z, y = np.array([3.0, 2.0, 1.0, 0.5]), np.array([0, 1, 0, 1])
    assert toxicity.border(z, y, {0: 1000, 1: 1})[0] is None
    assert toxicity.border(z, y, {0: 1, 1: 1000})[0] < 0.5
    at, cost = toxicity.border(np.array([2.0, 2.0, 1.0]), np.array([1, 0, 0]), {0: 2, 1: 3})
    assert at == 1.5 and cost == 1  # texts that score alike stay together


def test_toxicity_knows_misspellings():
    rng = random.Random(3)
    clean = ["".join(rng.choices(["ta", "mi", "ro", "ne", "lu"], k=3)) for _ in range(200)]
    text = lambda *more: " ".join([*rng.choices(clean, k=30), *more])
    texts = [text(rng.choice(["blockhead", "numbskull"])) if i % 3 == 0 else text() for i in range(240)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(240)])
    bad = model.scores([text(w) for w in ("blockheed", "bl0ckhead", "numbskulls", "numskull")])
    assert (bad >= 0.5).sum() >= 3 and (model.scores([text() for _ in range(50)]) < 0.5).mean() > 0.95


@pytest.mark.parametrize(("sf", "most_false", "most_missed"), [("sf0.001", 0.06, 1.0), ("sf0.01", 0.03, 0.5), ("sf0.1", 0.02, 0.15)])
def test_toxicity_on_held_out_rows(spark, sf, most_false, most_missed):
    got = toxicity.op8_toxicity(spark, folder(sf)).filter("held_out").join(spark.read.parquet(folder(sf) + "/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    clean, toxic = [r.predicted for r in got if r.toxic == 0], [r.predicted for r in got if r.toxic == 1]
    assert sum(clean) <= most_false * len(clean) and len(toxic) - sum(toxic) <= most_missed * len(toxic)


def test_long_labelled_texts_are_learned_from(spark):
    rows = [(i, ("fine " * 20_000) + "awful" * (i % 2), i % 2) for i in range(20)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, toxic int, quality int")
    for module, label in ((toxicity, "toxic"), (quality_rank, "quality")):
        stored, sizes = module.sample(d, labels, label, 100, lambda c: F.lit(True))
        assert stored.df.count() == 20 and sizes == {0: 10, 1: 10} and stored.df.agg(F.max(F.length("t"))).first()[0] > 100_000
        stored.drop()


def test_quality_features_and_threshold():
    text = "One one TWO.\nOne one TWO.\nthree | é"
    got = quality_rank.features([text, None])[0]
    raw = text.encode()
    share = lambda keep: sum(map(keep, raw)) / len(raw)
    words = text.lower().split()
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    sizes = [len(w.encode()) for w in words]
    want = [
        share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), 0, share(lambda b: b in b".,;:"), 0, 0, share(lambda b: b == ord("|")), 0, share(lambda b: b in b" \t"), share(lambda b: b == 10), share(lambda b: b >= 128),
        math.log1p(len(words)), np.mean(sizes), np.std(sizes), len(set(words)) / len(words), max(map(words.count, words)) / len(words), 1 - len(set(runs)) / len(runs), 1 / 3, math.log1p(len(words) / 3), 2 / (len(words) - 1),
    ]
    assert np.allclose(got, want) and not quality_rank.features([None]).any()
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, quality_rank.N_FEATURES))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > -0.8).astype(int)
    sizes = dict(enumerate(np.bincount(y)))
    model = quality_rank.fit(x, y, sizes)
    z = model.raw(x)
    pairs = [z[a] > z[b] for a in np.flatnonzero(y == 1) for b in np.flatnonzero(y == 0)]
    assert np.mean(pairs) > 0.95 and abs((z < model.threshold).mean() - sizes[0] / 300) < 0.01
    assert quality_rank.fit(np.ones((4, quality_rank.N_FEATURES)), np.array([0, 1, 0, 1]), {0: 2, 1: 2}).raw(np.ones((1, quality_rank.N_FEATURES))).shape == (1,)  # ties


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.85), ("sf0.01", 0.95)])
def test_quality_on_held_out_rows(spark, sf, least):
    got = quality_rank.op6_quality_rank(spark, folder(sf)).filter("held_out").join(spark.read.parquet(folder(sf) + "/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= least


def test_language_posteriors(spark, monkeypatch):
    rows = [(1, "thing wording", "aa"), (2, "eau ville", "bb"), (3, "schön ung", "cc"), (4, "ing ing", "aa"), (5, None, "bb"), (6, "lich", "cc"), (7, "", "bb"), (8, "ing", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(d)
    count, docs = {}, {}
    for _, text, lang in rows:
        if lang and text is not None:
            docs[lang] = docs.get(lang, 0) + 1
            for _, b in plain_grams(text, language_id.SIZES, language_id.BITS):
                count.setdefault(lang, {})[b] = count.get(lang, {}).get(b, 0) + 1
    size = 1 << language_id.BITS

    def plain(text):
        log = {}
        for lang in sorted(count):
            total = sum(count[lang].values())
            log[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((count[lang].get(b, 0) + 0.5) / (total + 0.5 * size)) for _, b in plain_grams(text, language_id.SIZES, language_id.BITS))
        best = max(sorted(log), key=log.get)
        return best, 1 / sum(math.exp(x - log[best]) for x in log.values())

    texts = ["thing", "eau", "lich ung", "zz", "...", None, "a" * 3000]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1000, 2, 1):
        monkeypatch.setattr(language_id, "BLOCK", block)
        model = language_id.train(d)
        assert len(model.blocks) == -(-3 // block) and model.langs == ["aa", "bb", "cc"]
        got = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
        kept = {r.doc_id for r in language_id.keep_known(asked, model).collect()}
        for i, text in enumerate(texts):
            want = plain(text) if text and any(c.isalpha() for c in text) else ("und", 0.0)
            assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-4, (block, text)
            assert (i in kept) == (want[1] >= 0.4)


def test_language_on_held_out_rows(spark):
    got = language_id.op9_language_id(spark, folder("sf0.01")).filter("held_out").join(spark.read.parquet(folder("sf0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_lm_scores_word_by_word(spark):
    rows = [(i, " ".join(random.Random(i).choices(["red", "green", "blue", "Blue", "teal"], k=i % 7)), None) for i in range(60)] + [(70, "unseen words redder " * 30, None), (71, "x" * 60 + " red", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, vocab, flat = language_model.fit(d.filter("doc_id < 50"))
    flat = flat + np.random.default_rng(5).normal(0, 0.3, len(flat)).astype(np.float32)
    count = {bytes(r.word): r.c for r in counts.collect()}
    p = {k: v.astype(float) for k, v in language_model.unpack(flat).items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    h_n = language_model.HIDDEN

    def soft(logits, i):
        e = np.exp(logits - logits.max())
        return e[i] / e.sum()

    for r in language_model.score(d, counts, vocab, flat).collect():
        tokens = [w.encode() for w in language_model.ascii_lower(dict((a, b) for a, b, _ in rows)[r.doc_id]).decode().split()] + [b""]
        h, before, total = np.zeros(h_n), vocab.end, 0.0
        for w in tokens:
            x = p["x"][before] + p["b"]
            g = h @ p["u"]
            reset, keep = sig(x[:h_n] + g[:h_n]), sig(x[h_n : 2 * h_n] + g[h_n : 2 * h_n])
            n = np.tanh(x[2 * h_n :] + reset * g[2 * h_n :])
            h = (1 - keep) * n + keep * h
            at = vocab.index.get(w, -1)
            symbol = int(vocab.symbol[at]) if at >= 0 else language_model.HEAD + zlib.crc32(w[: language_model.PREFIX]) % language_model.TAILS
            k = h @ p["k"] + p["kb"]
            if symbol < language_model.HEAD:
                c = symbol // language_model.WIDTH
                chance = soft(k, c) * soft(h @ p["w"][c] + p["wb"][c], symbol % language_model.WIDTH)
            else:
                tail = symbol - language_model.HEAD
                chance = soft(k, language_model.HEAD // language_model.WIDTH + tail) * (count.get(w, 0) + 1) / vocab.z[tail]
            total += math.log10(chance)
            before = symbol
        assert abs(r.score - total) < 1e-3 * max(1.0, abs(total)), r.doc_id


def test_lm_bears_large_weights():
    vocab = language_model.Vocabulary([(b"w%d" % i, 10) for i in range(100)], 10, 10, [1] * language_model.TAILS)
    p = language_model.unpack(language_model.initial(vocab) * 400)
    h = np.random.default_rng(1).uniform(-1, 1, size=(200, language_model.HIDDEN)).astype(np.float32)
    got = language_model.log_prob(p, h, np.arange(200) % language_model.HEAD)
    assert not language_model.Output(p).safe and np.isfinite(got).all() and (got <= 1e-6).all()


def test_lm_beats_its_base_on_held_out_rows(spark):
    got = language_model.op1_lm_score(spark, folder("sf0.01")).filter("held_out")
    r = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.1  # by a tenth of a decimal logarithm a token


def test_vocabularies_that_drop_space():
    split = lambda pattern, behavior="Removed", invert=True: {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": pattern}, "behavior": behavior, "invert": invert}}
    assert token_counts.drops_space(split(r"'s|[\p{L}]+|[\p{N}]|[^\s\p{L}]+"))
    assert token_counts.drops_space({"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}]}})
    for bad in (split(r" ?\p{L}+"), split(r"[^\p{L}]+"), split(r".+"), split(r"\p{L}+", "Isolated"), split(r"\p{L}+", invert=False), {"pre_tokenizer": {"type": "ByteLevel"}}, {}):
        assert not token_counts.drops_space(bad)
    assert not token_counts.drops_space({**split(r"\p{L}+"), "added_tokens": [{"content": "a b"}]})


@pytest.mark.parametrize("change", ["prefix_space", "metaspace", "prepend", "strip", "replace", "plain"])
def test_counts_of_other_vocabularies(tmp_path, spark, change):
    """Vocabularies that put something before a text, or strip its ends, count as the library does on whole texts."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        v = json.load(f)
    if change == "prefix_space":
        v["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "metaspace":
        v["pre_tokenizer"] = {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": True}
    elif change == "prepend":
        v["normalizer"] = {"type": "Prepend", "prepend": "_"}
    elif change == "strip":
        v["normalizer"] = {"type": "Strip", "strip_left": True, "strip_right": True}
    elif change == "replace":
        v["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"String": " "}, "content": "_"}]}
    path = str(tmp_path / "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(v, f)
    t = Tokenizer.from_file(path)
    texts = ["  one two  three\n four " * 30, "a b", " ", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, path, batch_bytes=300, piece_bytes=20).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False)) if x else 0 for i, x in enumerate(texts)}
    assert token_counts.Encoder(path).can_cut == (change == "plain")


def test_token_batches_hold_about_as_many_bytes():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab <|endoftext|>é 　\t\n'sZ1", k=rng.choice([0, 3, 40, 900]))) for _ in range(300)] + ["z" * 5000, "q w " * 3000, None]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = token_counts.Encoder(public_tokenizers.path(name))
        seen, plain = [], encoder.lengths
        encoder.lengths = lambda batch, plain=plain, seen=seen: seen.append(sum(len(x.encode()) for x in batch)) or plain(batch)
        counting = token_counts.Counting(encoder, 2000, 300)
        got = []
        for t in texts:
            if counting.add(t, len(t.encode()) if t else 0):
                got += counting.take()
        got += counting.take()
        assert got == [plain([t])[0] if t else 0 for t in texts]
        assert len(seen) > 5 and max(seen) < 2000 + 5000 + 100  # a batch, and one text of 5000 bytes that has no boundary


@pytest.mark.parametrize("end_with_assistant", [False, True])
def test_chat_blocks_change_nothing(spark, monkeypatch, end_with_assistant):
    """All columns and renderings are the same for all sizes of blocks and levels of the scans, with and without repeats."""
    rng = random.Random(8)
    names = ["user", "assistant", None, "system", " Tool"]
    rows = [(1, rng.choice([None, 5, 5, 6]), rng.choice(names), f"text {i}") for i in range(700)]
    rows += [(3, i, rng.choice(names), None if i % 7 else f"t{i}") for i in range(90)] + [(2, 0, "user", "one"), (None, None, None, None)]
    schema = "conv_id long, turn long, role string, text string"
    d = spark.createDataFrame(rows, schema)
    repeated = spark.createDataFrame(rows + [rows[0]] * 100 + rows[300:400], schema)
    key = lambda r: tuple((x is None, x or 0) for x in (r.conv_id, r.place))
    whole = sorted(chat_format.format_turns(d, end_with_assistant=end_with_assistant).collect(), key=key)
    assert len(whole) == 792
    for conv, n in ((1, 700), (3, 90), (2, 1), (None, 1)):
        own = [r for r in whole if r.conv_id == conv]
        assert [r.place for r in own] == list(range(n))
        order = [(r.turn is None, r.turn or 0, r.role is not None, r.role or "") for r in own]
        assert order == sorted(order)
    for block, fan_in in ((16, 256), (7, 3)):
        monkeypatch.setattr(chat_format.scan, "__defaults__", (fan_in,))
        split = chat_format.format_turns(repeated if fan_in == 3 else d, end_with_assistant=end_with_assistant, block=block)
        assert sorted(split.collect(), key=key) == whole
    import re

    for r in chat_format.render(split).collect():
        own = [x.fragment for x in whole if x.conv_id == r.conv_id]
        assert r.rendered == "".join(own)
        roles = [chat_format.ROLES.index(x) + 1 for x in re.findall(r"<\|im_start\|>(\w+)\n", r.rendered)]
        assert all(b in chat_format.LEGAL[a] for a, b in zip([0, *roles], roles))


def test_chat_costs_are_least_over_blocks(spark):
    rng = random.Random(4)
    roles = [rng.choice(["user", "assistant", None, "system"]) for _ in range(200)]
    d = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = chat_format.format_turns(d, block=9).agg(F.sum("cost")).first()[0]
    assert got == min(chat_format.forward([chat_format.role_code(r) for r in roles], chat_format.BEGIN)[-1])


@pytest.mark.parametrize("bits", [(1 << 20, 1 << 29), (1 << 8, 1 << 8)])
def test_one_of_each_group_with_a_full_bloom_table(spark, monkeypatch, bits):
    """With a table of 256 bits nearly every row is in both tables, and goes through the exact join."""
    import brute

    monkeypatch.setattr(_bloom, "BITS", bits)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choices(words, k=30)) for _ in range(12)]
    texts = [(i, rng.choice(base) if i % 3 else " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 40])))) for i in range(120)]
    texts += [(i + 200, t.replace("w1 ", "w2 ", 1)) for i, t in enumerate(base)] + [(300, None), (300, None), (301, base[0]), (301, base[0])]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__key", F.lit(1))
    groups = brute.components([(i, t) for i, t in dict(texts).items()], 3, 80)
    want = sorted(set(groups.values()) - {300}) + [300, 300]
    got = ngram_join.keep_one(d, n=3, num=80, den=100)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == want


def test_join_of_crowded_buckets(spark, monkeypatch):
    import brute

    monkeypatch.setattr(ngram_join, "CROWD", 3)
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(25)]
    texts = [(i, " ".join(shared + [f"u{i}x{j}" for j in range(rng.choice([0, 1, 2, 3, 6, 12, 25]))])) for i in range(90)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for num in (80, 90):
        want = brute.components(texts, 3, num)
        assert {r.doc_id: r.component_id for r in ngram_join.join(d, num=num).collect()} == want


def test_one_of_each_group_beside_columns_of_its_names(spark):
    rows = [(1, "a b c d e f g", 1, 2), (2, "a b c d e f g", 3, 4), (2, "a b c d e f g", 3, 4), (3, None, 5, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __keyagain int, __key_again int")
    got = ngram_join.keep_one(d)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_mix_beside_a_column_of_its_name(spark):
    d = spark.createDataFrame([(1, "a b c", None, 7), (2, "d e", "s", 8), (2, "d e", "s", 8), (3, None, "s", 9), (None, "f", None, 1)], "doc_id long, text string, source string, copies int").withColumn("__plan", F.lit(0))
    out = mixing.apply_mix(d)
    assert out.columns == [*d.columns, "copies_"] and out.filter("copies_ < 1").count() == 0


def test_many_strata_and_a_tie_at_the_cutoff(spark):
    rows = [(i, f"s{i % 120}", 100, 500, 5 if i % 4 == 0 else 0, 10, 0, 0) for i in range(24_000)]
    counts = spark.createDataFrame(rows, "id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = counts.select(F.col("id").alias("i"), F.lit(1).alias("y"))
    found = quality_rules.cutoffs(counts, labels)
    out = quality_rules.judge(counts, found)
    assert out.filter("not kept").count() == 0  # a quarter of the good rows ties at 0.05 symbols a word: none may go


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="needs the given tables")
def test_cutoffs_that_pass_equal_sql(spark):
    """On a table that has enough good texts for cutoffs, all verdicts are those of SQL."""
    import duckdb

    from floorspan.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op10_quality_rules"])
    names = [d[0] for d in want.description]
    got = [tuple(r) for r in QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.1").select(names).collect()]
    assert sum(r[names.index("rules_hit")] != "" for r in got) > 100  # cutoffs are at work
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_a_broken_import_is_no_missing_subpackage():
    assert __spark_entry__.llm is not None and {"op1_lm_score", "pipeline"} <= set(__spark_entry__.queries())
    assert "floorspan.llm" in sys.modules
    assert id_remainder is not None


def test_quality_is_learned_from_all_labelled_rows(spark):
    rng = random.Random(8)
    good, bad = "The long and quiet river ran by the old town. ", "BUY!!! $$$ now|now|now "
    rows = [(i, (good if i % 2 else bad) * rng.randint(1, 4) + ("x" * 40 if rng.random() < 0.1 else "")) for i in range(8000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality_rank.train(d, labels, lambda c: F.lit(True))
    x, y = quality_rank.features([t for _, t in rows]), np.arange(8000) % 2
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, x.std(axis=0), atol=1e-6)  # of all rows, not of a sample
    same = quality_rank.fit(x, y, {0: 4000, 1: 4000})
    assert np.allclose(model.weight, same.weight, atol=1e-6) and math.isclose(model.threshold, same.threshold, abs_tol=1e-6) and math.isclose(model.unit, same.unit, rel_tol=1e-6)
    assert (model.raw(x) < model.threshold).sum() == 4000


def test_all_pairs_count_in_the_ranking():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, quality_rank.N_FEATURES))
    y = (x[:, 0] + rng.normal(size=160) > 0.5).astype(int)
    model = quality_rank.fit(x, y, dict(enumerate(np.bincount(y))))
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    pairs = (z[y == 1][:, None] - z[y == 0][None, :]).reshape(-1, quality_rank.N_FEATURES)
    slope = -(pairs.T @ (1 / (1 + np.exp(pairs @ model.weight)))) / len(pairs) + 1e-3 * model.weight
    assert np.abs(slope).max() < 1e-3  # the lowest loss over every pair


def test_middle_of_two_ranks(spark):
    rng = random.Random(6)
    values = [rng.choice([0.1, 0.1 + 1e-16, 5.0]) if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(3000)] + [-1e9, 1e9]
    d, order = spark.createDataFrame([(v,) for v in values], "s double"), sorted(values)
    for k in (0, 1, 700, 1500, 2400, 3000):
        assert quality_rank.between(d, k) == (order[k] + order[k + 1]) / 2
    assert quality_rank.between(d.filter("s = 5"), 3) == 5
