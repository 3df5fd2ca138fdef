"""Each operator against a plain version, on edge cases."""

import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from floorspan.llm import chat_format, decontaminate, language_id, language_model, mixing, ngram_join, quality_rank, quality_rules, token_counts, toxicity
from floorspan.llm._common import frequent, id_remainder


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# -- 1 ----------------------------------------------------------------------------------------------


def test_lm_base_scores_and_probabilities(docs, empty):
    counts, vocab, flat = language_model.fit(docs.filter(language_model.not_held_out("doc_id")))
    got = language_model.score(docs, counts, vocab, flat).collect()
    want = brute.base_scores([(r.doc_id, r.text) for r in docs.collect()])
    key = lambda x: (x[0], x[1], x[2], round(x[3], 6))
    assert sorted(key((r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got) == sorted(map(key, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score(empty, counts, vocab, flat).count() == 0
    counts, vocab, flat = language_model.fit(empty)
    assert language_model.score(docs, counts, vocab, flat).count() == docs.count()


def test_lm_probabilities_sum_to_one():
    known = [(b"w%d" % i, 5000 - i) for i in range(3000)]
    vocab = language_model.Vocabulary(known, 10, 10, [7] * language_model.TAILS)
    p = language_model.unpack(language_model.initial(vocab))
    h = np.random.default_rng(1).normal(size=(1, language_model.HIDDEN)).astype(np.float32)
    n = language_model.HEAD + language_model.TAILS
    total = np.exp(language_model.log_prob(p, np.repeat(h, n, axis=0), np.arange(n))).sum()
    assert abs(total - 1) < 1e-4


def test_lm_state_carries_over_windows_and_learns():
    rng = np.random.default_rng(0)
    known = [(b"w%d" % i, 10) for i in range(50)]
    vocab = language_model.Vocabulary(known, 10, 10, [1] * language_model.TAILS)
    trainer = language_model.Trainer(language_model.initial(vocab))
    # texts of two kinds that never mix their words
    texts = [np.append(rng.integers(0, 20, 40) + 20 * (k % 2), vocab.end).astype(np.int32) for k in range(2000)]
    before = language_model.score_pool(trainer.p, texts[:50], vocab.end).sum()
    trainer.train(np.concatenate(texts), vocab.end)
    after = language_model.score_pool(trainer.p, texts[:50], vocab.end)
    assert after.sum() > before * 0.95
    alone = [language_model.score_pool(trainer.p, [t], vocab.end, steps=7)[0] for t in texts[:50]]
    assert np.allclose(after, alone, rtol=1e-4)


def test_lm_gradient():
    vocab = language_model.Vocabulary([(b"w%d" % i, 10) for i in range(100)], 10, 10, [1] * language_model.TAILS)
    x = np.random.default_rng(0).integers(0, 100, (5, 3)).astype(np.int32)
    y = np.random.default_rng(1).integers(0, 100, (5, 3)).astype(np.int32)
    got = {}

    class Spy(language_model.Trainer):
        def _update(self, grad, flat_x, dx):
            got.update(grad)

    flat = language_model.initial(vocab)
    h0 = np.zeros((3, language_model.HIDDEN), dtype=np.float32)

    def loss(flat):
        p, h, out = language_model.unpack(flat.astype(np.float64)), h0.astype(np.float64), 0.0
        for t in range(5):
            h = h * (x[t] != vocab.end)[:, None]
            h = language_model.step(p, p["x"][x[t]] + p["b"], h)[0]
            out -= language_model.log_prob({k: v.astype(np.float32) for k, v in p.items()}, h.astype(np.float32), y[t]).sum()
        return out / 15

    Spy(flat)._window(x, y, h0, vocab.end)
    at = 0
    for name, shape in language_model.SHAPES.items():
        if name in ("u", "k", "b"):
            for i in (0, 7, 11):
                d = np.zeros(len(flat))
                d[at + i] = 1e-2
                slope = (loss(flat + d) - loss(flat - d)) / 2e-2
                assert abs(slope - got[name].reshape(-1)[i]) < 2e-3, (name, i)
        at += math.prod(shape)


# -- 2 ----------------------------------------------------------------------------------------------


def test_water_fill(spark):
    for sizes in ({"a": 10, "b": 1, "c": 500, None: 3}, {"x": 0, "y": 7}, {None: 4}, {"a": 1, "b": 1, "c": 1000}):
        d = spark.createDataFrame([(("=" + s) if s is not None else "null", s, n) for s, n in sizes.items()], "k string, source string, source_size long")
        got = {r.source: r.target for r in mixing.water_fill(d).collect()}
        want = brute.water_fill(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want), sizes


def test_mix(spark, docs, empty):
    got = mixing.mix(docs).collect()
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(brute.words(r.text))
    assert sorted(r.size for r in got) == sorted(len(brute.words(r.text)) for r in docs.collect())
    assert all(r.taken <= 3 * r.size for r in got) and {round(r.target, 6) for r in got} <= {round(x, 6) for x in brute.water_fill(size).values()}
    assert rows_of(mixing.mix(docs), "doc_id", "taken") == rows_of(mixing.mix(docs.repartition(3)), "doc_id", "taken")
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + id % 9)").alias("text"), F.expr("case when id % 3 = 0 then 'hot' else concat('s', id % 7) end").alias("source"))
    by = mixing.mix(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 9 for r in by)
    kept = mixing.apply_mix(many)
    assert kept.columns == [*many.columns, "copies"]
    assert kept.agg(F.sum(F.col("copies") * mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in by)


# -- 3 ----------------------------------------------------------------------------------------------


def cheapest(roles):
    """Least cost by trying all labels and merges."""
    best = {0: 0}
    for r in roles:
        now = {}
        for s, c in best.items():
            for label in (1, 2, 3):
                cost = c + (0 if r == label else chat_format.COST_RELABEL if r else chat_format.COST_NAME)
                if label in chat_format.LEGAL[s]:
                    now[label] = min(now.get(label, 1e9), cost)
                if label == s:
                    now[label] = min(now.get(label, 1e9), cost + chat_format.COST_MERGE)
                for via in chat_format.LEGAL[s]:
                    if label in chat_format.LEGAL[via]:
                        now[label] = min(now.get(label, 1e9), cost + chat_format.COST_INSERT)
        best = now
    return min(best.values())


def legal(roles):
    return all(b in chat_format.LEGAL[a] for a, b in zip([0, *roles], roles))


def test_role_repair_is_cheapest_and_legal():
    rng = random.Random(5)
    for _ in range(300):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        done = chat_format.repair(roles, [0, *[chat_format.INFINITE] * 3])
        assert sum(c for *_, c in done) == cheapest(roles)
        flat = [x for label, action, via, _ in done if action != "merge" for x in ((via, label) if via else (label,))]
        assert legal(flat)


def test_chat_rendering_and_blocks(spark):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant", "system", None, "Tool"]), f"t{i}") for i in range(200)]
    rows += [(None, 0, "user", None), (8, None, "assistant", "late"), (8, 0, "user", "x <|im_end|>"), (8, 0, "user", "x <|im_end|>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash"))
    one, many = chat_format.format_turns(d), chat_format.format_turns(d, block=16)
    assert one.count() == many.count() == 203
    assert one.agg(F.sum("cost")).first() == many.agg(F.sum("cost")).first()
    text = {r.conv_id: r.rendered for r in chat_format.render(many).collect()}
    assert text[8] == "<|im_start|>user\nx < |im_end|><|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    assert text[None] == "<|im_start|>user\n<|im_end|>\n"
    import re

    shown = [chat_format.ROLES.index(x) + 1 for x in re.findall(r"<\|im_start\|>(\w+)\n", text[7])]
    assert legal(shown) and all(f"t{i}" in text[7] for i in range(200))
    assert chat_format.format_turns(d.limit(0)).count() == 0
    assert "assistant\n<|im_end|>" in chat_format.render(chat_format.format_turns(d.filter("conv_id is null"), end_with_assistant=True)).first().rendered


# -- 4 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, empty, name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(name)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False)) if x else 0
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(t.encode(x)) if x else 0
    extra = [(20, "say <|endoftext|> twice <|endoftext|>é  x\n\n y", "en", "a"), (21, "don't  stop\tit's … ok " * 50, "en", "a")]
    d = docs.select("doc_id", "text", "lang", "source").union(docs.sparkSession.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    got = token_counts.count_tokens(d, path, limit=100, batch_bytes=500, piece_bytes=40)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := count(r.text), n > 100) for r in d.collect()), key=repr)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, path).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------


def near_copies(seed=3, groups=6, copies=8):
    rng, out, i = random.Random(seed), [], 100
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 700]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            out.append((i, " ".join(w)))
            i += 1
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, n, num):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near_copies()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(1))
    by_row = brute.components([((x is None, x or 0, k), t) for k, (x, t) in enumerate(rows)], n, num)
    want = sorted(((x, len(brute.shingles(t, n)), None if by_row[x is None, x or 0, k][0] else by_row[x is None, x or 0, k][1]) for k, (x, t) in enumerate(rows)), key=repr)
    assert rows_of(ngram_join.join(d, n=n, num=num), "doc_id", "n_shingles", "component_id") == want
    kept = ngram_join.keep_one(d, n=n, num=num)
    assert kept.columns == d.columns
    empties = sum(not brute.shingles(t, n) for _, t in rows)
    groups = {v for k, v in by_row.items() if brute.shingles(rows[k[2]][1], n)}
    assert kept.count() == len(groups) + empties
    assert {r.doc_id for r in kept.collect()} >= {g[1] for g in groups if not g[0]}
    assert ngram_join.join(d.limit(0)).count() == 0 and ngram_join.keep_one(d.limit(0)).count() == 0


# -- 6, 8 -------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = random.Random(9)
    clean = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "elo", "iru", "odan", "ulim")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(30, 120))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zakvor", "zakvox", "zakvorin"])
        text = " ".join(w) if good else "###".join(w).upper() + " !!"
        docs.append((i, text))
        labels.append((i, good, toxic))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return d, spark.createDataFrame(labels + [(0, None, None), (None, 1, 1), (10**9, 1, 0)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, y, at):
    j = scored.join(labels.filter("quality is not null").groupBy("doc_id").agg(F.max(y).alias("y")), "doc_id").filter(id_remainder("doc_id", 5) == 0)
    return j.agg(F.avg(((F.col("score") >= at).cast("int") == F.col("y")).cast("int"))).first()[0]


def test_toxicity(spark, docs, empty):
    d, labels = labelled(spark)
    good = d.filter("doc_id % 3 <> 0")
    model = toxicity.train(good, labels)
    assert accuracy(toxicity.score(good, model), labels, "toxic", 0.5) > 0.95
    unseen = model.scores(["bana zakvorr celo diru felo " * 8, "bana celo diru felo gana " * 8])  # a misspelling that no text has
    assert unseen[0] > 0.5 > unseen[1]
    s = toxicity.score(docs, model).collect()
    assert len(s) == docs.count() and all(0 <= r.score <= 1 for r in s)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in s)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(good, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_quality_rank(spark, docs, empty):
    d, labels = labelled(spark)
    model = quality_rank.train(d, labels)
    assert accuracy(quality_rank.score(d, model), labels, "quality", quality_rank.AT) > 0.95
    s = quality_rank.score(docs, model).collect()
    assert len(s) == docs.count() and all(0 <= r.score <= 1 for r in s)
    assert quality_rank.keep_good(docs, model).columns == docs.columns
    assert quality_rank.score(empty, model).count() == 0
    assert {r.score for r in quality_rank.score(docs, quality_rank.train(d, labels.limit(0))).collect()} == {0.5}


# -- 7 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 19, 2])
def test_decontamination(spark, docs, empty, block):
    rng = random.Random(4)
    vocabulary = [f"k{i}" for i in range(30)] + ["Été"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 10, 14])))) for i in range(12)] + [(50, None), (51, "--- !"), (None, "solo k1 k2"), (3, "again k3 k4 k5")]
    texts = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(60)) + (", " + rng.choice(items[:12])[1].upper() if i % 2 else "") + " solo k1 k2" * (i % 5 == 0)) for i in range(40)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r.doc_id, *brute.hits(r.text, items)) for r in d.collect()), key=repr)
    got = decontaminate.scan(d, bench, block_windows=block).collect()
    assert sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r["items"]) for r in got), key=repr) == want
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and kept.count() == sum(h == 0 for _, _, h, _ in want)
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    leak = spark.createDataFrame([(1, "Before it. One, two three four (five) six seven eight nine TEN eleven! after"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert rows_of(decontaminate.remove_spans(leak, item), "doc_id", "text") == [(1, "Before it. ! after"), (2, "clean"), (3, None)]
    assert decontaminate.scan(empty, bench).count() == 0
    assert all(not r.spans for r in decontaminate.scan(d, bench.limit(0)).collect())


# -- 9 ----------------------------------------------------------------------------------------------


def test_language_id(spark, docs, empty):
    rng = random.Random(1)
    parts = {"aa": ["thi", "ing", "wo", "ry"], "bb": ["eau", "ç", "ille", "que"], "cc": ["sch", "ung", "ß", "lich"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(rng.randrange(2, 30))), k) for i in range(300) for k in [rng.choice(list(parts))]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(d.filter(language_id.not_held_out("doc_id")))
    got = language_id.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").filter(id_remainder("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    s = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(s) == docs.select("doc_id").distinct().count()
    assert {s[i].lang_pred for i in (3, 4, 5, 13)} == {"und"} and s[13].score == 0
    assert all(0 <= r.score <= 1 for r in s.values())
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and {3, 4, 5, 13}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}


def test_language_counts_are_exact(spark):
    d = spark.createDataFrame([("x", "ab ab"), ("x", "b"), ("y", None)], "lang string, text string")
    n = language_id.count_grams(d.filter("text is not null")).agg(F.sum("n")).first()[0]
    assert n == sum(len(t) - k for t in (" ab ab ", " b ") for k in (0, 1, 2))


# -- 10 ---------------------------------------------------------------------------------------------


def test_rule_counts(docs, empty):
    got = quality_rules.metrics(docs)
    want = sorted(((r.doc_id, *brute.rule_counts(r.text)) for r in docs.collect()), key=repr)
    assert rows_of(got, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert quality_rules.metrics(empty).count() == 0


def test_binomial_bound(spark):
    cases = [(k, n) for n in (1, 5, 40, 200, 900) for k in (0, 1, 2, 5, 11, 30) if k <= n]
    d = spark.createDataFrame(cases, "k long, n long")
    for p in (0.004, 0.1, 0.5):
        for r in d.select("k", "n", quality_rules.binomial_at_most(F.col("k"), F.col("n"), p).alias("c")).collect():
            want = brute.binomial_at_most(r.k, r.n, p) if r.k < r.n * p else 1.0
            assert abs(r.c - want) <= 1e-9 * want + 1e-15, (r, p, want)


def test_rules_and_their_guarantee(spark, docs):
    rows = [(i, "en" if i % 2 else None, 100, 500 + i % 7, 400 if i % 10 == 0 else i % 3, 10, 0, 0) for i in range(20_000)]
    counts = spark.createDataFrame(rows, "id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long").fillna("null")
    labels = counts.select(F.col("id").alias("i"), F.when(F.col("n_symbols") == 400, 0).otherwise(1).alias("y"))
    found = quality_rules.cutoffs(counts, labels.union(spark.createDataFrame([(None, 1), (5, None)], "i long, y int")))
    by = {r.stratum: r for r in found.collect()}
    assert by["en"].cut_symbols == 0.01
    out = quality_rules.judge(counts, found)
    bad = out.filter("n_symbols = 400").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    good = out.filter("n_symbols < 400").groupBy("stratum").agg(F.avg((~F.col("kept")).cast("int")).alias("r")).collect()
    assert bad == 0 and all(r.r <= quality_rules.ALPHA * len(quality_rules.RULES) for r in good)
    # too few good texts show nothing, so nothing is rejected beyond the base rule
    few = quality_rules.apply_rules(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert {(r.base_failed, r.kept) for r in few.collect()} <= {(True, False), (False, True)}
    assert few.count() == docs.count()


def test_frequent(spark):
    rng = random.Random(1)
    counts = [(i, rng.choice([1, 1, 1, 2, 3, 8, 16, 1000 + i, 5000 * i + 1])) for i in range(1500)]
    d = spark.createDataFrame(counts, "w long, c long")
    for most in (1, 10, 200, 1000, 5000):
        got = [r.c for r in frequent(d, "c", most).collect()]
        assert len(got) <= most
        rest = sorted((c for _, c in counts), reverse=True)
        assert sorted(got, reverse=True) == rest[: len(got)]


def test_lm_trains_on_every_word():
    known = [(b"w%d" % i, 40 - i) for i in range(30)] + [(b"", 5)]
    vocab = language_model.Vocabulary(known, 10, 10, [1] * language_model.TAILS)
    for n in (1, 2, 5, 15, 16, 17, 8 * 16 + 3, 8 * 40 + 7, 5003):
        trainer, seen = language_model.Trainer(language_model.initial(vocab)), []
        inner = trainer._window

        def window(x, y, h, end, live=None, inner=inner, seen=seen):
            seen += y.reshape(-1)[:live].tolist()
            return inner(x, y, h, end, live)

        trainer._window = window
        stream = np.arange(n, dtype=np.int32) % 29
        trainer.train(stream, vocab.end)
        assert trainer.words == n and sorted(seen) == sorted(stream.tolist())
        assert np.isfinite(trainer.flat).all()


def test_lm_filled_places_teach_nothing():
    known = [(b"w%d" % i, 40 - i) for i in range(30)] + [(b"", 5)]
    vocab = language_model.Vocabulary(known, 10, 10, [1] * language_model.TAILS)
    y = np.arange(12, dtype=np.int32).reshape(3, 4)
    x = np.vstack([np.full((1, 4), vocab.end, dtype=np.int32), y[:-1]])
    weights = []
    for filler in (1, 20):
        trainer = language_model.Trainer(language_model.initial(vocab))
        z = y.copy()
        z[2, 3] = filler
        trainer._window(x, z, np.zeros((4, language_model.HIDDEN), dtype=np.float32), vocab.end, 11)
        weights.append(trainer.flat)
    assert (weights[0] == weights[1]).all()


def test_lm_has_24_hidden_units():
    assert language_model.HIDDEN == 24


def test_lm_words_are_those_of_split():
    rng = random.Random(4)
    texts = [b"", b" ", b"\n\n", b"a", b"\x00", b"\x1c\x85 \xc2\xa0x", b"y" * 41 + b" " + b"y" * 40, b"\x0b\x0c\r\tq\t"]
    texts += [bytes(rng.choice(b"ab \t\n\x00\xff") for _ in range(rng.randrange(300))) for _ in range(200)] + [b"z" * 300_000, b"x y"]
    words = language_model.Words(texts)
    assert words.bytes_of(np.arange(len(words.start))) == [w for t in texts for w in t.split()]
    assert words.per_text.tolist() == [len(t.split()) for t in texts]
    empty = language_model.Words([])
    assert len(empty.start) == len(empty.per_text) == 0


def test_lm_places_are_those_of_a_dictionary(monkeypatch):
    rng = random.Random(5)
    listed = [b""] + sorted({bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 41))) for _ in range(3000)})
    index = {w: i for i, w in enumerate(listed)}
    asked = listed + [w + b"\x00" for w in listed] + [w[:-1] + b"c" for w in listed] + [b"a" * 39 + b"d", b"a" * 1000]
    words = language_model.Words([b" ".join(asked)])
    want = [index.get(w, -1) for w in b" ".join(asked).split()]
    assert language_model.Places(listed).find(words).tolist() == want
    assert (language_model.Places([]).find(words) == -1).all() and (language_model.Places([b""]).find(words) == -1).all()
    # words whose hashes are equal are told apart by their bytes
    monkeypatch.setattr(language_model.Words, "hashes", lambda self, most: (self.length % 3).astype(np.uint64) << np.uint64(62))
    assert language_model.Places(listed).find(words).tolist() == want


def test_lm_symbols_are_those_of_each_word():
    rng = random.Random(6)
    known = [(b"w%d" % i, 5000 - i) for i in range(2500)] + [(b"", 7)]
    vocab = language_model.Vocabulary(known, 10, 10, [1] * language_model.TAILS)
    texts = [" ".join(rng.choice(["w%d", "v%d", "é%d", "W%d "]) % rng.randrange(3000) for _ in range(rng.randrange(30))) for _ in range(50)] + ["", "é", "q"]
    got, starts, at = language_model._symbols(language_model.Words([language_model.ascii_lower(t) for t in texts]), vocab)
    want, begins, places = [], [], []
    for t in texts:
        begins.append(len(want))
        for w in language_model.ascii_lower(t).split():
            places.append(vocab.index.get(w, -1))
            want.append(int(vocab.symbol[places[-1]]) if w in vocab.index else language_model.HEAD + language_model.tail_class(w))
        want.append(vocab.end)
    assert got.tolist() == want and starts.tolist() == begins and at.tolist() == places


def test_lm_sums_by_symbol():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.integers(0, 40, 3000), rng.integers(0, 2000, 1000), [2079])).astype(np.int32)
    d = rng.normal(size=(3, len(x), language_model.HIDDEN)).astype(np.float32)
    for n in (len(x), 1, 24, 25, 300):
        used, got = language_model.sums_by_symbol(x[:n], d[:, :n])
        want = np.zeros((2080, 3 * language_model.HIDDEN))
        np.add.at(want, x[:n], d[:, :n].swapaxes(0, 1).reshape(n, -1))
        assert sorted(used.tolist()) == sorted(set(x[:n].tolist())) and np.allclose(got, want[used], atol=1e-4)
