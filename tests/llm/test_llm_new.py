"""Importance resampling, spelling groups and URL filters against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from floorspan.llm import resampling, spelling, url_filter
from floorspan.llm._common import Tables
from floorspan.llm._pieces import pieces, to_spaces
from floorspan.llm.registry import ORACLE_SQL, QUERIES

from brute import lowered

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["op11_importance_resample", "op12_spelling_groups", "op13_url_filter"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


# -- 11 ---------------------------------------------------------------------------------------------


def grams(text, most=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, goal, most, buckets, least, percent):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(of, grams(text, most)[1]))
    for text in goal:
        t.update(map(of, grams(text, most)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out, fit = [], []
    for k, (i, text) in enumerate(rows):
        n, f = grams(text, most)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= least:
            fit.append(k)
    fit.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    for r, k in enumerate(fit[: len(fit) * percent // 100], 1):
        out[k][4] = r
    return out


@pytest.mark.parametrize(("most", "buckets", "block"), [(2, 10_000, 1 << 22), (3, 97, 300), (1, 70_000, 1)])
def test_resampling(spark, docs, empty, monkeypatch, most, buckets, block):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    rng = random.Random(3)
    goal = ["The lazy dog, the old river", "dix onze douze", None, "", "été à la plage"]
    extra = [(100 + i, " ".join(rng.choices(["fox", "dog", "river", "été", "9", "x-y"], k=rng.randrange(60)))) for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    d = docs.select("doc_id", "text", "score", "word").union(spark.createDataFrame([(*r, 0, 0) for r in extra], "doc_id long, text string, score int, word int"))
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    got = resampling.resample(d, target, most=most, buckets=buckets, percent=40)
    want = plain_resample(rows, goal, most, buckets, 20, 40)
    assert sorted(map(repr, (list(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()))) == sorted(map(repr, want))
    kept = resampling.keep_drawn(d, target, most=most, buckets=buckets, percent=40)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[4]}
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(d, target.limit(0)).filter("rank is not null").count() > 0


def test_resampling_ranks_over_ranges(spark):
    d = spark.range(3000).select(F.col("id"), F.lit(30).alias("n_words"), F.lit(5).cast("long").alias("n_features"), (F.col("id") % 3).alias("score")).repartition(7)
    got = resampling.draw(d, percent=50).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1501))
    assert [r.id for r in got] == sorted(range(3000), key=lambda i: (-(i % 3), i))[:1500]
    assert resampling.draw(d.filter("n_words > 99")).count() == 0


def test_resampling_prefers_what_is_like_the_target(spark):
    rng = random.Random(1)
    a, b = ([f"{p}{i}" for i in range(50)] for p in "ab")
    d = spark.createDataFrame([(i, " ".join(rng.choices(a if i % 4 else b, k=300))) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(b, k=5000)),)], "text string")
    got = resampling.resample(d, target, percent=20, buckets=300).filter("rank is not null").collect()
    assert len(got) == 80 and sum(r.doc_id % 4 == 0 for r in got) > 70


def test_pieces_keep_words_whole():
    letters = to_spaces(lambda b: 0x61 <= b <= 0x7A)
    rng = random.Random(2)
    raw = bytes(rng.choices(b"abC. ", k=5000)) + b"z" * 700 + b" end"
    found = list(pieces(raw, letters, 64))
    assert len(found) > 60 and b"".join(found) == raw.translate(letters)
    assert [w for p in found for w in p.split()] == raw.translate(letters).split()
    assert list(pieces(b"", letters)) == []


# -- 12 ---------------------------------------------------------------------------------------------


def plain_words(rows, loses=97, least=5):
    n = Counter()
    for i, text in rows:
        for r in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            r = lowered(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % loses == 0:
                k = h % len(r)
                r = r[:k] + r[k + 1 :]
            n[r] += len(r) >= least
    return n


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, times=2):
    out = {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= times * n[w] else None
        out[w] = [n[w], len(own), form, n[form] if form else None]
    for w, row in out.items():
        end = w
        while out[end][2]:
            end = out[end][2]
        row.append(end)
    return sorted((w, *r) for w, r in out.items())


@pytest.mark.parametrize(("tables", "loses"), [(1 << 23, 97), (25, 2)])
def test_spelling_groups(spark, docs, empty, monkeypatch, tables, loses):
    monkeypatch.setattr(spelling, "TABLE_WORDS", tables)  # several Bloom tables in turn
    monkeypatch.setattr(spelling, "HELD", 30)
    rng = random.Random(5)
    base = ["".join(rng.choices("abé", k=rng.randrange(5, 8))) for _ in range(40)] + ["Straße", "ÀÉÎõü", "x" * 300, "aaaaaa", "aaaaa", "day×night"]
    extra = [(50 + i, " ".join(rng.choices(base, weights=range(1, len(base) + 1), k=40)) + " 日本ÿabcdeŁfghij") for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    d = docs.select("doc_id", "text", "n", "word").union(spark.createDataFrame([(*r, 0, 0) for r in extra], "doc_id long, text string, n int, word int"))
    got = spelling.group_spellings(d, loses=loses, least_count=2)
    want = plain_groups({w: k for w, k in plain_words(rows, loses).items() if k >= 2})
    assert len(want) > 30 and any(r[3] for r in want)
    assert sorted(map(repr, (tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()))) == sorted(map(repr, want))
    assert spelling.group_spellings(empty).count() == 0


def test_neighbourhoods_are_whole_and_distinct():
    alphabet = "abß"
    for word in ("a", "aab", "bbaßa"):
        got = [x for _, found in spelling.neighbours([word, word[::-1]], alphabet, lambda h: np.ones(len(h), dtype=bool)) for x in zip(_.tolist(), found)]
        of = [x for w, x in got if w == 0]
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in alphabet} | {word[:i] + c + word[i:] for i in range(n + 1) for c in alphabet}
        assert len(of) == len(set(of)) and set(of) == want - {word}


def test_hashes_of_neighbours_are_those_of_the_words():
    """A candidate's hash, made from prefix and suffix sums, is the hash of its spelling."""
    for word in ("abcde", "zzzzz", "éàüöß" * 5):
        seen = []

        def keep(h, seen=seen):
            seen.append(h.copy())
            return np.ones(len(h), dtype=bool)

        spelled = [x for _, found in spelling.neighbours([word], "aézß", keep) for x in found]
        assert (np.concatenate(seen) == spelling.hashes(spelled)).all()


def test_long_ways_to_the_root(spark):
    n = 40
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)], "word string, form string")
    got = spelling.roots(links, 1 << n)
    assert {tuple(r) for r in got.collect()} == {(f"w{i}", f"w{n}") for i in range(n)}


def test_near_words_of_a_hub(spark):
    """A word with very many near words."""
    letters = "abcdefghij"
    words = {"mmmmmm"} | {"mmmmmm"[:i] + c + "mmmmmm"[i + 1 :] for i in range(6) for c in letters}
    v = spark.createDataFrame([(w, 9 if w == "mmmmmm" else 2) for w in words], "word string, n long")
    with Tables() as tables:
        got = {(r.word, r.near) for r in spelling.near_words(v, tables).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


# -- 13 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("http://A.Example.COM/Path?q#f", "a.example.com", "/Path"),
        ("x://h", "h", ""),
        ("http://h?x=/y", "h", ""),
        ("http://h#/y", "h", ""),
        ("a://b://c/d", "b:", "//c/d"),
        ("see\nhttp://É.org:80/a\nb", "É.org:80", "/a\nb"),
        ("www.example.com/x", "", ""),
        ("", "", ""),
        (None, "", ""),
        ("://", "", ""),
    ],
)
def test_addresses(spark, url, host, path):
    d = spark.createDataFrame([(url,)], "url string")
    assert tuple(d.select(*url_filter.address(F.col("url"))).first()) == (host, path)


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "u@a.net:8080": ("a.net", "net"), "": ("", "")}
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in d.select("host", *url_filter.domain_and_suffix(F.col("host"))).collect()}
    assert got == hosts


def plain_rule(host, path, rules):
    fits = [((len(h) + len(p), len(h)), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=((0, 0), None, None))[1:]


def test_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("b.com", "", "block"), ("a.b.com", "/fr/x", "block"), ("b.com", "", "allow")]
    rng = random.Random(1)
    seen = {(rng.choice(["org", "example.org", "x.example.org", "notexample.org", "a.b.com", "b.com", "com", "", "z.a.b.com"]), rng.choice(["", "/", "/es/", "/es", "/en/12", "/fr/x/y", "/FR/"])) for _ in range(300)}
    d = spark.createDataFrame(sorted(seen) * 2, "host string, path string")
    got = {(r.host, r.path): (r.rule, r.decided) for r in url_filter.by_rules(d, url_filter.rules_of(spark, rules)).collect()}
    want = {k: plain_rule(*k, [r for r in rules if r != ("b.com", "", "allow")]) for k in seen}
    assert got == {k: v for k, v in want.items() if v[0] is not None}


def plain_chance(known, share=0.5, low=2, high=1000):
    """known: host -> (good, pages) with two-label domains."""
    at = lambda k: lambda h: ".".join(h.split(".")[-k:])
    out = {}
    k, n = (sum(x[i] for x in known.values()) for i in (0, 1))
    mean, parent = {"": (k + 1) / (n + 2)}, lambda h: ""
    for name in (at(1), at(2), lambda h: h):
        groups = {}
        for h, (k, n) in known.items():
            g = groups.setdefault(name(h), [0, 0, mean[parent(h)]])
            g[0] += k
            g[1] += n
        live = [(k, n, p) for k, n, p in groups.values() if n]
        s0, s1, s2 = (sum((k - n * p) ** 2 for k, n, p in live), sum(n * p * (1 - p) for k, n, p in live), sum(n * (n - 1) * p * (1 - p) for k, n, p in live))
        m = low if s2 <= 0 else high if s0 <= s1 else min(max(s2 / (s0 - s1) - 1, low), high)
        prior = {g: (max(1, math.floor(p * m + 0.5)), max(1, math.floor((1 - p) * m + 0.5))) for g, (k, n, p) in groups.items()}
        mean = {g: (prior[g][0] + k) / (sum(prior[g]) + n) for g, (k, n, p) in groups.items()}
        parent = name
    for h, (k, n) in known.items():
        a, b = prior[h][0] + k, prior[h][1] + n - k
        # P(Beta(a, b) >= share) over a fine grid
        x = (np.arange(200_000) + 0.5) / 200_000
        log = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x)
        f = np.exp(log - log.max())
        out[h] = f[x >= share].sum() / f.sum()
    return out


def test_reputations_are_shrunk(spark):
    rng = random.Random(6)
    known, rows = {}, []
    for s, base in (("com", 0.8), ("net", 0.3), ("org", 0.55)):
        for d in range(5):
            for h in range(6):
                n = rng.choice([0, 1, 3, 20, 150])
                share = min(1, max(0, rng.gauss(base, 0.25)))
                k = sum(rng.random() < share for _ in range(n))
                host = f"h{h}.d{d}.{s}"
                known[host] = (k, n)
                rows += [(host, 1)] * k + [(host, 0)] * (n - k) + [(host, None)] * 2
    rows += [("u.d0.net", None), ("u.new.net", None)]
    known |= {"u.d0.net": (0, 0), "u.new.net": (0, 0)}
    d = spark.createDataFrame(rows, "host string, good int")
    got = {r.host: r.trusted for r in url_filter.reputations(d).collect()}
    chance = plain_chance(known)
    assert all(got[h] == (c > 0.05) for h, c in chance.items() if abs(c - 0.05) > 1e-3) and got.keys() == chance.keys()
    assert sum(not x for x in got.values()) > 5
    # nothing known at all blocks no host; one bad page among many good ones of the domain blocks none either
    assert all(r.trusted for r in url_filter.reputations(d.withColumn("good", F.lit(None).cast("int"))).collect())
    assert url_filter.reputations(d.limit(0)).count() == 0


def test_pages_are_judged(spark):
    rows = [(i, f"http://bad{i % 2}.spam.net/p/{i}") for i in range(60)] + [(100 + i, f"https://ok.fine.net/{i}") for i in range(60)] + [(300, "http://new.spam.net/"), (301, None), (301, None), (None, "http://x.org/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    outcomes = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(30), *range(100, 130)]], "page_id long, good int")
    got = url_filter.judge(pages, url_filter.rules_of(spark, url_filter.RULES), outcomes=outcomes).collect()
    assert len(got) == len(rows)
    verdicts = {(r.page_id, r.host): (r.rule, r.verdict) for r in got}
    assert verdicts[59, "bad1.spam.net"] == (None, "block") and verdicts[159, "ok.fine.net"] == (None, "allow")
    assert verdicts[300, "new.spam.net"] == (None, "block")  # by its domain
    assert verdicts[None, "x.org"] == ("org/", "allow") and verdicts[301, ""] == (None, "allow")
    assert url_filter.judge(pages.limit(0), url_filter.rules_of(spark, url_filter.RULES)).count() == 0
