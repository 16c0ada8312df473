from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import (
    aho_decontaminate,
    ef_trie_lm,
    hyperdimensional,
    license_diagonals,
    merkle_fixity,
    packing,
    queries,
    scaled_sketch,
    simhash_vptree,
    token_trees,
    url_rules,
)
from readloom.llm.components import connected_components
from readloom.llm.elias_fano import EliasFano, Trie
from tests.llm import brute


def key(row):
    return tuple((x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in row)


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def table(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- 1 ------------------------------------------------------------------------------------------------


def test_fixity_finds_each_damage(spark):
    rng = random.Random(1)
    a = [(f"f{i % 3}", (i // 3) * 100, 100, f"body {i}", i) for i in range(3000)]
    a += [(None, None, None, None, -1), ("f0", 5, 3, "", -2), ("f0", 5, 3, "", -2)]
    b = {i: r for i, r in enumerate(a)}
    want = set()
    for i in rng.sample(range(3000), 30):
        f, o, n, p, _ = a[i]
        what = i % 3
        if what == 0:
            del b[i]
            want.add((f, o, "missing"))
        elif what == 1:
            b[i] = (f, o, n, p + "!", 0)
            want.add((f, o, "altered"))
        else:
            b[i] = (f, o, n - 1, p, 0)
            want.add((f, o, "resized"))
    extra = ("f9", 7, 1, "x", 0)
    schema = "archive string, offset long, length long, payload string, page_id long"
    one, two = spark.createDataFrame(a, schema), spark.createDataFrame([*b.values(), extra], schema)
    found = merkle_fixity.audit(one, two, keys=("page_id",), stretch=1000, fanout=4)
    assert {(r["archive"], r["offset"], r["kind"]) for r in found.collect()} == want | {("f9", 7, "extra")}
    assert merkle_fixity.audit(one, one).count() == 0
    assert merkle_fixity.audit(one, one.filter("false")).filter("kind <> 'missing'").count() == 0
    assert merkle_fixity.audit(one.filter("false"), one.filter("false")).count() == 0


def test_fixity_opens_only_differing_branches(spark):
    rows = [("f", i * 10, 10, str(i)) for i in range(4096)]
    schema = "archive string, offset long, length long, payload string"
    a = merkle_fixity.digests(spark.createDataFrame(rows, schema), "archive", "offset", "length", "payload", [])
    b = merkle_fixity.digests(spark.createDataFrame([*rows[:99], ("f", 990, 10, "?"), *rows[100:]], schema), "archive", "offset", "length", "payload", [])
    t, u = (merkle_fixity.tree(x, 100, 8, merkle_fixity.height(x, 100, 8)) for x in (a, b))
    odd = t.exceptAll(u).groupBy("level").count().collect()
    assert {r["count"] for r in odd} == {1} and len(odd) == merkle_fixity.height(a, 100, 8) + 1


# --- 2 ------------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force(spark, sf, odd_docs, empty_docs):
    for df in (documents(spark, sf), odd_docs):
        rows = table(df)
        prints = [(i, brute.simhash(t)) for i, t in rows]
        want = [(i, p, c) for (i, p), c in zip(prints, brute.components(prints))]
        got = [(r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash_vptree.near_duplicates(df).collect()]
        same(got, want)
    assert simhash_vptree.near_duplicates(empty_docs).count() == 0


@pytest.mark.parametrize("most", [16_384, 8])
def test_links_connect_what_pairs_connect(spark, most):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 600, dtype=np.uint64)
    chain = [x[0] ^ np.uint64((1 << i) - 1) for i in range(64)]
    near = [v ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for v, a, b in zip(x[:200], rng.integers(0, 64, 200), rng.integers(0, 64, 200))]
    prints = np.unique(np.concatenate([x, chain, near]).astype(np.uint64))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    df = df.union(df).distinct().select("fingerprint", F.col("fingerprint").alias("node"))
    links = simhash_vptree.hamming_links(df, 2, leaf_home=16, leaf_most=most)
    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    groups = brute.components([(int(p), int(p) & (1 << 64) - 1) for p in prints.view(np.int64)])
    sides = defaultdict(set)
    for p, g in zip(prints.view(np.int64).tolist(), groups):
        sides[root.get(p, p)].add(g)
    assert all(len(v) == 1 for v in sides.values()) and len(sides) == len(set(groups))


def test_tree_sends_close_pairs_to_one_leaf():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    tree = simhash_vptree.fit_tree(x, 20)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ np.uint64(1)
    home = dict(zip(*simhash_vptree.route(tree, x, 0)))
    reach = set(zip(*(a.tolist() for a in simhash_vptree.route(tree, y, 2))))
    assert all((i, home[i]) in reach for i in range(2000))


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (2000 + 5, 2000)] + [(3000, 3000 + i) for i in range(500)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and got[2005] == 2000 and got[3499] == 3000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_go(spark, sf):
    docs = documents(spark, sf.replace("0.001", "0.01")).filter(F.size(F.split("text", r"\s+")) >= 100)
    rng = random.Random(7)
    rows, n = [], 0
    for i, t in table(docs.limit(150)):
        words = t.split()
        rows.append((i, t))
        for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "changed" + str(rng.randrange(1000))
        rows.append((10_000 + i, " ".join(words)))
        n += 1
    kept = simhash_vptree.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.filter("doc_id >= 10000").count() <= 0.05 * n


def test_one_of_each_keeps_the_least_id(spark, odd_docs, empty_docs):
    named = odd_docs.withColumn("_row", F.col("source")).withColumn("kept_id", F.lit(1)).withColumn("digest", F.lit("x"))
    rows = table(named)
    kept = simhash_vptree.one_of_each(named)
    assert kept.columns == named.columns
    groups = defaultdict(list)
    for (i, _), g in zip(rows, brute.near_copies([(n, t) for n, (_, t) in enumerate(rows)])):
        groups[g].append(i)
    want = [min(filter(lambda i: i is not None, g), default=None) for g in groups.values()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert kept.filter("_row is not null").count() > 0
    assert simhash_vptree.one_of_each(empty_docs).count() == 0


def test_undivided_balls_are_linked(spark):
    ball = [0, *(1 << i for i in range(63)), *((1 << i) | 1 for i in range(1, 63)), (1 << 40) - 1]
    df = spark.createDataFrame([(x, x) for x in ball], "print long, node long")
    root = {r["node"]: r["root"] for r in connected_components(simhash_vptree.ball_links(df)).collect()}
    assert {root[x] for x in ball[:-1]} == {0} and ball[-1] not in root


def test_spanning_links_connect_the_same():
    rng = np.random.default_rng(5)
    for n in (1, 5, 200):
        a, b = rng.integers(0, 100, n), rng.integers(0, 100, n)
        kept = simhash_vptree.spanning(a, b)
        one, two = (dict(zip(*(x.tolist() for x in simhash_vptree.forest(p, q)))) for p, q in ((a, b), (a[kept], b[kept])))
        assert {x: one[x] for x in two} == two and all(x in two or one[x] == x for x in one)
        assert len(kept) == len(one) - len(set(one.values()))


# --- 3 ------------------------------------------------------------------------------------------------

URLS = [None, "", "nothing", "http://com", "http://COM/", "https://a.example.com/en/x?q#f", "x://www.example.com/en/", "http://net/es/1", "http://a.net/fr/"]
URLS += ["http://notcom/", "http://.com/", "http://com./x", "://com/x", "http://u:p@example.com:80/en/", "http://example.com?/en/", "http://É.com/é", "a" * 5000 + "://com/" + "b" * 5000]


@pytest.mark.parametrize("shard", [100_000, 7])
def test_url_rules_equal_brute_force(spark, shard):
    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "b.a.net"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/a/b', '/es/', '/fr/q'])}" for _ in range(200)] + ["http://com/hot"] * 100
    rules = [*queries.URL_RULES, ("block", "a.net/"), ("allow", "b.a.net/en/a/"), ("block", "com/en/"), ("allow", "com/en/")]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, _url string")
    got = url_rules.judge(pages, url_rules.rule_table(spark, rules), shard=shard)
    assert got.filter("_url = 'z'").count() == len(urls)
    want = {i: brute.rule_of(u, [r for r in rules if r != ("block", "com/en/")]) for i, u in enumerate(urls)}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == want
    assert got.count() == len(urls)


def test_url_rules_of_empty_tables(spark):
    rules, none = url_rules.rule_table(spark, queries.URL_RULES), url_rules.rule_table(spark, [])
    pages = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    assert url_rules.judge(pages.filter("false"), rules).count() == 0
    assert url_rules.judge(pages, none).first()["verdict"] == "allow"
    for bare in ("example.com", ""):
        with pytest.raises(ValueError):
            url_rules.judge(pages, url_rules.rule_table(spark, [("block", bare), ("allow", "com/")]))


@pytest.mark.parametrize("sent", [100_000, 0])
def test_many_rules_and_a_hot_suffix(spark, monkeypatch, sent):
    """Thousands of rules, and a top level that holds nearly all URLs: nothing but its own rules is copied."""
    monkeypatch.setattr(url_rules, "SENT_SUFFIXES", sent)
    rules = [("block", f"site{i}.com/p{i % 7}/") for i in range(3_000)] + [("allow", "com/"), ("block", "com/hot/")]
    urls = [f"http://a{i}.site{i}.com/p{i % 9}/x" for i in range(1_500)] + [f"http://x{i}.com/hot/{i}" for i in range(1_500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge(pages, url_rules.rule_table(spark, rules), shard=200)
    by_host = {r.split("/")[0]: [] for _, r in rules}
    for v, r in rules:
        by_host[r.split("/")[0]].append((v, r))
    for r in got.collect():
        host = r["url"].split("/")[2].split(".")
        near = [x for i in range(len(host)) for x in by_host.get(".".join(host[i:]), [])]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute.rule_of(r["url"], near)


# --- 4 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [8 << 20, 2_000])
def test_decontamination_equals_brute_force(spark, sf, odd_docs, empty_docs, size):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    odd = [(9001, "the of and"), (None, "token"), (9002, None), (9003, "!!"), (9001, "the of and")]
    bench = bench.select("item_id", "text").union(spark.createDataFrame(odd, "item_id long, text string")) if size > 5000 else bench
    items += odd if size > 5000 else []
    for df in (documents(spark, sf).filter("doc_id < 60"), odd_docs.filter("doc_id is null or doc_id <> 9")):
        got = aho_decontaminate.digest(aho_decontaminate.scan(df, bench, automaton_bytes=size)).drop("spans")
        same([tuple(r) for r in got.collect()], [(i, *brute.decontaminate(t, items)) for i, t in table(df)])
    assert aho_decontaminate.scan(empty_docs, bench).count() == 0
    assert aho_decontaminate.scan(odd_docs, bench.filter("false")).filter(F.size("spans") > 0).count() == 0


def test_spans_point_into_the_original(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = "Ünder — " + item.upper().replace(" ", ",  ") + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = aho_decontaminate.scan(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    (s,) = row["spans"]
    assert text.encode()[s["start"] : s["end"]].decode() == item.upper().replace(" ", ",  ") and row["items"] == ["5"]


# --- 5 ------------------------------------------------------------------------------------------------


def test_license_base_equals_brute_force(spark, sf, odd_docs, empty_docs):
    for df in (documents(spark, sf), odd_docs):
        got = license_diagonals.scan(df).collect()
        same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], [(i, *brute.license_base(t, license_diagonals.PHRASES)) for i, t in table(df)])
        for r in got:
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license_diagonals.scan(empty_docs).count() == 0


def test_notices_survive_edits(spark):
    whole = license_diagonals.NOTICES[0][0]
    words = whole.split()
    edited = " ".join(words[:9] + ["really"] + words[9:20] + words[21:])
    chance = "of the " * 50 + "permission in the software"
    inserted = " ".join([*words[:12], *["more"] * 10, *words[12:]])
    twice = whole + " apart" * 300 + " " + whole
    texts = [f"x y {whole}", f"a {edited} b", chance, "the license " * 12, "the license " * 25, inserted, twice]
    # words of a notice that are all there, but spread over a long text
    spread = " ".join(w + " x" * 30 for w in words)
    docs = spark.createDataFrame(list(enumerate([*texts, spread], 1)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_diagonals.scan(docs).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["spans"][0]["first"] == 2
    assert got[2]["labels"] == "mit" and 0.5 < got[2]["score"] < 1 and got[2]["n_base"] == 0
    assert all(got[i]["labels"] == "" and got[i]["score"] < 0.3 for i in (3, 4, 5, 8))
    assert got[6]["labels"] == "mit" and len(got[6]["spans"]) == 1
    assert [s["first"] for s in got[7]["spans"]] == [0, len(words) + 300] and got[7]["score"] == 1.0


# --- 6 ------------------------------------------------------------------------------------------------


def test_elias_fano_equals_search():
    rng = np.random.default_rng(0)
    for top in (3, 1000, 10**6, 2**40, 2**62):
        for n in (0, 1, 200, 5000):
            v = np.unique(rng.integers(0, top, n))
            q = np.concatenate([v, rng.integers(0, top, 500), [0, top]])
            e = EliasFano.build(v)
            at = np.searchsorted(v, q)
            if len(v):
                assert (e.successor(q) == at).all()
            assert (e.find(q) == [i if i < len(v) and v[i] == x else -1 for i, x in zip(at, q)]).all()


def some_trie(rng):
    words, ctx = np.unique(rng.integers(0, 2**62, 300)), np.unique(rng.integers(0, 2**62, 200))
    pairs = np.unique(rng.integers(0, len(words) * len(ctx), 5_000))
    triples = np.unique(rng.integers(0, len(pairs) * len(ctx), 20_000))
    v2, a2, v3 = (rng.normal(size=n) for n in (len(pairs), len(pairs), len(triples)))
    stored = Trie.build(words, np.arange(len(words)), ctx, pairs // len(ctx), pairs % len(ctx), triples // len(ctx), triples % len(ctx), v2, a2, v3)
    return words, ctx, pairs, triples, v2, a2, v3, stored


def test_trie_returns_quantised_values():
    rng = np.random.default_rng(1)
    words, ctx, pairs, triples, v2, a2, v3, stored = some_trie(rng)
    t, k = Trie(stored), len(ctx)
    assert (t.words.find(words) == np.arange(len(words))).all() and (t.contexts.get(np.arange(k)) == ctx).all()
    at2 = t.child(2, pairs // k, pairs % k)
    assert (at2 == np.arange(len(pairs))).all()
    assert (t.child(3, triples // k, triples % k) == np.arange(len(triples))).all()
    for got, want, step in ((t.value2(at2), v2, t.scale[1]), (t.after(at2), a2, t.scale[3]), (t.value3(np.arange(len(v3))), v3, t.scale[5])):
        assert np.abs(got - want).max() <= step
    absent = np.setdiff1d(rng.integers(0, len(words) * k, 3_000), pairs)
    assert (t.child(2, absent // k, absent % k) == -1).all() and (t.child(2, np.array([-1, 0]), np.array([0, -1])) == -1).all()
    absent = np.setdiff1d(rng.integers(0, len(pairs) * k, 3_000), triples)
    assert (t.child(3, absent // k, absent % k) == -1).all()
    assert len(stored) < 12 * (len(pairs) + len(triples))


@pytest.mark.parametrize("level", ["pointers2", "pointers3"])
def test_broken_pointers_break_the_lookup(level):
    _, ctx, pairs, triples, *_, stored = some_trie(np.random.default_rng(1))
    t, k = Trie(stored), len(ctx)
    old = getattr(t, level)
    values = old.get(np.arange(len(old.low)))
    values[1:-1] = np.sort((values[1:-1] + values[-1] // 2) % (values[-1] + 1))
    values[len(values) // 3 :] = values[-1]
    setattr(t, level, EliasFano.build(values))
    parts = (2, pairs) if level == "pointers2" else (3, triples)
    assert (t.child(parts[0], parts[1] // k, parts[1] % k) != np.arange(len(parts[1]))).mean() > 0.3


def lm_rows(df):
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted([(str(r["doc_id"]), r["held_out"], *[r[c] for c in columns]) for r in df.collect()], key=str)


def assert_scores(got, want):
    assert len(got) == len(want)
    for a, b in zip(want, got):
        assert a[:5] == b[:5]
        assert b[5] == pytest.approx(a[5], rel=1e-9) and b[6] == pytest.approx(a[6], rel=1e-3, abs=0.01)


def test_language_model_equals_brute_force(spark, sf, odd_docs, empty_docs, monkeypatch):
    for df, shard in ((documents(spark, sf), 1_000_000), (odd_docs, 2_000)):
        monkeypatch.setattr(ef_trie_lm, "SHARD", shard)
        rows = table(df)
        held, want = brute.language_model(rows, ef_trie_lm.MU, ef_trie_lm.BOOST)
        assert_scores(lm_rows(ef_trie_lm.fit_score(df)), sorted([(str(i), h, *w) for (i, _), h, w in zip(rows, held, want)], key=str))
    assert ef_trie_lm.fit_score(empty_docs).count() == 0


def test_heads_are_dealt_evenly():
    """64 tasks of 40 batches: no group of heads holds more than twice its share and a few."""
    shards = 60
    groups = np.bincount([-1 - ef_trie_lm.head_shard((task << 32) + block, shards) for task in range(64) for block in range(40)], minlength=shards)
    assert len(groups) == shards and groups.max() <= 2 * 64 * 40 / shards


def test_stored_tries_score_other_texts(spark, sf, odd_docs, empty_docs, monkeypatch):
    """Tries are written by one job and searched by another, of texts that the first never saw as well."""
    df = documents(spark, sf).select("doc_id", "text")
    monkeypatch.setattr(ef_trie_lm, "SHARD", 20_000)
    model = ef_trie_lm.fit(df)
    assert model.tries.count() > 1
    whole = lm_rows(ef_trie_lm.fit_score(df))
    assert_scores(lm_rows(ef_trie_lm.score(df, model)), whole)
    more = df.union(odd_docs.select(F.lit(10_000) + F.col("doc_id"), "text"))
    got = ef_trie_lm.score(more, model)
    assert got.count() == more.count() and got.filter("score is null or score > 0").count() == 0
    assert_scores(lm_rows(got.filter("doc_id < 10000")), whole)
    nothing = ef_trie_lm.fit(empty_docs)
    assert ef_trie_lm.score(df, nothing).filter("n_known > 0").count() == 0 and ef_trie_lm.score(empty_docs, model).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark, sf):
    row = ef_trie_lm.fit_score(documents(spark, sf)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


# --- 7 ------------------------------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark, sf, odd_docs, empty_docs):
    single_ids = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for df in (documents(spark, sf), single_ids):
        same([tuple(r) for r in scaled_sketch.neighbours(df).collect()], brute.neighbour_rows(table(df)))
    got = scaled_sketch.neighbours(odd_docs).collect()
    same([(r["doc_id"], r["n_chars"]) for r in got], [(i, len(t or "")) for i, t in table(odd_docs)])
    assert scaled_sketch.neighbours(empty_docs).count() == 0
    single = scaled_sketch.neighbours(spark.createDataFrame([(1, "just one text")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0


def test_many_buckets_give_the_same(spark, sf, monkeypatch):
    df = documents(spark, sf)
    monkeypatch.setattr(scaled_sketch, "BORDER_ROWS", 30)
    same([tuple(r) for r in scaled_sketch.neighbours(df).collect()], brute.neighbour_rows(table(df)))


def test_containment_of_unequal_documents(spark):
    rng = random.Random(2)
    big = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(big)), (2, " ".join(big[3000:5000])), (3, " ".join(f"v{i}" for i in range(3000))), (4, " ".join(big[:90]))], "doc_id long, text string")
    all_ = scaled_sketch.sketches(docs)
    s = {r["doc_id"]: r["sketch"] for r in all_.collect()}
    # one fraction for all texts: a sketch's size follows the text's
    for i, t in table(docs):
        assert len(s[i]) == pytest.approx(len(set(t[j : j + 16] for j in range(len(t) - 15))) / 4, rel=0.25)
    rows = spark.createDataFrame([(s[2], s[1]), (s[3], s[1]), (s[1], s[2]), (s[4], s[1]), ([], s[1])], "a array<string>, b array<string>")
    got = [r[0] for r in rows.select(scaled_sketch.containment(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and got[1] == 0 and got[2] == pytest.approx(0.1, abs=0.03) and got[3] == 1 and got[4] is None
    union = scaled_sketch.merged(all_.withColumn("g", F.lit(1)), "g").first()
    assert union["sketch"] == sorted({f"{x:012x}" for _, t in table(docs) for x in brute.scaled(t)})


@pytest.mark.parametrize("words, most", [(10, 0.25), (25, 0.14), (60, 0.09), (250, 0.05), (1_000, 0.03)])
def test_error_of_likeness_by_length(words, most):
    """Texts that share their first half: the estimate's root mean square error."""
    rng = random.Random(8)
    off = []
    for _ in range(120):
        a, b = ([f"w{rng.randrange(5000)}" for _ in range(words)] for _ in range(2))
        b[: words // 2] = a[: words // 2]
        texts = [" ".join(a), " ".join(b)]
        near, _ = scaled_sketch.likeness(*scaled_sketch.sketches_of(texts))
        exact, _ = scaled_sketch.likeness(*scaled_sketch.sketches_of(texts, scale=1))
        off.append((near - exact) ** 2)
    assert np.sqrt(np.mean(off)) < most


def test_snippets_of_a_long_text_are_in_it():
    rng = random.Random(8)
    big = [f"w{rng.randrange(5000)}" for _ in range(3_000)]
    cuts = [(at, at + rng.randint(6, 60)) for at in (rng.randrange(2_900) for _ in range(300))]
    whole, *snippets = scaled_sketch.sketches_of([" ".join(x) for x in (big, *(big[a:b] for a, b in cuts))])
    found = [scaled_sketch.likeness(x, whole) for x in snippets]
    assert all(near == 1.0 if known else near == 0.0 for near, known in found)
    assert sum(not known for _, known in found) < 6


def test_many_texts_are_hashed_like_one():
    rng = random.Random(9)
    texts = ["".join(rng.choices("aB \té日", k=rng.randint(0, 70))) for _ in range(200)] + [None, "", " ", "x"]
    together = scaled_sketch.sketches_of(texts)
    for text, sketch in zip(texts, together):
        assert sketch.tolist() == brute.scaled(text) == scaled_sketch.sketches_of([text])[0].tolist()


# --- 8 ------------------------------------------------------------------------------------------------


def named_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return lambda t: full.encode(t, add_special_tokens=False).ids


def edited(text):
    """The query's three edits, said again in Python."""
    n, first = len(text), text[:24]
    for start, removed, inserted in ((n // 2, 3, first), (n // 3, 40, ""), (0, 1, "New 2")):
        text = text[:start] + inserted + text[start + removed :]
    return text


def test_token_query_equals_brute_force(spark, sf):
    encode = named_tokenizer()
    got = queries.op8_token_trees(spark, sf).collect()
    want = {i: (len(encode(t)), edited(t)) for i, t in table(documents(spark, sf))}
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        before, after = want[r["doc_id"]]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (before, len(encode(after)), len(after))
        assert r["edited_sha256"] == hashlib.sha256(after.encode()).hexdigest()
    assert sum(r["recoded_chars"] for r in got) < sum(r["edited_chars"] for r in got)


def test_stored_trees_are_resumed(spark, odd_docs, empty_docs):
    encode = named_tokenizer()
    trees = token_trees.count(odd_docs)
    same([(r["doc_id"], r["n_tokens"]) for r in trees.collect()], [(i, len(encode(t or ""))) for i, t in table(odd_docs)])
    one = token_trees.resume(trees.withColumn("edits", queries.edits(F.col("text"))))
    again = one.withColumn("edits", F.expr("array(null, named_struct('start', 5, 'removed', cast(null as int), 'inserted', 'again '), named_struct('start', null, 'removed', null, 'inserted', null))"))
    for df in (one, token_trees.resume(again)):
        for r in df.collect():
            assert r["edited_tokens"] == len(encode(r["text"])) == r["tree_tokens"][1]
            assert r["edited_chars"] == len(r["text"]) == r["tree_chars"][1]
    assert token_trees.resume(trees.withColumn("edits", F.lit(None).cast("array<struct<start:int,removed:int,inserted:string>>"))).agg(F.sum("recoded_chars")).first()[0] == 0
    assert token_trees.resume(token_trees.count(empty_docs).withColumn("edits", queries.edits(F.col("text")))).count() == 0


def test_leaves_dont_grow_with_edits():
    encode = packing.encoder(packing.VOCABULARY, None)
    text = "some words of a text " * 500
    tree = token_trees.TokenTree.build(text, lambda s: len(encode(s)))
    for _ in range(5):
        text, _ = tree.edit(text, 5_000, 0, "more words here " * 500, lambda s: len(encode(s)))
    text, recoded = tree.edit(text, 20_000, 1, "x", lambda s: len(encode(s)))
    assert recoded < 4 * token_trees.LEAF and tree.tokens[1] == len(encode(text)) and tree.chars[1] == len(text)


def test_random_edits():
    encode = packing.encoder(packing.VOCABULARY, None)
    rng, seen = random.Random(6), 0
    for text in ["", "a", "word " * 60, "\n\n x  y 1 2 " * 30, "'re 'll don't it's", "漢字 かな " * 20, "é1² " * 40]:
        for leaf in (1, 7, 64):
            tree, now = token_trees.TokenTree.build(text, lambda s: len(encode(s)), leaf), text
            for _ in range(12):
                start, gone, new = rng.randint(0, len(now) + 2), rng.choice([0, 1, 3, 50]), "".join(rng.choices("ab '\n é1²漢", k=rng.randint(0, 5)))
                want = now[: min(start, len(now))] + new + now[min(start, len(now)) + gone :]
                now, recoded = tree.edit(now, start, gone, new, lambda s: len(encode(s)), leaf)
                assert now == want and tree.tokens[1] == len(encode(now))
                seen += recoded < len(now)
    assert seen > 20


# --- 9 ------------------------------------------------------------------------------------------------


def packed_whole(rows, docs, size=1024):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = sorted((str(i), tuple([*full.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[str(r["doc_id"])].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, x in ids:
        for s in range(0, len(x), size):
            cut = np.array(x[s : s + size], "<u4")
            want[i].append((s, len(cut), zlib.crc32(cut.tobytes()), len(x)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    stored = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        stored += size if at & (at - 1) else at
    return sum(r["length"] for r in rows) / max(1, stored)


def test_packing_is_a_round_trip(spark, sf, odd_docs, empty_docs):
    df = documents(spark, sf)
    assert packed_whole(packing.pack(df).collect(), table(df)) > 0.97
    packed_whole(packing.pack(odd_docs, group=16).collect(), table(odd_docs))
    assert packing.pack(empty_docs).count() == 0


def test_first_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 400):
        lengths = rng.integers(1, 101, n)
        free, want = [], {}
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            b = next((j for j, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= int(lengths[i])
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def test_fast_ids_equal_the_tokenizers(spark, sf):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    full, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder(packing.VOCABULARY, None)
    texts = [t for _, t in table(documents(spark, sf.replace("0.001", "0.01")))] + ["", " ", "\u00a0\u2003x", "a<|endoftext|>b", "🙂 ok\r\n\t x", "١٢٣ ²³ ½", "e\u0301 ﬁ"]
    for t in texts:
        assert encode(t) == full.encode(t, add_special_tokens=False).ids


# --- 10 -----------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_texts(spark, sf):
    df = documents(spark, sf.replace("0.001", "0.01"))
    learnt = hyperdimensional.training_rows(df)
    model = hyperdimensional.fit(df.filter(learnt), "text", "lang")
    got = hyperdimensional.with_language(df, *model).filter(~learnt)
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97


def test_language_of_odd_rows(spark, odd_docs, empty_docs):
    model = hyperdimensional.fit(odd_docs.filter(hyperdimensional.training_rows(odd_docs)), "text", "lang")
    got = hyperdimensional.with_language(odd_docs, *model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model[0]) == letters and 0 <= r["score"] <= 1
    nothing = hyperdimensional.fit(empty_docs, "text", "lang")
    assert hyperdimensional.with_language(odd_docs, *nothing).filter("lang_pred <> 'und'").count() == 0
    assert hyperdimensional.with_language(empty_docs, *model).count() == 0


def letter(c):
    return np.random.default_rng((hyperdimensional.SEED, ord(c))).integers(0, 2, hyperdimensional.DIMENSIONS, dtype=np.int8).astype(int) * 2 - 1


def bundle(text):
    """A text's trigrams around each letter, bound and added one by one; anything else is a blank."""
    chars = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    grams = [np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(chars, chars[1:], chars[2:]) if b != " "]
    return np.sum(grams, axis=0) if grams else np.zeros(hyperdimensional.DIMENSIONS, int)


def test_languages_equal_bundled_vectors(spark, sf):
    df = documents(spark, sf)
    learnt = df.filter(hyperdimensional.training_rows(df)).filter("length(text) < 400")
    langs, prototypes = hyperdimensional.fit(learnt, "text", "lang")
    sums = defaultdict(int)
    for r in learnt.collect():
        if r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums[r["lang"]] + bundle(r["text"])
    assert langs == sorted(sums)
    want = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    assert np.allclose(prototypes, want, atol=1e-5)
    ratios = []
    for r in hyperdimensional.with_language(df.filter("length(text) < 400"), langs, prototypes).collect():
        v = bundle(r["text"] or "")
        if v.any():
            cosines = want @ v / np.linalg.norm(v)
            assert cosines[langs.index(r["lang_pred"])] >= cosines.max() - 1e-6
            ratios.append(r["score"] / cosines.max() if cosines.max() > 0.05 else 1.0)
        else:
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert np.abs(np.array(ratios) - 1).mean() < 0.05 and np.abs(np.array(ratios) - 1).max() < 0.15, (np.mean(ratios), np.min(ratios), np.max(ratios))


def test_rare_languages_are_learnt(spark):
    rows = [(i, f"common words number {i}", "aa") for i in range(3000)] + [(5000 + i, "других слов немного", "bb") for i in range(3)] + [(None, "null id", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, again = (hyperdimensional.fit(x, "text", "lang", fit_rows=60) for x in (df, df.repartition(7)))
    assert first[0] == ["aa", "bb", "cc"] and np.allclose(first[1], again[1])


def test_inner_products_are_those_of_the_vectors():
    p = hyperdimensional.Profile(["abcabc", None, "", "Été 12"])
    codes, at = p.distinct()
    proto = np.random.default_rng(0).normal(size=(2, hyperdimensional.DIMENSIONS)).astype(np.float32)
    assert np.allclose(p.inner(codes, proto), p.bound(codes).astype(float) @ proto.T, atol=1e-2)
    assert p.letters.tolist() == [6, 0, 0, 3]
