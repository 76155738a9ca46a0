import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from brute import words
from conftest import SMALL
from edge import BASE, ROWS, table

from stackyard.llm import interpolated_lm as lm
from stackyard.llm import sharding, syncmers, toxicity, url_filter
from stackyard.llm.queries import ORACLES, QUERIES


def documents(spark):
    return {r.doc_id: r.text for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


# language model

def held(i, modulus=7):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == 2


def check_base(rows, texts):
    tokens = [(i, [*words(t), None]) for i, t in texts]
    train = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(train.values()), len(train)
    expected = sorted((str(i), held(i), len(ws), sum(train[w] > 0 for w in ws), n,
                       round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in rows) == expected


def test_lm_query(spark):
    rows = QUERIES["op2_interpolated_lm"](spark, SMALL).collect()
    check_base(rows, documents(spark).items())
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in rows)


def test_lm_counts_do_not_depend_on_blocks(spark, monkeypatch):
    texts = [(i, t) for i, t in documents(spark).items() if i < 60]
    docs = table(spark, texts).repartition(3, "doc_id")
    docs.write.mode("overwrite").parquet(path := f"{lm.saved(docs.limit(1), 'probe').inputFiles()[0]}-docs")
    docs = spark.read.parquet(path)
    whole = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_CHARS", 5000)
    small = lm.lm_scores(docs).collect()
    check_base(small, texts)
    assert all(abs(r.score - whole[r.doc_id]) < 1e-6 * abs(whole[r.doc_id]) for r in small)


def test_lm_score_is_the_stated_mixture(spark):
    texts = [(i, " ".join("abcde"[(i * j) % 5] for j in range(1, 9))) for i in range(1, 40)]
    train = [[None, *words(t), None] for i, t in texts if not held(i)]
    single = Counter(w for ws in train for w in ws[1:])
    pairs = Counter(p for ws in train for p in zip(ws, ws[1:]))
    n, v = sum(single.values()), len(single)
    used = []
    original = lm.learn_weights
    lm.learn_weights = lambda *a: used.append(original(*a)) or used[-1]
    try:
        rows = lm.lm_scores(table(spark, texts)).collect()
    finally:
        lm.learn_weights = original
    weights = used[0]
    assert all(abs(sum(w) - 1) < 1e-9 for w in weights)
    for r in rows:
        ws = [None, *words(dict(texts)[r.doc_id]), None]
        expected = 0.0
        for u, w in zip(ws, ws[1:]):
            l2, l1, l0 = weights[0 if not single[u] else min(int(math.log2(single[u])) + 1, lm.BUCKETS - 1)]
            p = l1 * single[w] / n + l0 / (v + 1) + (l2 * pairs[u, w] / single[u] if single[u] else 0)
            expected += math.log10(p)
        assert abs(r.score - expected) < 1e-9


def test_weights_raise_the_likelihood(spark):
    rows = [(5, 10, 20, 100), (0, 10, 2, 30), (0, 0, 3, 10), (0, 0, 0, 5), (1, 3, 1, 7)]
    table_ = spark.createDataFrame(rows, "pair bigint, context bigint, word bigint, n bigint")

    def likelihood(w):
        total = 0
        for p, c, x, n in rows:
            l2, l1, l0 = w[0 if not c else int(math.log2(c)) + 1]
            total += n * math.log((l2 * p / c if c else 0) + l1 * x / 200 + l0 / 51)
        return total

    values = [likelihood(lm.learn_weights(table_, 200, 50, k)) for k in (0, 1, 3, 15)]
    assert values == sorted(values)


def test_lm_of_awkward_rows(spark):
    check_base(lm.lm_scores(table(spark)).collect(), ROWS)
    assert lm.lm_scores(table(spark, [])).collect() == []
    only_held = next(i for i in range(100) if held(i))
    row, = lm.lm_scores(table(spark, [(only_held, "a b")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


# toxicity

def toxic_corpus(n=400):
    import random
    rng = random.Random(3)
    calm = ["river", "stone", "window", "garden", "letter", "morning", "under", "bright", "carry", "slow"]
    rude = ["blockhead", "nitwitted", "scoundrel"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        ws = rng.choices(calm, k=rng.randrange(20, 200))
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(rude))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.toxicity(table(spark, rows), marks).collect()
    truth = dict(labels)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i, _ in rows if held(i, 4)}
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    kept = toxicity.drop_toxic(table(spark, rows), marks)
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_not_learned(spark):
    rows, labels = toxic_corpus()
    flipped = [(i, 1 - y if held(i, 4) else y) for i, y in labels]
    models = [toxicity.train(table(spark, rows), spark.createDataFrame(x, "doc_id bigint, toxic int"))
              for x in (labels, flipped)]
    assert models[0] == models[1]


def test_toxicity_of_awkward_rows(spark):
    _, labels = toxic_corpus()
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 1), (1, 0)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(table(spark), marks).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert toxicity.toxicity(table(spark, []), marks).collect() == []
    unlabelled = toxicity.toxicity(table(spark), marks.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.0}


def test_toxicity_query(spark):
    rows = QUERIES["op8_toxicity"](spark, SMALL).collect()
    assert len(rows) == len(documents(spark))
    assert {r.doc_id for r in rows if r.held_out} == {i for i in documents(spark) if held(i, 4)}


# fingerprints

def slow_syncmers(text, k=syncmers.K, s=syncmers.S):
    """Places of closed syncmers, each window on its own."""
    inner = {}

    def value(i):
        part = text[i:i + s]
        if part not in inner:
            inner[part] = syncmers.syncmers(part, k=s, s=s)[0][0]
        return inner[part]

    # with k = s the only s-mer is the k-mer, so its hash orders s-mers in some fixed way
    out = []
    for i in range(len(text) - k + 1):
        window = [value(i + j) for j in range(k - s + 1)]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


def test_syncmers_do_not_depend_on_context():
    a, b = BASE * 3, "Something else in front. " + BASE * 3 + " and behind."
    ha, pa = syncmers.syncmers(a)
    hb, pb = syncmers.syncmers(b)
    found = dict(zip((pb - 25).tolist(), hb.tolist()))
    assert all(found[p] == h for p, h in zip(pa.tolist(), ha.tolist()))
    inside = [p for p in found if 0 <= p <= len(a) - syncmers.K]
    assert sorted(inside) == pa.tolist()
    density = len(slow_syncmers(a)) / (len(a) - syncmers.K + 1)
    assert 0.5 * density <= len(pa) / (len(a) - syncmers.K + 1) <= 2 * density


def test_likeness():
    one, other = syncmers.fingerprint(BASE * 2), syncmers.fingerprint("".join(map(chr, range(300, 900))))
    assert syncmers.likeness(one, one) == 1 and syncmers.likeness(one, other) == 0
    assert syncmers.likeness([], []) == 1 and syncmers.likeness(one, []) == 0
    # the same anchors in another order of places are not alike
    assert syncmers.likeness([(1, 0), (2, 5), (3, 9)], [(1, 9), (2, 5), (3, 0)]) == 1 / 3


def test_long_texts_keep_all_anchors():
    import random
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    passage = "".join(rng.choices(letters, k=1000))
    one, other = ("".join(rng.choices(letters, k=n)) + passage + "".join(rng.choices(letters, k=20_000 - n))
                  for n in (6_000, 14_000))
    changed = "".join("#" if i % 97 == 0 else c for i, c in enumerate(one))
    anchors = {}
    for t in (one, other, changed):
        anchors[t] = {}
        for p in range(len(t) - syncmers.K + 1):   # each k-mer on its own
            if len(syncmers.syncmers(t[p:p + syncmers.K])[1]):
                anchors[t].setdefault(t[p:p + syncmers.K], p)
        prints = syncmers.fingerprint(t)
        assert sorted(p for _, p in prints) == sorted(anchors[t].values())
        assert syncmers.as_text(prints) == ",".join(f"{h:08x}:{p:x}" for h, p in prints)
    for a, b, least in ((one, other, 60), (one, changed, 1000)):
        both = anchors[a].keys() & anchors[b].keys()   # all of them in the same order of places
        expected = len(both) / len(anchors[a].keys() | anchors[b].keys())
        assert len(both) > least
        assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) == expected < 1


def check_fingerprints(rows, docs):
    """``docs`` in the order in which they follow each other."""
    expected = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        changed = syncmers.edited(t, after)
        a, b, c = map(syncmers.fingerprint, (t, changed, after))
        expected.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), syncmers.as_text(a),
                         syncmers.as_text(b), syncmers.likeness(a, b), syncmers.likeness(a, c)))
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_fingerprint_query(spark):
    rows = QUERIES["op10_syncmers"](spark, SMALL).collect()
    check_fingerprints([(str(r[0]), *r[1:]) for r in rows], sorted(documents(spark).items()))


@pytest.mark.parametrize("n", [0, 1, 2, 9, len(ROWS)])
def test_fingerprints_of_awkward_rows(spark, n):
    chosen = [(i, t or "") for i, t in ROWS[len(ROWS) - n:]]
    rows = syncmers.fingerprints(table(spark, chosen)).collect()
    order = sorted(chosen, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    check_fingerprints([(str(r[0]), *r[1:]) for r in rows], order)


# urls

def test_url_query_equals_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    expected = con.execute(ORACLES["op3_url_filter"]).fetchall()
    names = [d[0] for d in con.description]
    got = QUERIES["op3_url_filter"](spark, SMALL).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


URLS = [
    (1, "HTTP://Foo.Example.NET/en/x?q#f", "foo.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "https://example.net", "example.net", "", None, "allow"),
    (3, "https://example.net/de", "example.net", "/de", "net/", "block"),
    (4, "ftp://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    (5, "x://a.example.com/de/?u=://b.org/fr/", "a.example.com", "/de/", "example.com/de/", "block"),
    (6, "http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    (7, "http://www.cheap-pills.example.com/en/1", "www.cheap-pills.example.com", "/en/1", None, "block"),
    (8, "no scheme/cheap-pills.", "", "", None, "allow"),
    (9, None, "", "", None, "allow"), (10, "", "", "", None, "allow"), (11, "://", "", "", None, "allow"),
    (None, "http://a.org/fr?x", "a.org", "/fr", None, "allow"),
    (12, "http://#x/y", "", "", None, "allow"), (13, "http://a\nb.org/fr/\nx", "a\nb.org", "/fr/\nx", "org/fr/", "allow"),
    (14, "http://x.com/?affiliate_id=3", "x.com", "/", None, "block"),
]


def test_urls_one_by_one(spark):
    pages = spark.createDataFrame([(r[0], r[1], 1, "r") for r in URLS],
                                  "page_id bigint, url string, id int, rule string")
    got = url_filter.filter_urls(pages).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == sorted(
        ((str(i), h, p, rule, v) for i, _, h, p, rule, v in URLS), key=lambda x: x)
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_index_uses_the_rarest_token_and_finds_every_match(spark):
    import re
    rules = url_filter.PATTERN_RULES
    index = url_filter.build_index(rules, {"cheap": 9, "pills": 2, "spam": 1, "farm": 1})
    assert any("cheap-pills" in p for p in index["pills"]) and any("spam-farm" in p for p in index["farm"])
    urls = [u for _, u, *_ in URLS if u] + ["http://a.b/wp-login.php", "http://spam-farm.x/", "http://x/viagra"]
    for u in urls:
        fetched = {p for t in url_filter.tokens(u) for p in index.get(t, ())}
        for r in rules:
            assert not re.search(r.pattern, u.lower()) or r.pattern in fetched


OPTIONAL = [
    "http://clickbait.example.com/x", "http://click-bait.example.com/x", "http://a.clickbait.org/", "http://bait.x/",
    "http://online-casino.x/", "http://casino-x/", "http://a.online-casino-x/", "http://mycasino.x/",
    "http://free-porn.x/", "http://porn.x/", "http://a.porn-x/", "http://payday-loan/", "http://payday-loans.x/",
    "http://a.payday-loan.x/", "http://payday-loaning.x/", "http://replica-watches/", "http://a.replica-watches.x/",
    "http://xcheap-pills.x/", "http://x-cheap-pills.x/", "http://a.spam-farm.x/", "http://spam-farms.x/",
]


def test_every_way_through_a_rule_is_indexed(spark):
    import re
    rules = url_filter.PATTERN_RULES
    pages = spark.createDataFrame(list(enumerate(OPTIONAL)), "page_id bigint, url string")
    got = {r.page_id: (r.verdict, r.pattern) for r in url_filter.filter_urls(pages, places=()).collect()}
    for i, u in enumerate(OPTIONAL):
        first = min((r.pattern for r in rules if re.search(r.pattern, u)), default=None)
        assert got[i] == ("block" if first else "allow", first), u
    assert sum(p is not None and "bait" in p for _, p in got.values()) == 3


def test_tokens_come_from_the_expression():
    def ways(pattern):
        return {tuple(sorted(w)) for w in url_filter.PatternRule(pattern).ways}

    assert ways(r"/click-?bait\.") == {("bait", "click"), ("clickbait",)}
    assert ways(r"/(free-)?porn[.-]") == {("free", "porn"), ("porn",)}
    assert ways(r"/(a|bc)\b.*\bd[/.]+e/") == {("a", "d", "e"), ("bc", "d", "e")}
    assert ways(r"/loans?x*-far/") == {("far", "loan"), ("far", "loans"), ("far",)}
    for none in ("casino", r"/casino", r"/x?", r"/a[a-c]/", r"/(ab)*/", r"/b\w+", r"/(?i:abc)/", r"(?i)/abc/", r"/(?=abc/)"):
        with pytest.raises(ValueError):
            ways(none)


# shards

def check_shards(rows, docs):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r.vslot, r.shard) for r in rows}) == len({r.vslot for r in rows})


def test_sharding_query(spark):
    rows = QUERIES["op4_sharding"](spark, SMALL).collect()
    check_shards(rows, documents(spark).items())
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert len(load) == 24
    largest = max(r["size"] for r in rows)
    assert max(load.values()) - min(load.values()) <= max(largest, 0.02 * max(load.values()))


def test_sharding_of_awkward_rows(spark):
    check_shards(sharding.shard_documents(table(spark), shards=3, slots=8).collect(), ROWS)
    assert sharding.shard_documents(table(spark, [])).collect() == []


def test_rebalance_edits_as_little_as_it_needs():
    sizes = [10] * 40
    even = sharding.first_map(40, 4)
    assert sharding.rebalance(sizes, even, 4) == even
    sizes[0] = 200
    edited = sharding.rebalance(sizes, even, 4)
    load = [sum(s for s, m in zip(sizes, edited) if m == k) for k in range(4)]
    assert max(load) == 200 and sorted(load)[-2] - min(load) <= 10
    assert edited[0] == even[0]
    grown = sharding.rebalance([10] * 40, even, 5)
    assert [grown.count(k) for k in range(5)] == [8] * 5
    assert sum(a != b for a, b in zip(even, grown)) == 8 and all(b == 4 for a, b in zip(even, grown) if a != b)


def test_slot_map_has_versions(spark):
    rows = sharding.slot_map(spark, [[0, 1], [1, 1]]).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 1)]


def test_stored_map_gets_its_next_version(spark, tmp_path):
    path = str(tmp_path / "map")
    size = {"shards": 4, "slots": 64, "map_path": path}
    docs = [(i, "x" * (i * 37 % 500)) for i in range(300)]

    def versions():
        out = {}
        for r in spark.read.parquet(path).collect():
            out.setdefault(r.version, {})[r.vslot] = r.shard
        return out

    def stored():
        return spark.read.parquet(path)

    first = sharding.shard_documents(table(spark, docs), **size).collect()
    old = versions()
    assert old.keys() == {1, 2} and {r.map_version for r in first} == {2}
    assert [old[1][s] for s in range(64)] == sharding.first_map(64, 4)
    assert all(old[2][r.vslot] == r.shard for r in first)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sharding.shard_documents(table(spark, docs), **size)

    more = docs + [(i, "y" * 3000) for i in range(300, 330)]
    second = sharding.shard_documents(table(spark, more), stored=stored(), **size).collect()
    new = versions()
    check_shards(second, more)
    assert new.keys() == {1, 2, 3} and (new[1], new[2]) == (old[1], old[2])
    assert {r.map_version for r in second} == {3} and all(new[3][r.vslot] == r.shard for r in second)
    assert 0 < sum(new[3][s] != new[2][s] for s in range(64)) < 48
    # a reader of version 2 still finds what the first run placed
    found = sharding.located(table(spark, docs), stored(), 2).collect()
    assert {(r.doc_id, r.vslot, r.shard) for r in found} == {(r.doc_id, r.vslot, r.shard) for r in first}

    third = sharding.shard_documents(table(spark, more), stored=stored(), **size).collect()
    assert versions() == new and sorted(third) == sorted(second)
    for wrong in ({**size, "slots": 32}, {**size, "shards": 3}, {**size, "map_path": None}):
        with pytest.raises(ValueError):
            sharding.shard_documents(table(spark, docs), stored=stored(), **wrong)
