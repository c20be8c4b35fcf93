"""Near-duplicates, repeats, vectors, leaks, toxicity and archives against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import common, components, decontaminate, jaccard_join, queries, suffix_dedup, toxicity, vector_search, warc
from stratalog.llm.suffix_groups import suffix_array


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The smallest table, hard rows, and a group of near copies of which not all are linked with one another."""
    random.seed(7)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randrange(5)):
            w[random.randrange(120)] = f"x{random.randrange(10**6)}"
        near.append((5000 + i, " ".join(w)))
    hard = [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two\n"), (9004, "a b c d e"), (9005, "A B C D E"), (9006, " \t\n"), (9007, "long " * 30_000), (9008, "long " * 30_001), (9009, "é " * 200), (9004, "a b c d e")]
    more = spark.createDataFrame(near + hard, "doc_id long, text string").withColumns({"token": F.lit("clash"), "doc": F.lit(1), "n": F.lit(2)})
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumns({"token": F.lit(None).cast("string"), "doc": F.lit(1), "n": F.lit(2)})
    return common.saved(own.unionByName(more), "test-docs")


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split() if t else []
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components(docs, monkeypatch, small):
    if small:  # every bound is reached
        for name, value in (("SHORT_LIST", 3), ("BUNDLE", 900), ("BLOCK", 4), ("FLUSH", 500)):
            monkeypatch.setattr(jaccard_join, name, value)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()}
    assert got == plain_components(texts)


def test_jaccard_of_rows_with_one_id(spark):
    """Of rows with one doc_id the largest set counts, wherever it stands; repeated rows change nothing."""
    words = [f"w{i}" for i in range(40)]
    long, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, long), (2, "short one"), (2, long + " end"), (2, None), (3, other), (3, other), (4, other + " x"), (4, "w1 w2 w3"), (5, "w1 w2 w3"), (6, ""), (6, "w1 w2 w3")]
    texts = {i: max((t or "" for j, t in rows if j == i), key=lambda t: len(t.split())) for i, _ in rows}
    for order in (rows, rows[::-1]):
        got = jaccard_join.link_documents(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == 6 and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(texts)


def test_jaccard_keeps_no_tables_that_are_used_up(docs):
    """What was written for a step goes when the next is written, so that it doesn't add up on disk."""
    before = set(common._WRITTEN)
    found = jaccard_join.link_documents(docs)
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(common._WRITTEN) - before}
    assert left.isdisjoint({"prefixes", "shared-tokens", "postings", "pivots", "candidates", "candidate-ids", "sets", "open-tokens", "open-lists", "bundles", "bundle-ids", "bundle-sets"})
    assert found.count() == docs.select("doc_id").distinct().count()


def test_jaccard_deals_out_large_bundles_in_passes(docs, monkeypatch):
    """Pairs of blocks grow with the square of a bundle; a pass holds a share of the input's shingles."""
    for name, value in (("SHORT_LIST", 3), ("BUNDLE", 900), ("SHARE", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    names = []
    monkeypatch.setattr(jaccard_join, "saved", lambda df, name: (names.append(name), common.saved(df, name))[1])
    before = set(common._WRITTEN)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()}
    assert got == plain_components(dict(docs.where("doc_id <> 9004 or text = 'a b c d e'").select("doc_id", "text").collect()))
    assert names.count("bundle-links") > 1
    assert not any(x in path for path in set(common._WRITTEN) - before for x in ("bundle-links", "paired-links"))


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    """Without waiting for the driver to collect its garbage, which it may do late or never."""
    import time

    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in every.split("\n") if x.endswith(".data")}

    rows = spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"), F.max("id").alias("m"))
    before, setting = files(), spark.conf.get(common._CLEANUP)
    found = common.saved(rows, "test-shuffles")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common._CLEANUP) == setting
    assert found.agg(F.sum("n")).first()[0] == 50_000 and rows.count() == 7


def test_jaccard_of_nothing(docs):
    assert jaccard_join.link_documents(docs.limit(0)).collect() == []


def test_divide_skip_counts_like_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        members = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(rng.integers(1, 20))]
        query = np.unique(rng.integers(0, 60, 30).astype(np.uint64))
        need = [int(rng.integers(1, 20)) for _ in members]
        want = [i for i, m in enumerate(members) if len(np.intersect1d(m, query)) >= need[i]]
        assert sorted(jaccard_join.divide_skip(query, members, need)) == want


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (2, 9), (4, 5)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {3: 1, 4: 1, 5: 1, 8: 2, 9: 2}
    assert components.components(edges.limit(0)).collect() == []


def plain_repeats(texts, window=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            x = b[s : s + window]
            if x in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(x)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix_dedup, "CLASSES", 2)
        monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    phrase = "".join(random.Random(5).choices("abcdefgh é", k=400))
    texts = {9500: phrase, 9501: "x" + phrase[50:350] + "y", 9502: phrase[100:250] + phrase[100:250], 9503: "z" * 1000, 9504: phrase[:99], 9505: "ab" * 300}
    more = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    every = docs.select("doc_id", "text").where("doc_id < 60 or doc_id >= 5000").unionByName(more)
    want = plain_repeats({r.doc_id: r.text for r in every.collect()})
    rounds = []
    split = suffix_dedup._splitter
    monkeypatch.setattr(suffix_dedup, "_splitter", lambda *x: rounds.append(x) or split(*x))
    got = suffix_dedup.remove_repeats(every).collect()
    assert len(rounds) > 1 if small else not rounds
    for r in got:
        assert (r.n_bytes, sum(x.end - x.start for x in r.runs), len(r.runs), bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert {r.doc_id for r in got} == set(want)
    assert suffix_dedup.remove_repeats(every.limit(0)).collect() == []


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[200:400] = x[200]  # equal vectors: ties
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0] * 15 + [None], 1), (2080, [float("inf")] * 16, 1), (2100, [1.0] * 3, 1), (None, [1.0] * 16, 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in vector_search.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    exact, hit = x.astype(np.float64), 0
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        score = exact @ exact[q]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score[q] = -9
        # a hit is as near as the true neighbour of that rank, so ties count
        last = np.sort(score)[-20]
        hit += sum(s >= last - 1e-12 for _, _, s in found)
    assert hit / (20 * len(got)) >= 0.9
    tied = got[200]
    assert [v for _, v, _ in sorted(tied)] == list(range(201, 221))
    few = vector_search.search(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert vector_search.search(df.limit(0)).collect() == []


def test_vectors_of_the_usual_length(spark):
    rng = np.random.default_rng(3)
    usual = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(1000 + i, rng.normal(size=3).tolist()) for i in range(3000)], "vec_id long, embedding array<float>")
    h = F.xxhash64("embedding", "vec_id")
    first = common.saved(odd.orderBy(h).limit(2), "test-odd")  # they hash smallest of all
    assert first.agg(F.max(h)).first()[0] < usual.agg(F.min(h)).first()[0]
    got = vector_search.search(usual.unionByName(first)).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and len(got) == 60 and max(r.vec_id for r in got) < 60


def test_probed_share_falls_as_vectors_grow():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 16))
    shares = []
    for n in (1_000, 16_000):
        x = centres[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, 16))
        lists = round(4 * n**0.5)
        index = vector_search.fit(x[:8_192], lists=lists)
        probes = vector_search.probes_for(index, x[:8_192], 20)
        near, _ = index.assign(x)
        hit = 0
        for i in range(0, n, n // 50):
            score = x @ x[i]
            score[i] = -9e9
            probed = np.argsort(-(index.coarse @ x[i]))[:probes]
            hit += np.isin(near[np.argsort(-score)[:20]], probed).sum()
        assert hit >= 0.93 * 50 * 20
        shares.append(probes / lists)
    assert shares[1] < shares[0] / 2


def test_blocks_are_bounded():
    sizes = [5, 0, 30, 4, 4, 4, 9, 1]
    of = vector_search.blocks_of(sizes, 10)
    held = {}
    for n, (first, many) in zip(sizes, of, strict=True):
        for k in range(many):
            held[first + k] = held.get(first + k, 0) + -(-n // many)
    assert max(held.values()) <= 10 and of[2][1] == 3 and sum(held.values()) == sum(sizes)


def test_vectors_in_small_blocks_and_parts(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.search(df, query_step=7, k=5, block=50, part=10, rerank=20).collect()
    hit = 0
    for q in range(0, 600, 7):
        score = x @ x[q]
        score[q] = -9e9
        hit += len(set(np.argsort(-score)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 5 * len(range(0, 600, 7))


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**5)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 20, 35, 50, 8, 4])] + [(90, None), (91, ""), (None, "no id at all here"), (3, None)]
    filler = lambda n: " ".join(word() for _ in range(n))
    changed = items[3][1].split()
    changed[25] = "other"
    rows = [(1, f"{filler(30)} {items[0][1].upper()}, {filler(9)}"), (2, items[2][1]), (3, filler(500)), (4, f"{filler(5)} {' '.join(changed)}"), (5, None), (6, ""), (7, f"{items[4][1]} {items[5][1]}"), (8, filler(3) + " " + items[1][1] + " " + filler(20_000) + " " + items[1][1])]
    rows += [(9, " ".join(items[3][1].split()[:20]))]  # less than three quarters of an item
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_contamination(df, bench).collect()}
    assert {k: v == 1.0 for k, v in got.items()} == {(1, 0): True, (2, 2): True, (4, 3): False, (7, 4): True, (7, 5): True, (8, 1): True}
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(df, bench).collect()) == [3, 5, 6, 9]
    assert decontaminate.without_contaminated(df, bench).columns == df.columns
    assert decontaminate.find_contamination(df, bench.limit(0)).collect() == [] == decontaminate.find_contamination(df.limit(0), bench).collect()


def test_leaks_shorter_than_an_item(spark):
    item = [f"w{i}" for i in range(50)]
    part = lambda a, b: " ".join(item[a:b])
    # 50 words are 46 shingles, of which 35 are three quarters
    rows = [(1, part(0, 49)), (2, part(1, 50)), (3, part(0, 39)), (4, part(11, 50)), (5, part(0, 38)), (6, part(0, 4)), (7, "w0"), (8, part(0, 50)), (9, "a b c"), (10, part(2, 40) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "a b c d")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == {(1, 0, 45 / 46, 0, 49), (2, 0, 45 / 46, 0, 49), (3, 0, 35 / 46, 0, 39), (4, 0, 35 / 46, 0, 39), (8, 0, 1.0, 0, 50)}
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(df, bench).collect()) == [5, 6, 7, 9, 10]


def test_leaks_against_every_window(spark, sf_dir):
    """The query's pairs are those that comparing every window with every item of its size gives."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
    sought = {i: (len(words(t)), Counter(grams(words(t)))) for i, t in items.items() if words(t)}
    want = {}
    for d, t in texts.items():
        w = words(t)
        every = grams(w) if w else []
        for i, (size, counts) in sought.items():
            n = min(size - 4, len(every)) if size >= 5 else 1
            hits = [k for k, x in enumerate(every) if x in counts]
            for start in {s for k in hits for s in range(max(0, k - n + 1), min(k, len(every) - n) + 1)}:
                own = Counter(every[start : start + n])
                both = sum((own & counts).values())
                score = both / (sum(own.values()) + sum(counts.values()) - both)
                if score >= 0.75:
                    want[d, i] = max(want.get((d, i), 0), score)
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op7_decontaminate(spark, sf_dir).collect()}
    assert got == pytest.approx(want) and len(want) >= 3


def test_leaks_in_small_groups(spark, monkeypatch, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {tuple(r) for r in decontaminate.find_contamination(d, b).collect()}
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 2048)
    assert len(decontaminate._item_groups(spark, b)) > 1
    assert {tuple(r) for r in decontaminate.find_contamination(d, b).collect()} == want


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    own = decontaminate.ItemsOfSize(10, list(range(50)), [rng.integers(0, 2**63, 6).astype(np.uint64) for _ in range(50)])
    own.index()
    near = np.concatenate([own.prints ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in (0 + 1, 5, 12, 24, 25, 40)])
    w, i = own.candidates(near)
    apart = np.bitwise_count(near[:, None] ^ own.prints[None])
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)), strict=True))


def test_toxicity_on_unseen_rows(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), queries.toxicity_labels(spark, "/root/testdata/sf0.1")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = toxicity.fit(d, lab.where(~unseen))
    got = toxicity.score(d, chain).join(lab.where(unseen).select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    hit = sum(r.toxic and r.label for r in got)
    assert hit / max(1, sum(r.toxic for r in got)) >= 0.9 and hit / sum(r.label for r in got) >= 0.85
    kept = toxicity.without_toxic(d, chain)
    assert kept.schema == d.schema
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in toxicity.score(d, chain).where("toxic = 0").collect()}


def test_toxicity_cases(spark):
    rows = [(i, ("you idiot " if i % 2 else "kind words ") + f"text{i}", "clash") for i in range(60)] + [(70, None, "x"), (71, "", None), (None, "an idiot", None), (3, "you idiot text3", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (5, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    lab = lab.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(d, lab)
    got = toxicity.score(d, chain)
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"] and got.count() == len(rows)
    assert all(r.toxic == (1 if r.doc_id is None else r.doc_id % 2 if r.doc_id < 60 else 0) for r in got.collect())
    for nothing in (lab.limit(0), lab.where("toxic = 1"), lab.where("doc_id = 999")):
        assert {r.toxic for r in toxicity.score(d, toxicity.fit(d, nothing)).collect()} == {0}
    assert toxicity.score(d.limit(0), chain).collect() == [] == toxicity.without_toxic(d.limit(0), chain).collect()


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    ids = [np.unique(rng.integers(0, 30, 8)) for _ in range(400)]
    first = np.array([0 in x for x in ids], float)
    labels = np.stack([first, np.zeros(400), first], 1)
    chain = toxicity.fit_chain(("a", "b", "c"), {f"w{i}": i for i in range(30)}, ids, labels, rng.integers(0, 5, 400))
    assert chain.weights[2, 30] > 0.5  # the weight of the first category's probability
    assert ((chain.predict(ids)[:, 2] >= 0.5) == (first > 0)).mean() > 0.98


PAGES = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, ""), (8, "http://c/ü \n", None), (1, "x", "é" * 5), (2, "y", "long " * 300_000), (7, "z", "WARC/1.1\r\n\r\n"), (5, "http://a/", "other"), (None, "q", "no id")]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, archive string")
    got = sorted(warc.archive_pages(pages).collect(), key=lambda r: (r.page_id, r.payload_bytes))
    want = []
    for i, _, h in PAGES:
        if i is not None:
            b = (h or "").encode()
            first = min(j for j, _, x in PAGES if j is not None and (x or "") == (h or ""))
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    assert [tuple(r)[:5] for r in got] == sorted(want, key=lambda x: x[:2])
    assert warc.archive_pages(pages.limit(0)).collect() == []
    assert sum(r.record_type == "revisit" for r in warc.archive_pages(pages, least_bytes=4).collect()) == 1


def test_normalised_archives_are_reached_by_their_index(spark, tmp_path):
    import gzip
    import json

    pages = spark.createDataFrame([p for p in PAGES if p[0] is not None], "page_id long, url string, html string").coalesce(1)
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    written = common.saved(warc.write_monolithic(pages, source), "w")
    (whole,) = (tmp_path / "in").glob("*.gz")
    data = whole.read_bytes()
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == 8 and data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == 1
    warc.normalise(written.withColumn("refers_to", F.lit(None).cast("long")), source, target).collect()
    (side,) = (tmp_path / "out").glob("*.index.jsonl")
    rows = [json.loads(x) for x in side.read_text().splitlines()]
    archive = (tmp_path / "out" / side.name.removesuffix(".index.jsonl")).read_bytes()
    assert [gzip.decompress(archive[r["offset"] : r["offset"] + r["length"]]) for r in rows] == [warc.record(h, b) for h, b in ((dict((k, v) for k, v in h.items() if k != "Content-Length"), b) for h, b in warc.RecordReader(iter([gzip.decompress(data)])))]
    assert gzip.decompress(archive) == gzip.decompress(data)

    # reading goes by the index file: records that it doesn't name are not found, and one that names others' places is refused
    names = spark.createDataFrame([(side.name.removesuffix(".index.jsonl"),)] * 2, "archive string")
    assert sorted(r.offset for r in warc.read_archives(names, target).collect()) == [r["offset"] for r in rows]
    side.write_text("".join(json.dumps(r) + "\n" for r in rows[:3]))
    assert [r.page_id for r in warc.read_archives(names, target).collect()] == [r["page_id"] for r in rows[:3]]
    side.write_text(json.dumps(rows[0] | {"page_id": -1}) + "\n")
    with pytest.raises(Exception, match="where page"):
        warc.read_archives(names, target).collect()


def test_cut_archives_are_refused():
    data = warc.record({"WARC-Type": "response"}, b"abc")
    for cut in (5, len(data) - 5):
        with pytest.raises(ValueError):
            list(warc.RecordReader(iter([data[:cut]])))
    with pytest.raises(ValueError):
        list(warc.RecordReader(iter([b"HTTP/1.1\r\n\r\n"])))
    assert list(warc.RecordReader(iter([]))) == []


def test_queries_have_the_contract_s_columns(spark, sf_dir):
    want = {
        "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op4_vector_search": ["query_id", "rank", "vec_id", "score"],
        "op5_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op6_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op9_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op10_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    }
    for name, columns in want.items():
        assert set(columns) <= set(queries.queries()[name](spark, sf_dir).columns), name
