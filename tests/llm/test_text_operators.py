"""SentencePiece, personal data, chat formatting and URL filter on hard cases."""

import array
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalog.llm import chat_format, personal_data, pieces, queries, url_filter

TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n x\ty", "日本語テスト 😀\u0000 </s><s> [INST]", "▁ ▁▁a", "a" * 30_000, "é" * 300 + " " * 40, "word, word; (word) x² m².n", "don't stop... “quoted” —dash", "1,234.56 +1 (234) 567-8901",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, "no id", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, spans int")


def test_pieces_are_the_library_s(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = pieces.encode_documents(docs, queries.piece_model()).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.agrees for r in got)
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = array.array("I", bytes(r.ids)).tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert r.decoded == library.decode(ids)


def test_library_agrees_on_a_whole_table(spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [r.agrees for r in pieces.encode_documents(whole, queries.piece_model()).select("agrees").collect()]
    assert len(got) == whole.count() and all(got)


def test_own_decoder_and_cut_ids(docs):
    v = pieces.MergeVocabulary(open(queries.piece_model(), "rb").read())
    for t in TEXTS:
        ids = v.library.encode(t or "", add_bos=True, add_eos=True)
        assert v.decode(ids) == v.library.decode(ids)
    plain = pieces.encode_documents(docs.limit(0), queries.piece_model(), add_bos=False, add_eos=False)
    assert plain.collect() == []


def test_memory_of_cuts_changes_nothing(monkeypatch):
    v = pieces.MergeVocabulary(open(queries.piece_model(), "rb").read())
    texts = [f"some words {i % 7} and others{i}, again" for i in range(400)]
    want = [v.library.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    assert [array.array("I", x).tolist() for x, _ in pieces._encode(v, texts, False, False)] == want


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """The rules in Python's re."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


HARD = [
    "a@b.com_x@y.com a@b.c@d.e x@y.z. @a.b a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "+1 (234) 567-8901 +1+2 345 678 90 +49.30.1234567 +1-", "😀é a@b.co 日本 10.0.0.1", "1" * 20_000 + " " + "1-" * 5000 + "1", "a" * 20_000 + "@" + "b." * 2000 + "c " + "1." * 9000 + "1", "+" + "(" * 5000, "",
]


def test_base_spans(spark, sf_dir):
    hard = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(HARD)] + [(-99, None)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(hard)
    for r in personal_data.find_spans(docs).collect():
        assert [tuple(s) for s in r.base] == base_spans(r.text or ""), r.doc_id
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_secrets_are_found_and_words_are_not(spark):
    rows = [(i, f'some text token = "{"0123456789abcdef" * 2}{i:08x}" goes on') for i in range(50)] + [(100 + i, "ordinary-words-of-a-text-with-hyphens and ABCDEFGHIJKLMNOPQRSTUVWXYZ") for i in range(50)]
    got = personal_data.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        kinds = [personal_data.KINDS[s.k] for s in r.spans]
        assert kinds == (["secret"] if r.doc_id < 100 else [])
        assert all(r.text[s.start : s.end].startswith("0123") for s in r.spans)


def test_added_spans_against_planted_secrets(spark):
    """Recall and precision of the spans that the method adds, over planted secrets of many forms and things that look like them."""
    r = random.Random(11)
    letters, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    secrets = [lambda: "ghp_" + some(letters, 36), lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "7", lambda: some(hexes, 39) + "7", lambda: "sk-" + some(letters, 30) + "aZ7", lambda: some(hexes, 31) + "9"]
    plain = [
        lambda: "-".join(some("abcdefghij", 6) for _ in range(4)), lambda: some("ABCDEFGHIJ", 24), lambda: "chapter-" + some("abcdefgh", 14) + "-2", lambda: "https://a.org/" + some("abcdef", 9) + "/" + some("abcdef", 8),
        lambda: "in 2024 and 1999", lambda: "vol_" + some("abcdefghij", 18), lambda: "1234 words",
    ]
    cues = ['token = "{}"', "secret: {}", "api key {}", "password={}", "auth {}"]
    rows, planted = [], {}
    for i in range(1500):
        if i % 3 == 0:
            value = r.choice(secrets)()
            text = "some words before " + r.choice(cues).format(value) + " and after"
            planted[i] = (text.index(value), text.index(value) + len(value))
        else:
            text = f"some words {r.choice(plain)()} and {r.choice(plain)()} after"
        rows.append((i, text))
    found = {}
    for row in personal_data.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[row.doc_id] = [(s.start, s.end) for s in row.spans if personal_data.KINDS[s.k] in ("secret", "id")]
    hit = sum(planted[i] in found[i] for i in planted)
    said = sum(map(len, found.values()))
    assert hit >= 0.9 * len(planted) and hit >= 0.9 * said


def test_reliabilities_follow_the_votes():
    counts = {(4, (1, 0, 1)): 900.0, (4, (-1, 0, 0)): 1000.0, (4, (-1, 0, -1)): 500.0, (0, (1, 1, 0)): 100.0}
    prior, reliability = personal_data.estimate(counts)
    assert personal_data.posterior(prior, reliability, 4, (1, 0, 1)) > 0.9 > 0.1 > personal_data.posterior(prior, reliability, 4, (-1, 0, -1))


def test_columns_with_clashing_names_stay(spark):
    names = ["base", "spans", "candidates", "apart", "__base", "__more", "__spans", "__checked", "__apart", "a.b"]
    docs = spark.createDataFrame([(1, "mail a@b.com", *names), (2, None, *names)], ["doc_id", "text", *names])
    got = personal_data.redact(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {(1, "mail [EMAIL]", *names), (2, None, *names)}


def test_redaction(spark):
    rows = [(1, "mail a@b.com now", 9, "x"), (2, None, 0, "x"), (3, "nothing", 7, "x"), (4, "10.0.0.1", 8, None), (5, "", 0, None)]
    out = personal_data.redact(spark.createDataFrame(rows, "doc_id long, text string, base int, spans string"))
    assert out.columns == ["doc_id", "text", "base", "spans"]
    assert {r.doc_id: (r.text, r.base) for r in out.collect()} == {1: ("mail [EMAIL] now", 9), 2: (None, 0), 3: ("nothing", 7), 4: ("[IP]", 8), 5: ("", 0)}
    assert personal_data.redact(spark.createDataFrame([], "doc_id long, text string")).collect() == []


TURNS = [
    (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c\\l[d]<e>"), (1, 3, "assistant", ""), (2, 0, "assistant", None), (3, None, None, "x"), (3, None, None, "x"), (3, 1, "[odd]<sep>", "\\\\b</s>"),
    (None, 0, "user", "no conversation"), (4, 0, "assistant", "😀" * 5000 + "<sep></s>"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_chat(turns)
    for r in formatted.collect():
        assert r.formatted.endswith("</s>")
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert set(back) == {1, 2, 3, 4, None}
    for conv, r in back.items():
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(x.role, x.text) for x in r.turns] == [(t[2] or "", t[3] or "") for t in mine]
        assert r.loss_text == "".join(t[3] or "" for t in mine if t[2] == "assistant")
    one = next(r for r in formatted.collect() if r.conv_id == 1)
    assert one.formatted == "[user]a<sep>b</s>[assistant]c\\\\l\\bd\\d\\le><sep></s>"
    assert chat_format.read_back(chat_format.format_chat(turns.limit(0))).collect() == []


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/12?q#f", "https://example.org/en/2", "http://example.org", "x://net.example.com/de/", "x://notorg/es/", "http://org/", "http://www.cheap-pills.example.com/en/1",
    "http://cheap-pills.example.com", "HTTP://Ünï.com/fr/😀", "http://a/b://c.com/de/", "http://" + "a." * 3000 + "com/de/" + "p" * 20_000, "http://spam-farm.example.org/x",
]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)

    def fits(h, p):
        return host and (host == h or host.endswith("." + h)) and path.startswith(p)

    rules = sorted(((len(h + p), h + p, v) for h, p, v in queries.RULES if fits(h, p)), reverse=True)
    sites = [h + p for h, p, _ in queries.LISTED if fits(h, p)]
    return host, path, rules[0][1] if rules else None, rules[0][2] if rules else "block" if sites else "allow"


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(4, URLS[4], "k"), (None, URLS[5], None)], "page_id long, url string, key string")
    rules, listed = url_filter.entries(spark, queries.RULES), url_filter.entries(spark, queries.LISTED)
    got = url_filter.filter_urls(pages, rules, listed).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(URLS[5 if r.page_id is None else r.page_id])
    assert url_filter.filter_urls(pages.limit(0), rules, listed).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_drops_only_what_is_not_listed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = 3000 * url_filter.BITS_PER_KEY // 512
    probe = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("bloom", url_filter.bloom_filter(keys, blocks).scalar())
    passed = probe.where(url_filter._passes(F.col("bloom"), F.col("key"), blocks)).select("id").collect()
    ids = {r.id for r in passed}
    assert ids.issuperset(range(3000)) and len(ids) < 3000 + 0.05 * 27_000


def test_long_listing_without_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    try:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, "-1")
        listing = spark.range(50_000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
        pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://h7.net/x").otherwise(F.concat(F.lit("http://h"), F.col("id") * 50, F.lit(".net/"))).alias("url"))
        got = url_filter.filter_urls(pages, url_filter.entries(spark, queries.RULES), listing).collect()
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)
    assert len(got) == 3000 and all((r.verdict == "block") == (r.page_id % 3 == 0 or r.page_id * 50 < 50_000) for r in got)


def test_crowded_filter_stays_exact(spark):
    listing = url_filter.entries(spark, [(f"h{i}.net", "/", "block") for i in range(500)])
    pages = spark.createDataFrame([(i, f"http://h{i}.net/x") for i in range(1000)], "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.entries(spark, queries.RULES), listing, max_filter_bytes=64).collect()
    assert all((r.verdict == "block") == (r.page_id < 500) for r in got)
