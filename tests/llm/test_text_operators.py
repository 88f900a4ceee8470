import hashlib
import random

import brute
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from laminar.llm import bpe, common, decontamination, html_text, katz, quality_model, quality_rules, sharding, simhash, toxicity, url_filter

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType())])


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["alpha", "beta", "gamma", "delta", "the", "of", "epsilon", "É", "ñu", "x9"]) for _ in range(n)]


def fixture_texts():
    long = words(3000, 1)
    return [
        None, "", "   \n\t ", "One", "ÉCOLE École école", " ".join(words(40, 2)), " ".join(words(40, 2)), " ".join(words(40, 3)) + "\n" + "\n".join(["same line here"] * 4),
        " ".join(long), " ".join(long[:2999] + ["other"]), "a b c d e f g h " * 5, "# $ % & | < > * \r\n\r\n  x", "x y\u00a0z \u2003 w", " ".join(words(25, 4)) + " <|endoftext|> end", "日本語 テキスト 🙂 " * 9,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(fixture_texts())]
    rows += [rows[5], (None, "null id text", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- quality rules


def test_quality_base_matches_plain_version(spark, docs):
    out = quality_rules.judge(docs, labels(spark, [(5, 1, 0), (8, 1, 0), (10, 0, 0)]))
    got = listed(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = sorted(((r["doc_id"], *brute.quality_base(r["text"])) for r in docs.collect()), key=repr)
    assert got == want
    assert all(not r["kept"] for r in out.collect() if r["base_failed"])


def test_quality_without_labels_keeps_by_base_rules_alone(spark, docs, none):
    out = quality_rules.judge(docs, labels(spark, []))
    assert all(r["kept"] == (not r["base_failed"]) for r in out.collect())
    assert quality_rules.judge(none, labels(spark, [])).count() == 0


def test_quality_rejects_what_the_target_never_has(spark):
    good = [(i, " ".join(words(60, i))) for i in range(40)]
    bad = [(100 + i, " ".join(f"%%{w}%%" for w in words(60, 500 + i))) for i in range(40)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.judge(d, labels(spark, [(i, 1, 0) for i in range(0, 40, 2)])).collect()}
    assert all(out[i]["llr"] > out[j]["llr"] for i in range(40) for j in range(100, 140))
    rows = quality_rules.kept_rows(d.withColumn("llr", d.doc_id), labels(spark, [(i, 1, 0) for i in range(0, 40, 2)]))
    assert rows.columns == ["doc_id", "text", "llr"] and {r["doc_id"] for r in rows.collect()} == {i for i, r in out.items() if r["kept"]}


def test_quality_verdict_matches_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    marks = common.table(spark, sf, "labels").select("doc_id", "quality")
    good = {r["doc_id"] for r in marks.where("quality = 1").collect()}
    odd = [(-1, None), (-2, ""), (-3, " ".join(f"%%{w}%%" for w in words(400, 3))), (-4, " ".join(words(50_000, 4))), (-5, "zq " * 30)]
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()] + odd + odd[2:3]
    d = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, llr double, ratios string").repartition(5)
    got = sorted(((r["doc_id"], r["llr"], r["kept"]) for r in quality_rules.judge(d, marks).collect()), key=lambda r: r[0])
    plain = brute.quality_verdicts(rows, good, quality_rules.BUCKETS, quality_rules.PRIOR, quality_rules.THRESHOLD, quality_rules.SLACK)
    want = sorted(((i, *v) for (i, _), v in zip(rows, plain, strict=True)), key=lambda r: r[0])
    assert [(i, k) for i, _, k in got] == [(i, k) for i, _, k in want]
    assert all(abs(x - y) < 1e-4 for (_, x, _), (_, y, _) in zip(got, want, strict=True))
    by_ratio = [k for (i, text), (_, k) in zip(rows, plain, strict=True) if not brute.quality_base(text)[-1]]
    assert True in by_ratio and False in by_ratio


# ---- decontamination


ITEMS = [(1, " ".join(words(12, 7))), (2, "Alpha, BETA! gamma? delta"), (10, " ".join(words(9, 8))), (3, None), (4, "..."), (10, " ".join(words(9, 8)))]


def bench_docs():
    a, b = ITEMS[0][1], ITEMS[2][1]
    shouted = "".join(c.upper() if c.isascii() else c for c in a)
    return [(0, f"zz zz {a} zz {b} q"), (1, f"start {shouted} end. {a}"), (2, "so: alpha-beta gamma delta; and Alpha beta gamma DELTA."), (3, None), (4, ""), (5, " ".join(words(7, 9))), (0, f"zz zz {a} zz {b} q"), (6, f"ÉÀ {a[:-6]} ñ")]


@pytest.mark.parametrize("bound", [decontamination.SET_WINDOWS, 0])
def test_decontamination_matches_plain_version(spark, bound):
    d = spark.createDataFrame(bench_docs(), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.scan(d, b, bound).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert listed(out) == sorted(((i, *brute.decontaminate(t, ITEMS)) for i, t in bench_docs()), key=repr)


def test_decontamination_of_nothing(spark):
    d = spark.createDataFrame(bench_docs(), "doc_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.scan(d, empty).collect()} == {0}
    assert {r["n_hit"] for r in decontamination.scan(d, empty, -1).collect()} == {0}
    assert decontamination.scan(d.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_decontaminated_rows_lose_the_words_of_an_item(spark):
    d = spark.createDataFrame([(i, t, "k") for i, t in bench_docs()], "doc_id long, text string, hits string")
    items = [ITEMS[0], ITEMS[2]]
    out = decontamination.clean_rows(d, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "hits"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 0 not in got and got[1] == "start end" and got[2] == bench_docs()[2][1] and got[3] is None


# ---- BPE


def test_bpe_round_trip_and_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        import numpy as np

        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert listed(bpe.digests(docs)) == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(docs))
    assert listed(back) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)


def test_bpe_long_and_odd_pieces():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(bpe.default_path()), bpe.coder(bpe.vocabulary(bpe.default_path()))
    r = random.Random(3)
    texts = ["a" * 4000, "ab" * 3000, "\n" * 500, "".join(r.choices("abcdefgh", k=5000)), "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000))]
    texts += ["".join(r.choices(["the", "ing", " ", "<|endoftext|>", "'s", "9", "é", "\u0085", "zx"], k=30)) for _ in range(300)]
    for t in texts:
        assert mine.encode(t) == library.encode(t, add_special_tokens=False).ids


# ---- near duplicates


def test_simhash_matches_plain_version(spark, docs):
    got = listed(simhash.near_duplicates(docs))
    rows = [(r["doc_id"], brute.fingerprint(r["text"])) for r in docs.collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute.components(rows), strict=True)), key=repr)
    assert got == want


def test_links_reach_all_within_two_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << x for x in r.sample(range(64), r.randrange(0, 6))) for b in base for _ in range(15)}
    chain = [0]
    for i in range(12):
        chain.append(chain[-1] ^ (0b11 << (2 * i)))
    rows = list(enumerate(prints | set(chain)))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows]
    for radius in (2, 1):
        got = {x["doc_id"]: x["component_id"] for x in simhash.linked(spark.createDataFrame(signed, "doc_id long, fp long"), radius).collect()}
        if radius == 2:
            assert [got[i] for i, _ in rows] == brute.components(rows)
        else:
            assert all((got[i] == got[j]) for i, a in rows for j, b in rows if (a ^ b).bit_count() <= 1)


def test_keep_one_of_each_component(spark, docs, none):
    rows = docs.collect()
    comp = brute.components([(r["doc_id"], brute.fingerprint(r["text"])) for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(set(comp), key=repr)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# ---- sharding


def shard_facts(df):
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for group in by.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    return rows, {k: sum(r["size"] for r in v) for k, v in by.items()}


KD = "doc_id long, text string, lang string, source string"


def kd_rows(n, seed, copies=()):
    """Random texts with metadata; copies: (how many, words) of groups of equal texts."""
    r = random.Random(seed)
    rows = [(i, " ".join(words(min(400, int(r.paretovariate(1.1) * 6)), seed * 10_000 + i)), r.choice(["en", "en", "en", "de", None]), f"src{r.randrange(20)}") for i in range(n)]
    for k, (times, size) in enumerate(copies):
        body = " ".join(words(size, 77 + k))
        rows += [(10_000 * (k + 1) + i, body, r.choice(["en", "fr"]), f"src{r.randrange(20)}") for i in range(times)]
    return rows


@pytest.mark.parametrize(("rows", "depth"), [(kd_rows(500, 1), 2), (kd_rows(300, 2, [(400, 12), (30, 9), (12, 300)]), 4), (kd_rows(3, 4), 2)], ids=["plain", "copies", "tiny"])
def test_shards_equal_a_plain_tree(spark, rows, depth):
    out, _ = shard_facts(sharding.kd_shards(spark.createDataFrame(rows, KD), 2**depth))
    assert {x["doc_id"]: x["shard"] for x in out} == brute.kd_shards(rows, depth)


def test_shards_are_even_and_keep_equal_texts(spark):
    rows = kd_rows(6000, 5, [(280, 40), (60, 80), (25, 100), (400, 20), (5, 300)])
    out, sizes = shard_facts(sharding.kd_shards(spark.createDataFrame(rows, KD), 16))
    assert len(out) == len(rows) and set(sizes) == set(range(16)) and max(sizes.values()) < 1.06 * min(sizes.values())
    shards = {}
    for x in out:
        shards.setdefault((x["text_crc32"], x["size"]), set()).add(x["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_only_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "same text for a third of all rows", "en", "a") for i in range(1500)] + [(5000 + i, " ".join(words(8, i)), "en", "b") for i in range(3000)]
    _, sizes = shard_facts(sharding.kd_shards(spark.createDataFrame(rows, KD), 16))
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_metadata_decides_where_a_text_goes(spark):
    rows = [(i, f"text {i:04}", "de" if i % 2 else "en", "x") for i in range(400)]
    out, _ = shard_facts(sharding.kd_shards(spark.createDataFrame(rows, KD), 2))
    assert all(x["shard"] == 1 - x["doc_id"] % 2 for x in out)


def test_repeated_rows_are_cut_by_row(spark):
    d = spark.createDataFrame([(7, "one row many times", "en", "x")] * 640, KD).repartition(5)
    out, sizes = shard_facts(sharding.kd_shards(d, 16))
    assert len(out) == 640 and len(sizes) == 16 and max(sizes.values()) == min(sizes.values())


def test_shards_of_odd_tables(spark, docs, none):
    assert sharding.kd_shards(none).count() == 0
    out, _ = shard_facts(sharding.kd_shards(docs))
    assert len(out) == docs.count() and {x["law"] for x in out} == {"bytes"}
    assert {x["shard"] for x in sharding.kd_shards(docs, target_bytes=10**9).collect()} == {0}
    clash = docs.selectExpr("doc_id", "text", "size lang", "kept source", "1 w", "2 crc", "3 node", "4 uid", "5 v", "6 slot")
    assert {x["law"] for x in sharding.kd_shards(clash).collect()} == {"bytes"}


# ---- url filter


def test_urls_against_plain_version(spark):
    urls = [None, "", "nope", "http://", "http://a.net", "http://a.net/x", "HTTP://WWW.Example.NET/en/1?q#f", "x://example.net/en", "x://notexample.com/de/", "x://a.example.com/de/1", "x://b.org/fr/?", "x://b.org?fr/", "http://a.net/x", "x://É.NET/", "a\n://b.net/\nq"]
    pages = spark.createDataFrame([Row(page_id=i, url=u, rule="k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, url_filter.rules_table(spark)).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:cut].translate(brute.UPPER), rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, url_filter.rules_table(spark, [])).collect()} == {"allow"}


# ---- html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b<b>c<br>d<p>e", "a\nbc d\ne"),
        ("<article><h1>T</h1><p>One  two\n three&nbsp;&lt;x&gt;</p><form><p>Sign up, now</p></form><div class='ad'>Buy</div><p>Four</p></article><footer>f</footer>", "T\nOne two three <x>\nFour"),
        ("<body><nav>menu</nav><div id=sidebar><p>Side, side, side and more of it for all readers here.</p></div><div class=content><p>Main text, with commas, and enough length to count as prose.</p><p>End.</p></div><div class='comments'><p>I like it, very much, more than other ones, really.</p></div></body>", "Main text, with commas, and enough length to count as prose.\nEnd."),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><p title='a>b'>ok", "yes\nok"),
        ("<p>5 < 6 and 7 > 3", "5 < 6 and 7 > 3"), ("<div>" * 2000 + "deep" + "</div>" * 2000, "deep"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


PROSE = "The council met again, as it does every month, and spoke about the bridge, the school and the price of bread."
OTHER = "Nobody had expected the answer, which came late, but it was clear, short and to the point for once."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # a quote inside an unquoted value is a character like any other
        (f"<p title=o'neil>Hello there, this isn't lost, it's fine</p><p>{PROSE}</p>", f"Hello there, this isn't lost, it's fine\n{PROSE}"),
        # letters that grow when they are lowered, before a script
        ("<p>" + "\u0130" * 60 + f"</p><script>x</SCRIPT><p>{PROSE}</p>", "\u0130" * 60 + f"\n{PROSE}"),
        # deep nesting inside something that is dropped
        (f"<article><p>{PROSE}</p><p>{OTHER}</p></article><nav>" + "<div>" * 450 + "in" + "</div>" * 450 + "Menu text, after all of the nested ones, quite long</nav>", f"{PROSE}\n{OTHER}"),
        # names that hold a word of the list but say something else
        (f"<div class='legal-analysis'><p>{PROSE}</p><p>{OTHER}</p></div>", f"{PROSE}\n{OTHER}"),
        (f"<div class='content has-sidebar overflow-hidden'><p>{PROSE}</p><div id='search-and-rescue'><p>{OTHER}</p></div></div>", f"{PROSE}\n{OTHER}"),
        (f"<article><p>{PROSE}</p><div>Share on <a>X</a> | <a>links</a></div><p>{OTHER}</p></article>", f"{PROSE}\n{OTHER}"),
        (f"<article><p>{PROSE}</p><ul><li><a href=1>One more story</a><li><a href=2>Another</a></ul><p>{OTHER}</p></article>", f"{PROSE}\n{OTHER}"),
        # a form round the whole page
        (f"<form><p>{PROSE}</p><p>{OTHER}</p></form>", f"{PROSE}\n{OTHER}"),
        (f"<article><p>{PROSE}</p><p>{OTHER}</p></article><div class='ad-slot'>{PROSE} {OTHER}</div><div class=comments><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\n{OTHER}"),
        ("<p>" + "<b>" * 30_000 + "deep" + "<li>x" * 5_000, "deep\n" + "\n".join(["x"] * 5_000)),
    ],
)
def test_main_text_of_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_main_text_equals_plain_scoring(spark):
    pages = [r["html"] for r in common.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    got = [html_text.main_text(h) for h in pages]
    assert got == [brute.main_text(h) if h else "" for h in pages]
    assert sum(g != brute.main_text(h, False) for g, h in zip(got, pages, strict=True) if h) > 0.9 * len(pages)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é1</p>", "k"), (1, "u", "<p>é1</p>", "k"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert listed(html_text.extract(pages)) == [(1, "u", "é1", 2), (1, "u", "é1", 2), (None, None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- toxicity


def test_folding():
    for odd in ("1d10t", "IDIOT", "іdіоt", "ｉｄｉｏｔ", "id!idiot"):
        assert " idiot " in toxicity.fold(odd), odd
    assert toxicity.fold("w0rthle55 $cum 4317 a1") == " worthless scum ai "
    assert toxicity.fold(None) == "  "


def test_folding_of_disguises():
    for odd in ("id\u200biot", "id\u00adiot", "i\u0301diot", "𝐢𝐝𝐢𝐨𝐭", "id!ot", "id|ot", "idioooot", "i d i o t", "i.d.i.o.t", "x i-d-i-o-t!", "ÌDÍÓT"):
        assert " idiot " in toxicity.fold(odd), odd
    assert toxicity.fold("well done! ok") == " well done ok "


def test_words_of_any_length_become_entries(spark):
    d, marks = toxic_sample(spark)
    long = "verylongwordofmorethanthirtylettersinall"
    d = d.selectExpr("doc_id", f"replace(replace(text, 'blargh', '笨'), 'zonkers', '{long}') text")
    lexicon = toxicity.fit(d, marks)
    assert " 笨 " in lexicon.weights and any(p.startswith(" verylong") for p in lexicon.weights)


def toxic_sample(spark):
    rows, marks = [], []
    letters = random.Random(9)
    vocabulary = ["".join(letters.choices("abcdefghijklmnopqrst", k=5)) for _ in range(400)]
    for i in range(600):
        w = random.Random(i).choices(vocabulary, k=60)
        bad = i % 3 == 0
        if bad:
            for k in range(3):
                w.insert(7 * k + i % 5, ["blargh", "zonkers", "foozle"][(i + k) % 3])
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)


def test_toxicity_learns_words_and_scores_held_out_rows(spark):
    d, marks = toxic_sample(spark)
    lexicon = toxicity.fit(d, marks)
    assert {" blargh ", " zonkers ", " foozle "} <= set(lexicon.weights)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(d, lexicon, ["doc_id"]).collect()}
    assert all((s >= 0.7) == (i % 3 == 0) for i, s in got.items())
    lexicon.exceptions = [" blargh yes "]
    assert lexicon.features("x blargh yes x")[0] == 0 < lexicon.features("x blargh x")[0]
    kept = toxicity.clean_rows(d.withColumn("score", d.doc_id), lexicon)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 3}


def test_toxicity_counts_copies_of_a_text_once(spark):
    d, marks = toxic_sample(spark)
    worst = "one blargh two zonkers three foozle " + " ".join(f"{c}filler" for c in "abcdefgh")
    copies = [(1000 + i, worst) for i in range(200)] + [(1000, worst), (1000, "another text of a labelled id")]
    d = d.unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    marks = marks.unionByName(labels(spark, [(1000 + i, 1, 1) for i in range(200)]))
    lexicon = toxicity.fit(d, marks)
    assert {" blargh ", " zonkers ", " foozle "} <= set(lexicon.weights) and not any("filler" in p for p in lexicon.weights)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(d.where("doc_id < 1000"), lexicon, ["doc_id"]).collect()}
    assert all((s >= 0.7) == (i % 3 == 0) for i, s in got.items())
    texts = toxicity.labelled_texts(d, marks)
    sample = [r["text"] for r in toxicity.training(d, texts).where("toxic = 1").collect()]
    assert len(sample) == len(set(sample)) and sample.count(worst) == 1
    assert sorted(r["toxic"] for r in toxicity.training(d, texts, 50).collect()) == [0] * 50 + [1] * 50


def test_toxicity_matches_plain_version(spark):
    d, marks = toxic_sample(spark)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    learned = [i for i in texts if brute.crc_text(i) % 3 != 1]
    sides = [sorted({toxicity.fold(texts[i]) for i in learned if (i % 3 == 0) == bad}) for bad in (True, False)]
    lexicon = toxicity.fit(d, marks, ["blargh zonkers", "foozle"])
    want = brute.toxic_lexicon(*sides, *toxicity.PREFIX, toxicity.PURE, toxicity.VARIED, toxicity.SURE, toxicity.NEARLY)
    assert lexicon.weights.keys() == want.keys() and len(want) >= 3
    assert all(abs(lexicon.weights[p] - w) < 1e-9 for p, w in want.items())
    odd = [None, "", "blargh", "a blargh zonkers b zonkers", "BL\u200bargh, f o o z l e zonkersblargh", "blarghs foozles", "blargh filler " * 20_000]
    rows = [(i, t) for i, t in texts.items()] + [(-k, t) for k, t in enumerate(odd, 1)] + [(-2, "")]
    out = toxicity.scored(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string"), lexicon, ["doc_id"])
    got = sorted((r["doc_id"], r["score"]) for r in out.collect())
    plain = sorted((i, lexicon.score(brute.toxic_features(toxicity.fold(t), lexicon.weights, lexicon.exceptions))) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in plain] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, plain, strict=True))


def test_toxicity_without_labels(spark, docs, none):
    lexicon = toxicity.fit(docs, labels(spark, []))
    assert {r["score"] for r in toxicity.scored(docs, lexicon, ["doc_id"]).collect()} == {0.0}
    assert toxicity.scored(none, lexicon, ["doc_id"]).count() == 0


# ---- quality model


def test_quality_model_separates_and_handles_odd_rows(spark, docs, none):
    good = [(i, " ".join(words(200, i)).capitalize() + ".") for i in range(200)]
    bad = [(200 + i, " ".join(words(100, i)) + " " + " ".join(f"{w}%%%" for w in words(100, i))) for i in range(200)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = labels(spark, [(i, int(i < 200), 0) for i in range(400)])
    model = quality_model.fit(d, marks)
    got = {r["doc_id"]: r["score"] for r in quality_model.scored(d, model, ["doc_id"]).collect()}
    held = [i for i in got if brute.crc_text(i) % 4 == 2]
    assert held and all((got[i] >= 0.7) == (i < 200) for i in held)
    assert all(0 <= r["score"] <= 1 for r in quality_model.scored(docs, model, ["doc_id"]).collect())
    assert quality_model.fit(d, labels(spark, [])) is None
    assert {r["score"] for r in quality_model.scored(docs, None, ["doc_id"]).collect()} == {0.5}
    assert quality_model.scored(none, model, ["doc_id"]).count() == 0


def test_training_takes_whole_texts_and_one_row_a_doc_id(spark):
    long = " ".join(words(60 * 200, 5))
    d = spark.createDataFrame([(1, long), (1, long + " more"), (1, long), (2, "short"), (4, "left out")], "doc_id long, text string")
    rows = quality_model.training(d, labels(spark, [(1, 1, 0), (2, 0, 0), (4, 0, 0)]), 1).collect()
    assert sorted(r["doc_id"] for r in rows if r["quality"] == 1) == [1] and len(rows) == 2
    assert len(quality_model.passages(long)) == 200
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([long]), pa.array([1], pa.int32())], ["doc_id", "text", "quality"])
    assert len(next(quality_model._bags([batch])).column("x")[0].as_py()) == 200 * quality_model.WIDTH * 4
    assert quality_model.training(d, labels(spark, [(1, 1, 0)]), 1, most=1000).count() == 0


def test_attention_scores_equal_plain_loops():
    import math

    import numpy as np

    r = np.random.default_rng(3)
    m = quality_model.Attention(r.normal(size=quality_model.WIDTH), r.uniform(0.5, 2, quality_model.WIDTH))
    x = r.normal(size=(4, quality_model.WIDTH))
    n_h, n_g = len(m.b), len(m.q)
    hidden, raw = [], []
    for row in x:
        z = [(v - a) / b for v, a, b in zip(row, m.mean, m.scale, strict=True)]
        h = [math.tanh(sum(z[i] * m.W[i][j] for i in range(len(z))) + m.b[j]) for j in range(n_h)]
        t = [math.tanh(sum(h[i] * m.V[i][j] for i in range(n_h))) for j in range(n_g)]
        g = [1 / (1 + math.exp(-sum(h[i] * m.U[i][j] for i in range(n_h)))) for j in range(n_g)]
        hidden.append(h)
        raw.append(sum(a * b * q for a, b, q in zip(t, g, m.q, strict=True)))
    a = [math.exp(e) / sum(map(math.exp, raw)) for e in raw]
    z = [sum(a[k] * hidden[k][j] for k in range(4)) for j in range(n_h)]
    assert m.score(x) == pytest.approx(1 / (1 + math.exp(-(sum(u * v for u, v in zip(z, m.c, strict=True)) + m.d[0]))))


def test_repeated_lines_and_words_count_in_their_passage():
    first = [f"w{i}" for i in range(60)]
    x = quality_model.passages(" ".join(first) + "\n" + " ".join(first) + "\nnew line\nnew line\nnew line")
    assert len(x) == 3 and x[0, -2] == 1 and x[1, -2] == 0
    assert x[0, -3] == 0 and x[2, -3] == pytest.approx(2 / 3)


def test_attention_gradient():
    import numpy as np

    r = np.random.default_rng(0)
    m = quality_model.Attention(np.zeros(5), np.ones(5))
    x, bag, y, w = r.normal(size=(9, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        p = m.forward(x, bag, 3)["p"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    g = m.gradient(x, bag, y, w)
    for name in m.names:
        a = getattr(m, name)
        at = tuple(0 for _ in a.shape)
        old = a[at]
        a[at] = old + 1e-6
        up = loss()
        a[at] = old - 1e-6
        down = loss()
        a[at] = old
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-6, name


# ---- language model


def plain_katz(rows):
    import math
    from collections import Counter

    import numpy as np

    toks = [((t or "").encode().lower().split() + ["</s>"]) for _, t in rows]
    held = [brute.crc_text(d) % 5 == 1 for d, _ in rows]
    c, b, starts = Counter(), Counter(), 0
    for w, h in zip(toks, held, strict=True):
        if not h:
            c.update(w)
            b.update(zip(["<s>", *w], w, strict=False))
            starts += 1
    n, v = sum(c.values()), len(c)
    ctx = {**c, "<s>": starts}
    coc = lambda x: [sum(1 for k in x.values() if k == r) for r in range(1, 7)]
    d1, d2 = katz.discounts(np.array(coc(c))), katz.discounts(np.array(coc(b)))
    lost = sum(r * coc(c)[r - 1] * (1 - d1[r - 1]) for r in range(1, 6))
    scale = 1 if lost else n / (n + 0.5)
    p1 = lambda w: (d1[c[w] - 1] if c[w] <= 5 else 1) * c[w] * scale / n if c[w] else (lost / n if lost else 0.5 / (n + 0.5))
    left, mass = Counter(), Counter()
    for (u, w), k in b.items():
        left[u] += k * (1 - d2[k - 1]) if k <= 5 else 0
        mass[u] += p1(w)

    def p(u, w):
        if not ctx.get(u):
            return p1(w)
        total = ctx[u] + (left[u] <= 0)
        if b[u, w]:
            return (d2[b[u, w] - 1] if b[u, w] <= 5 else 1) * b[u, w] / total
        return (left[u] or 1) / total / (1 - mass[u]) * p1(w)

    for u in set(ctx) - {"</s>"}:
        assert abs(sum(p(u, w) for w in c) + p(u, "unknown") - 1) < 1e-9
    out = []
    for (d, _), w, h in zip(rows, toks, held, strict=True):
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((d, h, len(w), sum(c[x] > 0 for x in w), n, base, sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w, strict=False))))
    return out


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_katz_matches_plain_version(spark, docs, block, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "PART_TOKENS", (block, block))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = listed(katz.score(docs)), sorted(plain_katz(rows), key=repr)
    for a, b in zip(sorted(got, key=lambda x: repr(x[:5])), sorted(want, key=lambda x: repr(x[:5])), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-8 and abs(a[6] - b[6]) < 1e-8


def plain_discounts(n):
    """Katz's discounts with expected counts of counts from a log-log line; for tables without gaps."""
    import numpy as np

    slope, at = np.polyfit(np.log(range(1, 7)), np.log(n[:6]), 1)
    e = [None, *(float(np.exp(at + slope * np.log(r))) for r in range(1, 7))]
    rest = 6 * e[6] / e[1]
    return [((r + 1) * e[r + 1] / e[r] / r - rest) / (1 - rest) for r in range(1, 6)]


#: Counts of counts of words and of pairs at sf0.1; groups of copies raise n_5.
COPIED = {
    (200420, 57120, 23804, 13644, 12859, 6775): [0.43, 0.63, 0.72, 0.78, 0.82],
    (1482341, 227973, 46941, 19718, 17404, 6993): [0.23, 0.43, 0.56, 0.63, 0.69],
}


@pytest.mark.parametrize("n", COPIED)
def test_katz_discounts_stay_good_turing_with_copies(n):
    got = katz.discounts(n)
    assert got == pytest.approx(plain_discounts(n), abs=1e-9) and got == pytest.approx(COPIED[n], abs=0.006)


def test_katz_discounts_of_thin_tables():
    # gaps are bridged, and what has no falling line is discounted by a constant
    assert all(0 < d < 1 for n in ([0] * 6, [7, 0, 0, 0, 0, 0], [5, 5, 5, 5, 5, 5], [0, 0, 0, 0, 9, 0], [9, 0, 2, 0, 0, 1], [0, 8, 0, 3, 0, 1]) for d in katz.discounts(n))
    assert katz.discounts([9, 0, 2, 0, 0, 1]) == sorted(katz.discounts([9, 0, 2, 0, 0, 1])) != [(r - 0.95) / r for r in range(1, 6)]
    assert katz.discounts([5] * 6) == pytest.approx([(r - 1 / 3) / r for r in range(1, 6)])


def test_katz_scores_with_groups_of_copies(spark, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(f"w{int(400 * r.random() ** 3)}" if k % 5 else f"v{int(9000 * r.random() ** 2)}" for k in range(60)) for _ in range(150)]
    texts += [t for i in range(40) for t in [" ".join(f"c{i}x{k}" for k in range(30))] * 5]
    rows = [(2 * i, t) for i, t in enumerate(texts)]
    kept = [t for d, t in rows if brute.crc_text(d) % 5 != 1]
    assert len(kept) < len(texts)
    monkeypatch.setattr(katz, "discounts", plain_discounts)
    want = sorted(plain_katz(rows))
    monkeypatch.undo()
    got = sorted(map(tuple, katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-8 and abs(a[6] - b[6]) < 1e-8


def test_katz_of_nothing(spark, none):
    assert katz.score(none).count() == 0


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    key, before = "spark.checkpoint.dir", common.shared_dir(spark)
    if spark.sparkContext.getConf().get(key, None):
        assert before == spark.sparkContext.getConf().get(key).rstrip("/")
        return
    spark.conf.set(key, f"{tmp_path}/shared/")
    try:
        assert common.shared_dir(spark) == f"{tmp_path}/shared"
        t = common.written(spark.range(3), "test-table")
        assert t._written_at.startswith(f"{tmp_path}/shared/test-table-") and t.count() == 3
        common.dropped(t)
        assert not list((tmp_path / "shared").glob("test-table-*"))
    finally:
        spark.conf.unset(key)
    assert common.shared_dir(spark) == before
