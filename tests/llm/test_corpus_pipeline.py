import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from laminar.llm import bpe, common, quality_rules, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_stage_against_a_plain_version(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").collect()]
    passage = next(t for _, t in items if len(brute.item_words(t)) >= 12)
    other = next(t for _, t in items if t != passage and len(brute.item_words(t)) >= 12)
    plain = spark.createDataFrame([(9001, f"Before it. {passage} After it, some more words of an ordinary kind that go on.", "en", "x", 1), (9002, f"{passage}\n{other}", "en", "x", 1), (9003, None, "en", "x", None)], docs.schema)
    docs = common.written(docs.unionByName(plain), "test-docs")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "decontamination", "tokens"]

    lexicon = toxicity.fit(docs, labels)
    calm = stages["toxicity"](spark, docs, SF)
    assert calm.columns == docs.columns
    assert rows(calm) == sorted((tuple(r) for r in docs.collect() if lexicon.score(lexicon.features(r["text"])) < 0.7), key=repr)

    calm = common.written(calm, "test-stage")
    verdict = {r["doc_id"]: r for r in quality_rules.judge(calm, labels).collect()}
    good = stages["quality rules"](spark, calm, SF)
    want = [r for r in calm.collect() if not brute.quality_base(r["text"])[-1] and verdict[r["doc_id"]]["kept"]]
    assert rows(good) == sorted(map(tuple, want), key=repr) and want

    good = common.written(good, "test-stage")
    single = stages["near duplicates"](spark, good, SF)
    kept = good.collect()
    component = brute.components([(r["doc_id"], brute.fingerprint(r["text"])) for r in kept])
    assert rows(single) == sorted((tuple(r) for r, c in zip(kept, component, strict=True) if r["doc_id"] == c), key=repr)

    single = common.written(single.unionByName(plain), "test-stage")
    clean = stages["decontamination"](spark, single, SF)
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in single.collect():
        n_words, n_hit, n_items, _, contaminated = brute.decontaminate(r["text"], items)
        assert (r["doc_id"] not in got) == contaminated
        if not contaminated:
            after = brute.decontaminate(got[r["doc_id"]], items)
            assert (got[r["doc_id"]] == r["text"]) if not n_hit else (after[0] == n_words - n_hit)
    assert 9002 not in got and got[9001].startswith("Before it") and passage not in got[9001]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    tokens = {r["doc_id"]: r for r in stages["tokens"](spark, clean, SF).collect()}
    for i, t in got.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tokens[i]["ids"] == ids and tokens[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(out.columns) and 50 < out.count() <= 200


#: Names that the operators use for columns of their own.
CLASHES = ["_row", "_doc", "_h", "_g", "_w", "_at", "_t", "fp", "label", "score", "kept", "llr", "hits", "items", "n_words", "target", "toxic", "quality", "ids", "size", "ratios", "slots", "component_id"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = common.table(spark, SF, "documents")
    item = next(r["text"] for r in common.table(spark, SF, "benchmark").collect() if len(brute.item_words(r["text"])) >= 12)
    plain = [r for r in docs.orderBy("doc_id").limit(40).collect()]
    long = " ".join(f"{r['text']} {i}" for i in range(40) for r in plain[:30] if r["text"])
    assert len(long) > 200_000
    texts = [None, "", " \n\t", "one", long, long, f"Some words before it. {item} And some words after it, of an ordinary kind."]
    rows = [tuple(r) for r in plain] + [tuple(plain[0])] * 3
    rows += [tuple({**plain[1].asDict(), "doc_id": 9000 + i, "text": t}.values()) for i, t in enumerate(texts)]
    rows += [tuple({**plain[1].asDict(), "doc_id": None}.values()), tuple(None for _ in docs.columns)]
    wide = spark.createDataFrame(rows, docs.schema)
    wide = wide.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
    return common.written(wide.repartition(4), "test-odd")


def test_stages_take_odd_rows_and_columns(spark, odd):
    df, count = odd, odd.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, df, SF), "test-stage")
        assert out.columns == odd.columns, name
        left = rows(out)
        assert 0 < len(left) <= count, name
        before = rows(df)
        if name != "decontamination":
            assert not set(left) - set(before), name
            # rows that are alike share their fate, but for the one of a group that stays
            if name != "near duplicates":
                assert all(left.count(r) == before.count(r) for r in left), name
        if name == "near duplicates":
            component = brute.components([(r["doc_id"], brute.fingerprint(r["text"])) for r in df.collect()])
            assert len(left) == len(set(component)), name
        df, count = out, len(left)
    tokens = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert len(tokens) == odd.count() and all(t["n_tokens"] == len(t["ids"]) for t in tokens)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), SF)
    assert out.count() == 0
    assert name == "tokens" or out.columns == odd.columns


def test_stages_without_labels_or_items(spark, odd, tmp_path):
    for t in ("labels", "benchmark"):
        common.table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert rows(stages["toxicity"](spark, odd, str(tmp_path))) == rows(odd)
    want = [tuple(r) for r in odd.collect() if not brute.quality_base(r["text"])[-1]]
    assert rows(stages["quality rules"](spark, odd, str(tmp_path))) == sorted(want, key=repr)
    assert rows(stages["decontamination"](spark, odd, str(tmp_path))) == rows(odd)
