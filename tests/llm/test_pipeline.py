import random

from llm.conftest import EDGES, prose

import corpus_pipeline


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "redact", "packed"]


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(6)
    bench = [prose(rnd, 40) for _ in range(5)]
    texts, kind = [], []
    for k in range(520):
        words = prose(rnd, rnd.randint(60, 150)).split()
        what = rnd.choice(["good"] * 5 + ["toxic", "toxic", "copy", "leak", "secret"])
        if what == "toxic":
            for _ in range(5):
                words[rnd.randrange(len(words))] = rnd.choice(("vile", "awful"))
        if what == "leak":
            words += rnd.choice(bench).split()
        if what == "secret":
            words.insert(9, "password=hunter2222")
        if what == "copy":
            base = rnd.choice([j for j, x in enumerate(kind) if x == "good"] or [0]) if kind else 0
            words = texts[base].split() if texts else words
            if len(words) > 60:
                words[rnd.randrange(len(words))] = "changed"
            what = "copy" if texts else "good"
        texts.append(" ".join(words))
        kind.append(what)
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(x == "toxic")) for k, x in enumerate(kind) if k % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packed":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    of = lambda x: {k for k, y in enumerate(kind) if y == x}
    assert not seen["quality"] & of("toxic") and len(seen["quality"] & of("good")) >= 0.97 * len(of("good"))
    assert not seen["near_copies"] & of("copy") and seen["near_copies"] >= seen["quality"] & of("good")
    assert not seen["decontaminate"] & of("leak") and seen["decontaminate"] >= seen["near_copies"] - of("leak")
    assert seen["redact"] == seen["decontaminate"] == seen["packed"]
    redacted = spark.read.parquet(f"{tmp_path}/redact")
    assert redacted.where("text LIKE '%hunter2222%'").count() == 0
    assert redacted.where("n_chars <> length(text)").count() == 0
    assert redacted.where("text LIKE '%[secret]%'").count() == len(of("secret") & seen["redact"])
    total = sum(r.length for r in docs.collect())
    assert total == sum(r.doc_tokens for r in docs.where("start = 0").collect())


#: Columns of documents, and others with the names that operators use inside.
MORE = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, tails array<double>, seed string, digest string, text_ string"


def _stage_inputs(spark, path, texts, labelled=()):
    rows = [(k if k % 7 else None, t, None, "s", None if t is None else len(t), 1, None, None, "x", None, "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, MORE).repartition(3)
    spark.createDataFrame([(k, 1, 0) for k in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, prose(random.Random(1), 40)), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_every_stage_takes_messy_rows(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, null ids, clashing columns: no stage fails, loses a clean text or alters one."""
    rnd = random.Random(9)
    own = [prose(rnd, 60) for _ in range(6)]
    long = prose(rnd, 60_000)
    texts = [*own, *EDGES, own[1], own[1], long, "x" * 300_000, "key is password=hunter2222 " + prose(rnd, 20)]
    docs = _stage_inputs(spark, tmp_path, texts, range(1, 6))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = [r.text for r in out.select("text").collect()]
        assert len(kept) <= len(texts) and {*own, long} <= set(kept), name
        if name == "near_copies":
            # Of the ids 1, 13 and null: rows without id are compared with nothing.
            assert kept.count(own[1]) == 2
        if name == "decontaminate":
            assert sorted(map(str, kept)) == sorted(map(str, texts))
        if name == "redact":
            assert sorted(map(str, kept)) == sorted(str(t).replace("password=hunter2222", "[secret]") for t in texts)
    # Repeated and null ids are separate documents for packing.
    packed = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in packed) == len(texts)


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    docs = _stage_inputs(spark, tmp_path, [""]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "packed" or out.columns == docs.columns
