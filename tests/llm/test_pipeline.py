"""The pipeline's stages against brute force on sf0.001, each on its own input."""

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    kept, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    kept["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert len(kept["toxicity"]) > 0.7 * len(kept["documents"])
    lines = brute_lines([(r["doc_id"], r["text"]) for r in kept["toxicity"]])
    got = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    for (i, _), (n, gone, left) in lines.items():
        assert (i not in got) == (n > 0 and gone == n)
        if i in got:
            assert got[i] == left
    rows = [(r["doc_id"], r["text"]) for r in kept["line_dedup"]]
    own = {i for i, _, c in map(eval, brute_components(rows, 5, 80, 100)) if c == i}
    assert {r["doc_id"] for r in kept["ngram_jaccard"]} == own
    times = defaultdict(int)
    for r in kept["mixing"]:
        times[r["doc_id"]] += 1
    assert times.keys() <= own and max(times.values()) <= 2
    words = lambda rs: sum(len(r["text"].split()) for r in rs)
    assert words(kept["mixing"]) <= 1.6 * words(kept["ngram_jaccard"])
    pieces = defaultdict(int)
    for r in kept["packing"]:
        pieces[r["sequence_id"]] += r["length"]
        times[r["doc_id"]] -= r["piece"] == 0
    assert max(pieces.values()) <= 2048 and not any(times.values())


COPY = " ".join(f"w{i}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_without_ids_and_repeated_rows(spark):
    rows = [
        (5, COPY, "en", "a", 1), (None, COPY, "en", "a", 1), (None, COPY + " x", "en", "b", 2), (7, COPY, "de", "a", 3), (7, "another text that is clean", "en", "a", 4), (8, "twice", "en", "a", 5), (8, "twice", "de", "a", 5),
        (None, "alone " * 9, "en", "a", 6), (None, "alone " * 9, "en", "a", 6), (9, "", "en", "a", 7), (9, "", "en", "a", 7), (None, None, None, None, None),
    ]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(str, [(5, COPY), (7, "another text that is clean"), (8, "twice"), (None, "alone " * 9), (9, ""), (9, ""), (None, None)]))


def test_repeated_rows_share_what_the_mix_takes(spark):
    rows = [(i, f"text number {i}", "en", "a", i) for i in range(20)] + [(50, "same words here", lang, "b", 1) for lang in ("de", "en", "fr")] + [(50, "same words here", "en", "c", 1), (None, "no id", "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from tidemark.llm import mixing

    decided = defaultdict(int)
    for r in mixing.mix_sources(docs.select("doc_id", "text", "source"), [5, 2, 1]).collect():
        decided[(r["doc_id"], r["source"])] += r["repeats"]
    taken = defaultdict(int)
    each = defaultdict(int)
    for r in corpus_pipeline.mix_by_source(spark, docs, SF).collect():
        taken[(r["doc_id"], r["source"])] += 1
        each[(r["doc_id"], r["source"], r["lang"])] += 1
    assert taken == {k: n for k, n in decided.items() if n}
    shares = [each[(50, "b", lang)] for lang in ("de", "en", "fr")]
    assert max(shares) - min(shares) <= 1


def test_rows_with_nulls_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some text", "en", "a", 9), (2, "", "en", None, 0), (3, "a\nb\nc\nd", "en", "b", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.where(F.col("length") > 0).count() == docs.count() > 0
