"""The pipeline's stages on a small folder, against plain forms of each."""

from __future__ import annotations

import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_decontaminate import normal
from test_ngram_join import classes


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 200))) for _ in range(60)]
    item = " ".join(word() for _ in range(30))
    near = texts[3].split()
    near[-1] = "changed"
    texts += [texts[3], " ".join(near), f"{texts[5]}\n{item.upper()}.", "", "!!! 12", None, texts[8]]
    pairs = list(enumerate(texts)) + [(len(texts) - 1, texts[8])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    identified = [(i, t) for i, t in pairs if any(c.isalpha() for c in t or "")]
    distinct = dict(identified)
    alone = [i for i, (_, c) in classes(list(distinct.items()), corpus_pipeline.NEAR).items() if i == c]
    clean = [i for i in alone if normal(item).rstrip() not in normal(distinct[i])]

    stage, want = docs, [sorted(i for i, _ in identified), sorted(alone), sorted(clean)]
    for (_, function), ids in zip(corpus_pipeline.STAGES, want):
        stage = function(spark, stage, folder)
        assert stage.columns == docs.columns
        assert sorted(r["doc_id"] for r in stage.collect()) == ids
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {
        i: library.encode(distinct[i], add_bos=True, add_eos=True) for i in clean
    }


def test_an_empty_table_goes_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
