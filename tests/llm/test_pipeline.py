"""The pipeline's stages, each against brute force on what its predecessor kept."""

from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import test_jaccard
import test_packing
import test_subdedup
from voxelkeel.llm import quality
from voxelkeel.llm.common import staged
from voxelkeel.llm.subdedup import MIN_WORDS
from voxelkeel.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents and what each stage made of them."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF), name))
    return docs


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])
    assert all(df.count() for df in kept)


def test_quality_drops_what_the_classifier_rejects(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality.judge_quality(kept[0].select("doc_id", "text"), labels).filter("predicted = 1").collect()}
    assert {d for d, _ in pairs(kept[1])} == want
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(truth.get(d) == 0 for d in want) <= 0.2 * sum(q == 0 for q in truth.values())


def test_one_of_each_group_of_near_copies(kept):
    rows = pairs(kept[1])
    want = {d for d, n, c in test_jaccard.brute(rows, 5, 80) if d == c}
    assert sorted(d for d, _ in pairs(kept[2])) == sorted(want)


def test_repeats_are_cut(kept):
    want = {r[0]: r[1] for r in test_subdedup.brute(pairs(kept[2]), MIN_WORDS)}
    got = {r.doc_id: r for r in kept[3].collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mixing_only_repeats(kept):
    before, after = Counter(pairs(kept[3])), Counter(pairs(kept[4]))
    assert before.keys() == after.keys() and all(after[k] >= n for k, n in before.items())


def test_pieces_hold_every_id(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    test_packing.check_pieces(kept[5].collect(), pairs(kept[4]), tokenizer)


def test_run_is_the_stages_and_clears_the_folder(spark, kept):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == kept[5].columns and got.count() == kept[5].count()
    left = {p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before and not p.name.startswith("rdd")}
    assert left == {"packing"}


def test_odd_tables(spark, tmp_path):
    """Null texts and ids, a repeated id, equal rows, further columns; then an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (None, "No id but a good many words in a text of its own."), (7, "Another text under an id that is there already."), (900_003, "Same row."), (900_003, "Same row.")], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True).withColumn("unit", F.lit("given")).withColumn("cut", F.lit(1)).drop("n_chars")
    for name, table in (("odd", rows), ("empty", rows.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            now = staged(function(spark, now, folder), stage)
            assert now.columns == rows.columns
            if name == "odd":
                assert now.filter("unit = 'given' AND cut = 1").count() == now.count() > 100
            else:
                assert now.count() == 0
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (name == "odd")
