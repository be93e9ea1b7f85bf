"""What the engine decides where behaviour could go either way; each test names its choice."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import normalize, scales
from plumbline.functions import text as tx
from plumbline.operators import calibration, candidates, coverage, evaluation, features, metrics, retrieval, shaping, splits
from plumbline.operators.retrieval import cut_at, packed


def tokens(spark, text):
    return tx.tokens(spark.createDataFrame([("a", text)], "pair_id string, answer string"), ["pair_id"], "answer")


def test_phrases_of_several_words_are_found_despite_blanks_between_tokens(spark):
    got = {r["text"].strip() for r in features.cliche_cover(tokens(spark, "Таким образом, всё верно"), "pair_id").where("in_cliche").collect()}
    assert got == {"Таким", "образом"}


def test_phrases_with_a_folded_letter_are_out_of_reach(spark):
    assert features.cliche_cover(tokens(spark, "на основе проведённого анализа"), "pair_id").where("in_cliche").count() == 0


def test_merging_keeps_the_first_text_and_localizing_cuts_it_anew(spark):
    spans = spark.createDataFrame([("a", 0, 5, "first", 0.5, "doubtful", 1, "mask"), ("a", 5, 9, "next", 0.4, "doubtful", 1, "mask")], shaping.SPAN)
    answers = spark.createDataFrame([("a", "onetwothree")], "pair_id string, answer string")
    assert shaping.merged(spans).first()["text"] == "first" and candidates.localized(spans, answers).first()["text"] == "onetwothr"


def test_single_number_words_are_fewer_than_those_of_runs(spark):
    row = spark.createDataFrame([("тринадцать",)], "t string")
    assert row.select(tx.number_value(F.col("t")), normalize.digits_for_words(F.col("t"))).first()[:] == (None, "13")


def test_superscripts_are_no_numbers(spark):
    assert spark.createDataFrame([("²",)], "t string").select(tx.number_value(F.col("t"))).first()[0] is None


def test_entropy_is_scaled_within_an_answer(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.1), ("b", 0.8)], "pair_id string, entropy double").withColumns({n: F.lit(1.0) for n in ("mass", "mass_norm", "max_sim", "density")})
    got = {(r["pair_id"], r["entropy"]): round(r["risk"], 3) for r in features.combined(rows).collect()}
    assert got == {("a", 0.2): 0.1, ("a", 0.1): 0.05, ("b", 0.8): 0.1}


def test_no_chunk_repeats_the_end_of_the_last_one():
    assert packed([5, 5, 5], 20, 1) == [(0, 3)] and packed([5, 5, 5], 10, 1) == [(0, 2), (1, 3)]


def test_a_long_segment_is_cut_at_the_last_sentence_wherever_it_ends():
    assert cut_at(30, [4, 9], [3, 8, 20], 12, 0)[0] == (0, 9)


def test_spans_are_matched_within_their_pair(spark):
    span = lambda k: spark.createDataFrame([(k, 0, 1)], "k string, first int, last int")
    assert evaluation.index_span_f1(span("a"), span("b"), "k").first()["hit"] == 0 and evaluation.index_span_f1(span("a"), span("a"), "k").first()["hit"] == 1


def test_ranking_is_by_score_then_place(spark):
    rows = spark.createDataFrame([("a", 0, "x y"), ("a", 1, "alpha beta"), ("a", 2, "alpha beta")], "k string, passage int, text string")
    top = retrieval.top_passages(retrieval.bm25(spark.createDataFrame([("a", "alpha beta")], "k string, query string"), rows, "k"), "k", 2)
    assert [(r["passage"], r["rank"]) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_a_fact_told_without_its_whole_subject_is_never_omitted(spark):
    pairs = spark.createDataFrame([("a", "Срок хранения первичных документов отдела составляет 5 лет.", "Срок хранения первичных документов составляет долго.")], "pair_id string, context string, answer string")
    assert coverage.coverage(pairs).first()["status"] == "irrelevant"


def test_orders_come_from_hashes_that_no_setting_changes(spark):
    assert spark.range(1).select(splits.hash_key("42", F.lit("x"))).first()[0].startswith("c425cf7f")


def test_what_cannot_be_calibrated_fails(spark):
    with pytest.raises(ValueError):
        calibration.isotonic(spark.createDataFrame([], "s double, y int"), "s", "y")


def test_halves_of_ranks_go_to_the_even_one(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0)], "k string, v double")
    assert sorted(r["to"] for r in scales.scaled(rows, "k", "v", "to", 0.5).collect()) == pytest.approx([1 / 3, 2 / 3, 1.0, 1.0])


def test_steps_have_upper_bounds_and_old_ones_lower():
    steps = calibration.Steps((0.1, 0.5), (0.0, 1.0))
    assert [steps.at(x) for x in (0.05, 0.1, 0.3, 0.9)] == [0, 0, 1, 1] and [steps.at_lower(x) for x in (0.05, 0.1, 0.3, 0.5)] == [0, 0, 0, 1]


def test_only_labels_of_one_make_an_answer_wrong(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("b", 0)], "k string, l int")
    assert {r["k"]: r["label"] for r in evaluation.answer_labels(rows, "k", "l").collect()} == {"a": 0, "b": 1}


def test_equal_thresholds_take_the_larger(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert metrics.best_threshold(rows, "s", "y", 1.0).first()["threshold"] in (0.9, 0.5)
