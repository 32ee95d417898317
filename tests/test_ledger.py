
from pyspark.sql import functions as F

from quarry.functions import grid as G
from quarry.functions import text as T
from quarry.operators import aggregates as A
from quarry.operators import filters as FL
from quarry.operators import ordering as O
from quarry.operators import windows as W
from quarry.plans import chat as C
from quarry.plans import curate as CU
from quarry.plans import evalgrid as EG
from quarry.plans import perplexity as P
from quarry.plans import results as R


def test_q1_q2_strip_length_code_points(spark):
    df = spark.createDataFrame([("  héllo　",), ("\t\x1c x \x1f",), ("",), (None,)], "s string")
    got = [(r.a, r.n) for r in df.select(T.py_strip("s").alias("a"), F.length(T.py_strip("s")).alias("n")).collect()]
    assert got == [("héllo", 5), ("x", 1), ("", 0), (None, None)]


def test_q3_class_gate_absent_vs_null(spark):
    df = spark.createDataFrame([("a", True, "KEEP"), ("b", True, None), ("c", False, None), ("d", True, "DISCARD")],
                               "id string, has_class boolean, class string")
    assert sorted(r.id for r in FL.class_gate(df).collect()) == ["a", "c"]
    assert FL.class_gate(df, use_class_filter=False).count() == 4
    assert FL.class_gate(df.where("false")).count() == 0  # empty input: zero rows, no error


def test_q4_missing_score_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 3)], "id string, upvotes bigint")
    assert FL.min_score(df, 0).count() == 2
    assert [r.id for r in FL.min_score(df, 1).collect()] == ["b"]


def test_q5_dedup_before_gates(spark):
    rows = [("click", 1, 0, 0, "X", 0, 5), ("error", 2, 0, 0, "X", 4, 5), ("error", 2, 0, 1, "Y", 2, 5)]
    df = spark.createDataFrame(rows, "view string, view_rank int, page bigint, pos bigint, id string, num_comments bigint, score bigint")
    kept = FL.engagement(W.first_seen(df))
    # X first seen in 'click' with no comments: rejected there and never reconsidered in 'error'.
    assert [r.id for r in kept.collect()] == ["Y"]


def test_q6_first_answer_no_fall_through(spark):
    c = spark.createDataFrame([
        (1, 0, "pinned", True), (1, 1, "[deleted]", False), (1, 2, "real answer", False), (1, 3, "later", False),
        (2, 0, "", False), (2, 1, "would be fine", False),
        (3, 0, None, False), (3, 1, "would be fine", False),
    ], "post_id bigint, pos bigint, body string, stickied boolean")
    got = {r.thread_id: r.answer for r in CU.first_answers(c).collect()}
    assert got == {1: "real answer"}  # posts 2 and 3: first eligible body empty/missing -> dropped


def test_q7_target_counts_accepted(spark):
    df = spark.range(10).select(F.lit(1).alias("view_rank"), F.col("id").alias("page"), F.lit(0).alias("pos"))
    assert O.priority_target(df, 3).count() == 3
    assert O.priority_target(df, 30).count() == 10


def test_q8_word_band_inclusive(spark):
    texts = [" ".join(["w"] * n) for n in (5, 6, 50, 51)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted(r.n for r in FL.word_band(df, F.col("t")).select(T.word_count("t").alias("n")).collect()) == [6, 50]


def test_q9_exact_seeded_sample(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"))
    a = [r.k for r in O.sample_exact(df, 10, 42, "k").collect()]
    b = [r.k for r in O.sample_exact(df.repartition(7), 10, 42, "k").collect()]
    assert len(a) == 10 and len(set(a)) == 10 and sorted(a) == sorted(b)
    assert O.sample_exact(df, 1000, 42, "k").count() == 100
    assert sorted(r.k for r in O.sample_exact(df, 10, 7, "k").collect()) != sorted(a)


def test_q10_letter_from_any_word(spark):
    df = spark.createDataFrame([("The answer is B",), ("xyz",), ("  d) yes",), (None,)], "r string")
    assert [r.l for r in df.select(T.choice_letter("r").alias("l")).collect()] == ["A", "", "D", ""]


def test_q10b_do_not_keep_is_keep(spark):
    df = spark.createDataFrame([("do not keep",), ("Discard",), (None,), ("  keep ",)], "r string")
    assert [r.c for r in df.select(T.keep_or_discard("r").alias("c")).collect()] == ["KEEP", "DISCARD", "DISCARD", "KEEP"]


def test_q11_first_target_ties_and_empties(spark):
    df = spark.createDataFrame([
        ("paris is in france", "paris", "france", True),
        ("france then paris", "paris", "france", False),
        ("new york", "new", "new york", False),   # same start: tie is wrong
        ("anything", "", "x", True),             # empty target found at 0
        ("anything", "", "", False),             # both empty: tie
        ("nothing here", "a1", "b2", False),
    ], "g string, t string, f string, want boolean")
    for r in df.select(T.first_target_correct("g", "t", "f").alias("c"), "want").collect():
        assert r.c == r.want


def test_q12_grid_parse_rules(spark):
    cases = [("1,2,3", [[123]]), ("12 3", [[12, 3]]), ("1 2\n3", [[1, 2], [3]]), ("", None), ("no digits", None),
             ("I think:\n\n4 5\n", [[4, 5]]), ("[1, 2]\n[3, 4]", [[1, 2], [3, 4]]), ("99999999999999999999", [[None]])]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    for r in df.select("i", G.parse_grid(F.col("s")).alias("g")).collect():
        got = None if r.g is None else [list(x) for x in r.g]
        assert got == cases[r.i][1]
    exp = spark.createDataFrame([([[123]],)], "e array<array<bigint>>")
    assert exp.select(G.grids_equal(F.lit(None).cast("array<array<bigint>>"), F.col("e")).alias("c")).first().c is False


def test_q13_best_of_k_stops_at_first_success(spark):
    t = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False), (2, 3, False),
                               (3, 1, True), (3, 4, True)], "task int, trial int, correct boolean")
    got = {r.task: (r.solved, r.trials_needed, r.trials_used) for r in A.best_of_k(t, ["task"]).collect()}
    assert got == {1: (True, 2, 2), 2: (False, None, 3), 3: (True, 1, 1)}
    shapes = spark.createDataFrame([([[1, 2, 3], [4]],), ([],)], "g array<array<bigint>>")
    assert [list(r.s) for r in shapes.select(G.grid_shape(F.col("g")).alias("s")).collect()] == [[2, 3], [0, 0]]


def test_q14_first_truthy_zero_is_missing(spark):
    df = spark.createDataFrame([({"acc,none": "0.0", "exact_match,strict-match": "0.5"},), ({"acc,none": "0.0"},),
                                ({"acc_stderr,none": "N/A"},)], "m map<string,string>")
    got = [r.a for r in df.select(R.first_truthy(F.col("m"), R.ACC_KEYS).alias("a")).collect()]
    assert got == ["0.5", None, None]
    se = [r.s for r in df.select(R.first_truthy(F.col("m"), R.STDERR_KEYS).alias("s")).collect()]
    assert se == [None, None, "N/A"]


def test_q14b_first_present_and_default(spark):
    df = spark.createDataFrame([({"acc,none": "0.0", "acc": "0.9"},), ({"f1,none": "1"},)], "m map<string,string>")
    got = [(r.n, r.v) for r in df.select(*[c.alias(a) for c, a in zip(R.first_present(F.col("m"), R.COMPARE_KEYS), "nv")]).collect()]
    assert got == [("acc,none", "0.0"), (None, None)]


def test_q15_first_task_key_order(spark):
    df = spark.createDataFrame([('{"results": {"zeta": {"a": "1"}, "alpha": {"a": "2"}}}',)], "j string")
    parsed = df.select(F.from_json("j", R.RESULT_SCHEMA).alias("d"))
    assert parsed.select(R.first_task(F.col("d.results")).alias("t")).first().t == "zeta"


def test_q16_base_anywhere(spark):
    df = spark.createDataFrame([("my_BASE_lora_n8", "ben"), ("lora_n16", "fif"), ("adapter", "fif")], "n string, f string")
    assert [r.l for r in df.select(T.run_label("n", "f").alias("l")).collect()] == ["base", "fif_n16", "fif_unknown"]


def test_q17_latest_run_wins(spark):
    df = spark.createDataFrame([("t", "base", "2024-01-01 00:00:00", "/a"), ("t", "base", "2024-02-01 00:00:00", "/b"),
                                ("t", "base", "2024-02-01 00:00:00", "/c")], "task string, label string, run_ts string, file string")
    df = df.withColumn("run_ts", F.to_timestamp("run_ts"))
    assert [r.file for r in W.latest_per_label(df, ["task", "label"]).collect()] == ["/c"]


def test_q18_text_order_family_pick(spark):
    names = spark.createDataFrame([("fifth_n8",), ("fifth_n128",), ("base_model",)], "model string")
    got = {r.family: r.model for r in W.pick_per_family(names).collect()}
    assert got == {"base": "base_model", "fifth": "fifth_n128"}
    fallback = spark.createDataFrame([("zz",), ("m2",), ("m1",), ("fifth_x",)], "model string")
    assert sorted(r.model for r in W.pick_per_family(fallback).collect()) == ["fifth_x", "m1", "m2"]


def test_q19_null_keys_join_and_one_key_column(spark):
    s = spark.createDataFrame([(None, "c1", "s1", "p1"), (None, "c2", "s2", "p2")], "Instruction string, Category string, BaseStory string, Final_prompt string")
    c = spark.createDataFrame([(1, None, 3, "x"), (2, None, 5, "y")],
                              "`Instruction Number` int, `Instruction ` string, `Number of Constraints` int, Constraints string")
    out = EG.prompt_constraints(s, c, levels=[3])
    assert out.count() == 2 and out.columns.count("Instruction") == 1


def test_q20_case_kept_zero_total(spark):
    from quarry.plans.text_metrics import diversity_per_text
    df = spark.createDataFrame([(1, "The the THE"), (2, "   ")], "i int, s string")
    got = {r.i: (r.unique_1gram, r.Dist_2, r.total_3gram) for r in diversity_per_text(df, "s", ["i"]).collect()}
    assert got == {1: (3, 1.0, 1), 2: (0, 0.0, 0)}


def test_q21_empty_text_stays_null(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b")], "doc_id int, text string")
    got = {r.doc_id: r.Perplexity for r in P.ngram_perplexity(docs).collect()}
    assert got[2] is None and got[3] is None and got[1] > 0 and got[4] > 0
    # unigram model: tokens a,b,a,b -> N=4, V=2; p(a)=p(b)=(2+1)/6
    assert abs(got[1] - 2.0) < 1e-9 and abs(got[4] - 2.0) < 1e-9
    stats = A.metric_stats(P.ngram_perplexity(docs), "Perplexity", []).first()
    assert stats.n_scored == 2 and stats.n_rows == 4


def test_q22_utc_date(spark):
    df = spark.createDataFrame([(1704067199.5,)], "t double")  # 2023-12-31 23:59:59.5 UTC
    assert df.select(T.epoch_to_date("t").alias("d")).first().d == "2023-12-31"


def test_q23_marker_inside_answer(spark):
    df = spark.createDataFrame([("user\n\nhi\n\nassistant\n\n the assistant said ok ",), ("no marker",)], "s string")
    assert [r.x for r in df.select(T.last_segment("s", "assistant").alias("x")).collect()] == ["said ok", "no marker"]


def test_q25_n_list_or_int(spark):
    df = spark.createDataFrame([("[8]",), ("8",), ("[16, 32]",), (None,), ("[]",)], "n string")
    assert [r.n for r in df.select(R.normalize_n(F.col("n")).alias("n")).collect()] == [8, 8, 16, None, None]


def test_q26_zero_total_accuracy(spark):
    empty = spark.createDataFrame([], "g string, c boolean")
    assert A.accuracy(empty, [], F.col("c")).first().accuracy == 0.0
    df = spark.createDataFrame([("m", True), ("m", None), ("m", False)], "g string, c boolean")
    r = A.accuracy(df, ["g"], F.col("c")).first()
    assert (r.correct, r.total) == (1, 3) and abs(r.accuracy - 1 / 3) < 1e-12


def test_q27_reserved_folders(spark):
    df = spark.createDataFrame([("temp",), ("combined",), ("evaluation",), ("fifth_n8",), ("base_model",)], "model string")
    assert sorted(r.model for r in FL.model_dirs(df).collect()) == ["base_model", "fifth_n8"]
    assert [r.model for r in FL.model_dirs(df, contains="fifth").collect()] == ["fifth_n8"]


def test_tag_prompt_strips_both_sides(spark):
    df = spark.createDataFrame([(" a post ", " a reply\n")], "input string, output string")
    text = df.select(C.tag_prompt().alias("p")).first().p
    assert text.endswith("Post:\na post\n\nReply:\na reply") and "KEEP or DISCARD" in text
    own = df.select(C.tag_prompt(template="[{reply}] to [{post}]?").alias("p")).first().p
    assert own == "[a reply] to [a post]?"


def test_chat_rows_and_render(spark):
    recs = spark.createDataFrame([("r1", "  a question here ", " an answer ", None, False, None)],
                                 "id string, input string, output string, upvotes bigint, has_class boolean, class string")
    row = C.to_chat_rows(recs, "s", True, 0).first()
    assert [(m.role, m.content) for m in row.messages] == [("user", "a question here"), ("assistant", "an answer")]
    text = spark.createDataFrame([row]).select(C.render_chat("messages").alias("t")).first().t
    assert text == "user\n\na question here\n\nassistant\n\nan answer"
