"""Small cases with known results for the core functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from varipair.functions import parsing as P
from varipair.functions import scoring as S
from varipair.functions import text as T
from varipair.operators import counterfactual, graph, items, overlap, splits, stats
from varipair.sources import io


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("  What is X? ", "what is x"), ("Hello, World! (123)", "hello world 123"), ("A/B/C: test\nline", "a b c test line"), (None, "")])
def test_norm_words(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(T.norm_words(F.col("s"))).first()[0] == want


def test_normalisers_differ(spark):
    row = spark.createDataFrame([("A/B  - c",)], "s string").select(T.norm_words(F.col("s")), T.norm_no_punctuation(F.col("s")), T.norm_collapse_first(F.col("s")), T.norm_alphanumeric(F.col("s")), T.norm_case(F.col("s"))).first()
    assert list(row) == ["a b c", "ab c", "ab  c", "ab c", "a/b - c"]


@pytest.mark.parametrize("raw, label, reason", [
    ('{"answer": "B"}', "B", None), ("(c)", "C", None), ("It is D", "D", None), ("A or B", None, "ambiguous: multiple labels ['A', 'B']"), ("none", None, "no valid label found"), ("", None, "empty response"), (None, None, "empty response"),
])
def test_parse_label(spark, raw, label, reason):
    got = spark.createDataFrame([(raw,)], "s string").select(P.parse_label(F.col("s"), P.LETTERS).alias("p")).first()["p"]
    assert (got["label"], got["reason"]) == (label, reason)


def test_roman_labels_longest_first(spark):
    assert spark.createDataFrame([("answer III",)], "s string").select(P.parse_label(F.col("s"), P.ROMAN)["label"]).first()[0] == "III"


def test_label_set_and_free_text(spark):
    df = spark.createDataFrame([('{"answer": ["d", "B", "B"]}',), ('{"answer": ["E"]}',), ('{"answer": "  "}',), ('{"answer": "Amoxicillin"}',)], "s string")
    sets = [r[0]["labels"] for r in df.select(P.parse_label_set(F.col("s"), P.LETTERS)).collect()]
    texts = [r[0]["text"] for r in df.select(P.parse_free_text(F.col("s"))).collect()]
    assert sets[:2] == [["B", "D"], None] and texts == [None, None, None, "Amoxicillin"]


def test_format_reward(spark):
    df = spark.createDataFrame([('{"answer": "A"}',), ('```json\n{"answer": "A"}\n```',), ("prose",), ("",)], "s string")
    assert [r[0] for r in df.select(P.format_reward(F.col("s"))).collect()] == [1.0, 0.8, 0.0, 0.0]


def test_strict_and_literal(spark):
    df = spark.createDataFrame([('{"answer": null}',), ('{"answer": "A"} x',), ("['a', None]",)], "s string")
    assert [r[0]["found"] for r in df.select(P.strict_answer("s")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(P.literal_list("s")).collect()] == [None, None, ["a", "None"]]


@pytest.mark.parametrize("answer, want", [("Vancomycin", (1, "exact")), ("use vancomycin now", (1, "option_in_answer")), ("amoxicillin or vancomycin", (None, "ambiguous_multiple_options_in_answer")), ("nothing", (None, "no_match"))])
def test_match_option(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "s string").select(T.match_option(F.col("s"), F.array(*map(F.lit, ["Amoxicillin", "Vancomycin", "Ciprofloxacin"]))).alias("m"))
    assert tuple(df.first()["m"]) == want


def test_scoring(spark):
    assert one(spark, S.transition(F.lit(True), F.lit(None).cast("boolean")), a=1) == "C->W"
    assert one(spark, S.implied_index(F.array(F.lit(1), F.lit(2), F.lit(3))), a=1) == 0
    assert one(spark, S.reward_symbolic(F.lit("fixed_pos"), F.lit(True), F.lit(False), F.lit(1), F.lit(None).cast("int")), a=1) == 0.25
    assert one(spark, T.oxford_list(F.array(*map(F.lit, "ABC"))), a=1) == "A, B, or C"


def test_mcnemar(spark):
    rows = [(True, False)] + [(False, True)] * 10 + [(True, True)] * 9
    r = stats.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")).first()
    assert (r["a_only"], r["b_only"], r["n"]) == (1, 10, 20) and r["p_value"] < 0.05
    rows = [(True, False)] * 11 + [(False, True)] * 9
    assert abs(stats.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")).first()["p_value"] - 0.823803) < 1e-6
    r = stats.mcnemar(spark.createDataFrame([(True, True)] * 5, "a boolean, b boolean")).first()
    assert r["p_value"] == 1.0 and r["statistic"] == 0.0
    rows = [(True, False)] * 30 + [(False, True)] * 10
    assert abs(stats.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")).first()["p_value"] - math.erfc(math.sqrt(19**2 / 40 / 2))) < 1e-6


def test_failure_labels(spark):
    rows = [
        (1, "mcq", 0, '{"answer": "B"}', False, False, "knowledge_error"),
        (1, "roman_numeral", 0, '{"answer": "II"}', True, True, "provider_api_failure"),
        (1, "fixed_pos", 0, "no idea", False, True, "max_tokens_truncation"),
        (1, "incorrect", 0, "no idea", False, False, "parse_failure"),
        (1, "open", 0, '{"answer": "unsure"}', False, False, "evaluation_ambiguity"),
        (1, "no_symbols", 0, '{"answer": "unsure"}', False, False, "invalid_option"),
        (1, "none_of_the_provided", 0, '{"answer": "B"}', None, None, "required_adaptation_failure"),
        (2, "mcq", 0, '{"answer": "A"}', False, False, None),
        (2, "incorrect", 0, '{"answer": ["B", "C"]}', False, False, "instruction_following_failure"),
        (2, "fixed_pos", 3, '{"answer": "A"}', False, False, "representation_instability"),
        (2, "no_symbols", 0, '{"answer": "alpha or bravo"}', False, False, "invalid_option"),
        (2, "open", 0, '{"answer": "The bravo"}', False, False, "representation_instability"),
        (3, "mcq", 0, "no idea", False, False, "parse_failure"),
        (3, "roman_numeral", 0, '{"answer": "II"}', False, False, "unattributed_error"),
        (3, "incorrect", 0, '{"answer": ["B", "C", "D"]}', False, False, None),
        (4, "no_symbols", 0, '{"answer": "The bravo"}', False, False, "unattributed_error"),
        (1, "extra", 0, '{"answer": "B"}', False, False, "knowledge_error"),
    ]
    df = spark.createDataFrame([(0, *r) for r in rows], "model int, question_id long, condition string, gold int, raw_response string, api_error boolean, truncated boolean, want string")
    got = items.with_failure(items.score(df)).collect()
    assert len(got) == len(rows) and {r["want"] for r in got} - {None} == {r[-1] for r in rows} - {None} and len({r[-1] for r in rows}) == 11
    assert [r for r in got if r["failure"] != r["want"]] == []


def test_failure_taxonomy_has_the_order_of_the_reference(spark):
    import duckdb

    from varipair.plans import catalog

    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    want = con.execute(f"""WITH {catalog.GRID}, f AS (SELECT s.model, CASE WHEN NOT s.parsed THEN 'parse_failure' WHEN NOT s.evaluable THEN 'evaluation_ambiguity'
      WHEN s.condition = 'no_symbols' AND s.sel = 4 THEN 'invalid_option' WHEN s.correct THEN NULL WHEN s.condition = 'mcq' THEN 'knowledge_error'
      WHEN s.condition = 'none_of_the_provided' THEN 'required_adaptation_failure' WHEN NOT m.evaluable THEN 'unattributed_error'
      WHEN m.correct THEN 'representation_instability' ELSE 'knowledge_error' END AS failure
      FROM s JOIN s m ON s.model = m.model AND s.question_id = m.question_id AND m.condition = 'mcq')
      SELECT model, failure, count(*) FROM f WHERE failure IS NOT NULL GROUP BY ALL""").fetchall()
    got = catalog.QUERIES["failure_taxonomy"](spark, "/root/testdata/sf0.001").select("model", "failure", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bootstrap_resamples(spark):
    import numpy as np

    rng, n = np.random.default_rng(7), 101  # prime
    d, w = rng.normal(5, 3, n), rng.integers(1, 6, n).astype(float)
    r = stats.bootstrap(spark.createDataFrame([(k, float(x * y), float(y)) for k, (x, y) in enumerate(zip(d, w, strict=True))], "i long, d double, w double"), "i").first()
    at = rng.integers(0, n, (2000, n))
    m = (d * w)[at].sum(1) / w[at].sum(1)
    lo, hi = np.percentile(m, [2.5, 97.5])
    assert r["replicates"] == 2000 and abs(r["se"] / m.std() - 1) < 0.1 and abs(r["mean"] - m.mean()) < 0.1 * m.std()
    assert abs(r["lo"] - lo) < 0.3 * m.std() and abs(r["hi"] - hi) < 0.3 * m.std()


def test_paired_bootstrap(spark):
    import numpy as np

    cases = {"up": (300, 20, 60), "same": (200, 15, 15), "none": (50, 0, 0)}
    got = {r["scope"]: r for r in stats.paired_bootstrap(spark.createDataFrame([(k, *v) for k, v in cases.items()], "scope string, n long, a_only long, b_only long"), "scope").collect()}
    for k, (n, a, b) in cases.items():
        d = np.r_[np.ones(b), -np.ones(a), np.zeros(n - a - b)]
        r, se = got[k], d.std() / n**0.5
        assert r["replicates"] == 2000 and abs(r["std_error"] - se) <= 0.1 * se
        assert abs(r["ci_lower"] - d.mean() + 1.96 * se) <= 0.3 * se and abs(r["ci_upper"] - d.mean() - 1.96 * se) <= 0.3 * se
        assert r["excludes_zero"] == (k == "up")
    assert got["up"]["p_empirical"] == 1 / 2000 and got["same"]["p_empirical"] > 0.8 and got["none"]["p_empirical"] == 1


def test_comparison_report(spark):
    from collections import defaultdict

    from varipair.plans import catalog

    d = "/root/testdata/sf0.001"
    got = {r["scope"]: r for r in catalog.QUERIES["comparison_report"](spark, d).collect()}
    s = catalog.scored(spark, d, (31, 37))
    rows = {(r["model"], r["question_id"], r["condition"]): r for r in s.collect()}
    how = {(r["model"], r["question_id"], r["condition"]): r["adaptation"] or "" for r in items.pair(s).select("model", "question_id", "condition", "adaptation").collect()}
    want = defaultdict(list)
    for m, q, c in rows:
        if m == 0:
            right = [bool(rows[k, q, c]["correct"]) for k in (0, 1)]
            want[c].append(right)
            if c in ("roman_numeral", "fixed_pos", "no_symbols"):
                want["invariance"].append(right)
            if c in ("none_of_the_provided", "incorrect"):
                want["adaptation_success"].append([how[k, q, c] == "successful_adaptation" for k in (0, 1)])
                want["adaptation_failure"].append([how[k, q, c].startswith("failure") for k in (0, 1)])
    assert got.keys() == want.keys()
    for k, v in want.items():
        r, n = got[k], len(v)
        assert (r["n"], r["a_only"], r["b_only"]) == (n, v.count([True, False]), v.count([False, True])) and r["p_value"] is not None
        assert abs(r["rate_a"] - sum(a for a, _ in v) / n) < 1e-12 and abs(r["delta"] - sum(b - a for a, b in v) / n) < 1e-12
        assert r["ci_lower"] <= r["delta"] <= r["ci_upper"] and (r["relative_reduction_pct"] is not None) == (k == "adaptation_failure")


def test_tie_band_goldens(spark):
    wide = spark.createDataFrame([(1.0, -1.0, 1.0), (1.0, 1.0, 1.0), (0.05, -1.0, 1.0), (-1.0, 1.0, -1.0)], "base double, edited double, near_miss double")
    out = {r["outcome"]: r["n"] for r in counterfactual.cfr(wide, 0.125).collect()}
    assert out == {"flip": 1, "default_dominant": 1, "tie": 1, "both_incorrect": 1}
    assert counterfactual.dfr(wide, 0.125).first()["dfr"] == 0.25


def test_polarity_conflicts_reads_all_rows(spark, tmp_path):
    from varipair.plans import catalog

    rows = [("a", 2, 7), ("a", 3, 9), ("b", 2, 7), ("b", 4, 9), ("c", 5, 1), ("c", 6, 3), ("d", 2, 50), ("d", 4, 49), ("e", 1, 10), ("e", 6, 48)]
    spark.createDataFrame(rows, "p_brand string, p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(r["drug"] for r in catalog.QUERIES["polarity_conflicts"](spark, str(tmp_path)).collect()) == ["a", "c", "e"]


def test_components_and_splits(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    shares = splits.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "stratum string, n long"), 10)
    assert sorted(r["k"] for r in shares.collect()) == [3, 3, 4]


def test_overlap(spark):
    a = spark.createDataFrame([(1, "g", "alpha bravo charlie delta"), (2, "g", "alpha bravo charlie delta"), (3, "g", "other words entirely here")], "id long, grp string, text string")
    assert [tuple(r) for r in overlap.near_duplicates(a).collect()] == [("g", 1, 2, 1.0)]
    docs = spark.createDataFrame([(1, "x alpha bravo charlie delta y"), (2, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Alpha, bravo charlie delta"), (8, "alpha"), (9, "")], "item_id long, text string")
    assert sorted(map(tuple, overlap.contained_phrases(docs, items).collect())) == [(1, 7), (1, 8), (2, 8)]


def test_io_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "hi"')], "x string, y string")
    io.write_csv(df, f"{tmp_path}/c")
    assert io.read_csv(spark, f"{tmp_path}/c", "x string, y string").collect() == df.collect()
    with pytest.raises(Exception, match="secret"):
        io.guard_secrets(df, "y", ["hi"]).collect()
    assert "| x | y |" in io.markdown(df)


def test_streaming_drops_repeats(spark, tmp_path):
    from varipair.streaming import ingest

    rows = spark.createDataFrame([("m", "q", "mcq", "A"), ("m", "q", "mcq", "A"), ("m", "r", "mcq", "B")], "model string, question_id string, condition string, raw_response string").withColumn("ts", F.lit("2026-01-01T00:00:00Z"))
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    q = ingest.into_table(ingest.deduplicated(ingest.read_responses(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


GOLDEN = [
    ("mcq", 0, '{"answer": "A"}', 1, 1), ("mcq", 0, '{"answer": "B"}', 0, 0.5), ("mcq", 0, "invalid text", 0, 0), ("mcq", 0, '{"answer": ["A"]}', 0, 0), ("mcq", 1, '{"answer": "B"} or C', 0, 0),
    ("roman_numeral", 0, '{"answer": "I"}', 1, 1), ("roman_numeral", 0, '{"answer": "II"}', 0, 0.25), ("roman_numeral", 0, '{"answer": "A"}', 0, 0),
    ("fixed_pos", 3, '{"answer": "D"}', 1, 1), ("fixed_pos", 3, '{"answer": "A"}', 0, 0.25),
    ("no_symbols", 0, '{"answer": "alpha"}', 1, 1), ("no_symbols", 0, '{"answer": "bravo"}', 0, 0.25), ("no_symbols", 0, '{"answer": "A"}', 0, 0),
    ("none_of_the_provided", 0, '{"answer": "A"}', 1, 1), ("none_of_the_provided", 0, '{"answer": "B"}', 0, 0),
    ("incorrect", 0, '{"answer": ["B", "C", "D"]}', 1, 1), ("incorrect", 0, '{"answer": ["A", "C", "D"]}', 0, 0.5), ("incorrect", 0, '{"answer": "A"}', 0, 0), ("incorrect", 0, '{"answer": "B, C, D"}', 1, 1),
    ("open", 0, '{"answer": "alpha"}', 0, 0),
]


def test_golden_rewards(spark):
    from varipair.operators import metrics

    df = spark.createDataFrame([(0, i, c, g, raw, float(x), float(y)) for i, (c, g, raw, x, y) in enumerate(GOLDEN)], "model int, question_id long, condition string, gold int, raw_response string, wc double, ws double")
    assert [r for r in metrics.rewards(items.score(df)).collect() if (r["r_correct"], r["r_symbolic"]) != (r["wc"], r["ws"])] == []


def test_golden_parses(spark):
    from varipair.functions import parsing as P

    cases = [
        (None, (None, "empty response"), (None, "empty response"), (None, "empty response"), 0.0),
        (" \n", (None, "empty response"), (None, "empty response"), (None, "empty response"), 0.0),
        ('{"answer": "b."}', ("B", None), (["B"], None), ("b.", None), 1.0),
        ('{"answer": ["A"]}', (None, "answer is list, expected a single label"), (["A"], None), (None, "answer empty or not a string"), 1.0),
        ('{"answer": 3}', (None, "answer is int, expected a single label"), (None, "response not valid JSON answer object"), (None, "answer empty or not a string"), 1.0),
        ('{"answer": null}', (None, "answer is NoneType, expected a single label"), (None, "response not valid JSON answer object"), (None, "answer empty or not a string"), 1.0),
        ('{"answer": "B"} or C', (None, "ambiguous: multiple labels ['B', 'C']"), (None, "response not valid JSON answer object"), (None, "response not valid JSON answer object"), 0.0),
        ("(A)", ("A", None), (None, "response not valid JSON answer object"), (None, "response not valid JSON answer object"), 0.0),
        ("Option D it is", ("D", None), (None, "response not valid JSON answer object"), (None, "response not valid JSON answer object"), 0.0),
        ("none of them", (None, "no valid label found"), (None, "response not valid JSON answer object"), (None, "response not valid JSON answer object"), 0.0),
        ('{"answer": ["d", " A ", "A"]}', (None, "answer is list, expected a single label"), (["A", "D"], None), (None, "answer empty or not a string"), 1.0),
        ('{"answer": ["A", "E"]}', (None, "answer is list, expected a single label"), (None, "invalid labels ['E']"), (None, "answer empty or not a string"), 1.0),
        ('{"answer": []}', (None, "answer is list, expected a single label"), (None, "empty label set"), (None, "answer empty or not a string"), 1.0),
        ('{"answer": "  x "}', (None, "no valid label found"), (None, "empty label set"), ("x", None), 1.0),
        ('{"answer": " "}', (None, "no valid label found"), (None, "empty label set"), (None, "answer empty or not a string"), 1.0),
        ('```json\n{"answer": "C"}\n```', ("C", None), (None, "response not valid JSON answer object"), (None, "response not valid JSON answer object"), 0.8),
        (' {"answer": "C"} ', ("C", None), (["C"], None), ("C", None), 1.0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    raw = F.col("raw")
    for r in df.select("i", P.parse_label(raw, P.LETTERS).alias("l"), P.parse_label_set(raw, P.LETTERS).alias("s"), P.parse_free_text(raw).alias("f"), P.format_reward(raw).alias("r")).collect():
        assert (tuple(r["l"]), tuple(r["s"]), tuple(r["f"]), r["r"]) == cases[r["i"]][1:], cases[r["i"]][0]


def test_golden_matches(spark):
    from varipair.functions import text as T

    cases = [
        ("not aspirin but amoxicillin clavulanate", ["aspirin", "amoxicillin clavulanate", "ibuprofen"], None, "ambiguous_multiple_options_in_answer"),
        ("a long answer that names zinc and also iron in it", ["zinc", "iron"], None, "ambiguous_multiple_options_in_answer"),
        ("X and Y", ["X", "X and Y"], 1, "exact"), ("the X and Y", ["X", "X and Y"], 1, "option_in_answer"),
        ("some very long answer with zinc", ["zinc", "iron"], None, "no_match"), ("chronic kidney", ["chronic kidney disease", "other"], 0, "answer_in_option"),
        ("zinc", ["zinc oxide cream with perfume", "iron"], None, "no_match"), ("Zinc!", ["zinc", "ZINC"], None, "ambiguous_exact"), ("", ["zinc"], None, "no_match"),
    ]
    df = spark.createDataFrame([(i, a, o) for i, (a, o, *_) in enumerate(cases)], "i int, a string, o array<string>")
    for r in df.select("i", T.match_option(F.col("a"), F.col("o")).alias("m")).collect():
        assert tuple(r["m"]) == cases[r["i"]][2:], cases[r["i"]]


def test_golden_mcnemar(spark):
    counts = {"few": (5, 11, 9, 3), "some": (2, 8, 11, 4), "one": (9, 1, 10, 0), "none": (3, 0, 0, 2), "many": (10, 40, 20, 10)}
    rows = [(k, *v) for k, (both, a, b, no) in counts.items() for v in [(True, True)] * both + [(True, False)] * a + [(False, True)] * b + [(False, False)] * no]
    got = {r["k"]: r for r in stats.mcnemar(spark.createDataFrame(rows, "k string, a boolean, b boolean"), "k").collect()}
    assert (got["few"]["p_value"], got["some"]["p_value"]) == (0.823803, 0.647606) and got["few"]["test_type"] == "exact_binomial"
    assert (got["one"]["statistic"], got["none"]["statistic"], got["none"]["p_value"]) == (10.0, 0.0, 1.0) and got["one"]["significant_at_05"] and not got["one"]["significant_at_01"] is None
    assert got["many"]["test_type"] == "mcnemar_continuity_corrected" and (got["many"]["statistic"], got["many"]["p_value"]) == (6.0167, 0.014171)


def test_queries_and_oracles_agree(spark):
    import duckdb

    from varipair.plans import catalog, forms, reports  # noqa: F401

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in catalog.ORACLES:
        df = catalog.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        norm = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        want = con.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.ORACLES[name]})').fetchall()
        assert norm(map(tuple, df.select(*cols).collect())) == norm(want), name


def test_examples_and_audit_of_one_question(spark):
    from varipair.operators import preparation as R

    four = '{"A": "ace", "B": "bat", "C": "cow", "D": "dog"}'
    shown = "(A) ace\n(B) bat"
    rows = [
        ("mcq", "Q?", four, "B", shown), ("roman_numeral", "q", '{"I": "ace", "II": "bat", "III": "cow", "IV": "dog"}', "II", "(I) ace"),
        ("none_of_the_provided", "Q?", four.replace("bat", R.NO_OPTION), "B", shown), ("fixed_pos", "Q?", '{"A": "ace", "B": "cow", "C": "dog", "D": "bat"}', "D", shown),
        ("incorrect", "Q?", four, "['D', 'A', 'C']", shown + "\nName the INCORRECT ones"), ("open", "Which?", four, "bat", "Which?"), ("no_symbols", "Q?", four, "bat", "(A) ace"),
    ]
    src = spark.createDataFrame([("s", "1", *r) for r in rows], "source_dataset string, source_id string, condition string, question string, options string, answer string, prompt string")
    p = R.pairs(src)
    got = {r["perturbation_type"]: r for r in p.collect()}
    assert got["none_of_the_provided"]["perturbed_answer_interpretation"] == R.NO_OPTION and got["incorrect"]["perturbed_answer_interpretation"] is None and got["open"]["question_text_changed"]
    assert R.unpaired(src).count() == 0 and R.unbuildable(p).count() == 0 and R.unpaired(src.where("condition <> 'open'")).count() == 1
    e = R.examples(p)
    at = {r["condition"]: r for r in e.collect()}
    assert len(at) == 7 and at["incorrect"]["gold_indices"] == [0, 2, 3] and at["fixed_pos"]["gold_index"] == 3 and at["no_symbols"]["option_labels"] == []
    problems = {r["condition"]: r["problems"] for r in R.semantic_audit(e).collect()}
    assert problems.pop("no_symbols") == "display observed=labeled expected=bullets" and set(problems.values()) == {""}
    keys = e.select("question_id", "condition")
    assert R.structural_checks(e, keys).count() == 0
    assert [tuple(r) for r in R.structural_checks(e, keys.where("condition <> 'mcq'")).collect()] == [("missing record", "s::1/mcq", "1")]


def test_preparation_of_empty_tables(spark):
    from varipair.operators import phases
    from varipair.operators import preparation as R

    src = spark.createDataFrame([], "source_dataset string, source_id string, condition string, question string, options string, answer string, prompt string")
    e = R.examples(R.pairs(src))
    assert R.semantic_audit(e).count() == 0 and R.structural_checks(e, e).count() == 0
    log = spark.createDataFrame([], "cached boolean, failed boolean, attempts int, cost double")
    assert tuple(phases.run_summary(log).first()) == (0, 0, 0, 0, 0, 0.0)


def test_adaptation_category(spark):
    from varipair.operators import phases

    cases = [(True, True, 0, 1, 1, "successful_adaptation"), (True, True, 0, 0, 1, "failure_to_adapt"), (True, True, 0, 2, 1, "adaptation_attempted_but_wrong"), (False, False, 0, 0, 0, "unparseable"), (False, True, 0, 1, 0, "presentation_instability")]
    df = spark.createDataFrame([c[:5] for c in cases], "required boolean, both boolean, before int, after int, gold int")
    kind = phases.adaptation_category(*map(F.col, ("required", "both", "before", "after", "gold")), F.col("before") == F.col("gold"), F.col("after") == F.col("gold"))
    assert [r[0] for r in df.select(kind).collect()] == [c[5] for c in cases]
