"""Near overlap of two tables, descriptives of pairs, the second computation, digests, and baselines that must not leak."""

import hashlib
import random

from pyspark.sql import functions as F

from varipair.operators import counterfactual, descriptives, items, metrics, overlap, recompute, relational
from varipair.operators import rules as R
from varipair.plans import catalog, forms, reports  # noqa: F401


def test_near_overlap(spark):
    base = "alphabet botany chemistry dynamics economy finance geology history islands journal"
    near = base.replace("journal", "kitchen")
    a = [(1, base), (2, near.upper()), (3, "short one"), (4, None), (5, "nothing shared whatsoever")]
    b = [(10, base), (11, base + " extra"), (12, "of the same"), (13, "")]
    side = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = {(r["a_id"], r["b_id"]): round(r["jaccard"], 4) for r in overlap.near_overlap(side(a), side(b), threshold=0.8).collect()}
    # 1 is an exact match of 10 and left out altogether; 2 shares nine of eleven words with 10 and nine of twelve with 11.
    assert got == {(2, 10): 0.8182}
    many = [(k, base) for k in range(100, 109)]
    assert overlap.near_overlap(side([(2, near)]), side(many), threshold=0.8).count() == 0  # no rare word
    assert overlap.near_overlap(side([]), side(b)).count() == 0


def test_near_overlap_finds_pairs_without_a_rare_word(spark, tmp_path):
    """All words stand in more than eight texts, or are short; copies and near copies on both sides."""
    base = [f"word{k}" for k in range(20)]
    text = lambda k: " ".join([*base[: k % 20], *base[k % 20 + 1 :]] if k % 3 else base)
    docs = [(k, text(k)) for k in range(60)] + [(100, "a bc de f g h i"), (101, "a bc de f g h"), (102, None), (103, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: frozenset((t or "").split()) for i, t in docs}
    of_b = {t for i, t in docs if i % 2}
    alike = {(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i, t in docs for j in sets if t and t not in of_b and i % 2 == 0 and j % 2 and sets[j]}
    want = sorted(p for p in alike if p[2] >= 0.85)
    assert len(want) > 100 and (100, 101, 6 / 7) in want
    assert sorted(map(tuple, catalog.QUERIES["near_overlap"](spark, str(tmp_path)).collect())) == want


def test_near_overlap_of_all_pairs(spark, monkeypatch):
    """Against brute force: sets of all sizes, equal sets of other texts, repeated rows and ids, with few and many words held as frequent."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(90):
        w = draw.sample(words, draw.choice([1, 2, 6, 20, 36])) + draw.choice([[], [f"only{k}"]])
        rows += [(k // 2, " ".join(w)), (k, " ".join([*w[1:], draw.choice(words)])), (k, " ".join(reversed(w)))]
    rows += [*rows[:6], (500, None), (501, "!"), (None, rows[0][1])]
    of_x = [draw.random() < 0.5 for _ in rows]
    x, y = ([r for r, here in zip(rows, of_x, strict=True) if here == z] for z in (True, False))
    side = lambda r: spark.createDataFrame(r, "id long, text string")
    have, key = {t for _, t in y}, lambda r: [(-1 if i is None else i, -1 if j is None else j, s) for i, j, s in r]
    pairs = [(i, j, set(t.split()), set(u.split())) for i, t in x for j, u in y if t and u and t not in have and "!" not in (t, u)]
    for frequent, threshold in ((1, 0.85), (7, 0.5), (4096, 0.8), (4096, 1.0)):
        monkeypatch.setattr(overlap, "FREQUENT", frequent)
        want = [(i, j, len(a & b) / len(a | b)) for i, j, a, b in pairs if len(a & b) / len(a | b) >= threshold]
        got = overlap.near_overlap(side(x), side(y), threshold=threshold, rare=None).collect()
        assert want and sorted(key(map(tuple, got))) == sorted(key(want))
    assert overlap.near_overlap(side([]), side(y), rare=None).count() == overlap.near_overlap(side(x), side([]), threshold=2.0, rare=None).count() == 0


def test_contained_phrases_of_all_lengths(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "Two, three!"), (3, None), (4, "four")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "two THREE"), (2, "four"), (3, "one two three four five"), (4, "six seven"), (5, None)], "item_id long, text string")
    assert sorted(map(tuple, overlap.contained_phrases(docs, found).collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (4, 2)]
    assert overlap.contained_phrases(docs, found.limit(0)).count() == 0


PAIR = "perturbation_type string, original_question string, perturbed_question string, original_options string, perturbed_options string, original_answer_letter string, perturbed_answer_raw string, question_text_changed boolean, is_task_inverted boolean"


def test_enrich(spark):
    o = '{"A": "one", "B": "two words"}'
    rows = [("roman_numeral", "what is it", "what is it", o, '{"I": "one", "II": "two words"}', "B", "II", False, False), ("fixed_pos", "q", "q", o, '{"A": "two words", "B": "one"}', "B", "A", False, False), ("fixed_pos", None, "q r", o, "[]", "B", "Z", True, False), ("incorrect", "a b", "a b c", o, o, "B", "['A']", True, True)]
    got = descriptives.enrich(spark.createDataFrame(rows, PAIR)).collect()
    keys = ("orig_word_count", "question_length_diff", "orig_options_avg_wc", "options_length_diff", "orig_answer_position", "pert_answer_position", "answer_position_changed", "raw_answer_token_changed", "answer_format")
    assert [tuple(r[k] for k in keys) for r in got] == [(3, 0, 1.5, 0.0, 1, 1, False, True, "roman_numeral"), (1, 0, 1.5, 0.0, 1, 0, True, True, "letter"), (0, 2, 1.5, None, 1, None, True, True, "letter"), (2, 1, 1.5, 0.0, None, None, None, None, "list_of_letters")]
    assert [r["lexical_similarity"] for r in got[:2]] == [1.0, 1.0]
    t = {r["perturbation_type"]: r for r in descriptives.descriptives(descriptives.enrich(spark.createDataFrame(rows, PAIR))).collect()}
    assert t["fixed_pos"]["answer_position_change_rate"] == 1.0 and t["incorrect"]["answer_position_change_rate"] is None and t["incorrect"]["is_task_inverted"]
    assert (t["fixed_pos"]["share_letter"], t["fixed_pos"]["question_length_diff_words_mean"], t["roman_numeral"]["lexical_similarity_mean"]) == (1.0, 1.0, 1.0)


def test_second_computation(spark):
    s = catalog.scored(spark, "/root/testdata/sf0.001").cache()
    told = metrics.by_condition(items.compared(s))
    assert recompute.differences(s, told).count() == 0
    wrong = told.withColumn("accuracy", F.col("accuracy") + F.when(F.col("condition") == "open", 1e-9).otherwise(0.0)).withColumn("recon", F.when(F.col("condition") != "fixed_pos", F.col("recon")).otherwise(0.5)).where("condition <> 'incorrect'")
    got = {(r["condition"], r["metric"]) for r in recompute.differences(s, wrong).collect()}
    assert {("open", "accuracy"), ("fixed_pos", "recon"), ("incorrect", "n"), ("incorrect", "accuracy")} <= got and ("open", "n") not in got
    broken = s.withColumn("correct", F.when(F.col("question_id") > 5, F.col("correct")))
    assert ("mcq", "answered") in {(r["condition"], r["metric"]) for r in recompute.differences(broken, metrics.by_condition(items.compared(broken))).collect()}


def test_id_digest_is_a_tree(spark):
    ids = random.Random(1).sample(range(5000), 700)
    df = spark.createDataFrame([("a", i) for i in ids] + [("b", 7), ("b", None)], "g string, id long")
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()

    def tree(keys, width, levels):
        level = {k: str(k) for k in keys}
        for _ in range(levels):
            up = {}
            for k in sorted(level):
                up.setdefault(k // width, []).append(level[k])
            level = {k: sha(v) for k, v in up.items()}
        return sha([level[k] for k in sorted(level)])

    for width, levels in ((1000, 3), (10, 2)):
        got = {r["g"]: (r["n_ids"], r["id_sha256"]) for r in relational.id_digest(df.repartition(4), "g", "id", width, levels).collect()}
        assert got == {"a": (700, tree(ids, width, levels)), "b": (1, tree([7], width, levels))}


def test_bag_of_words_is_tested_on_what_it_has_not_seen(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(["red", "green", "blue"] if k % 2 else ["cat", "dog", "cow"]) for _ in range(8)), float(k % 2), "g") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, text string, label double, grp string")
    assert counterfactual.bag_of_words_accuracy(df.where("k < 200"), df.where("k >= 200")).first()["accuracy"] == 1.0
    noise = df.withColumn("label", F.pmod(F.xxhash64("k"), F.lit(2)).cast("double"))
    assert counterfactual.bag_of_words_accuracy(noise.where("k < 200"), noise.where("k >= 200")).first()["accuracy"] < 0.7


def test_vocabulary_is_that_of_count_vectorizer_and_ties_go_by_name(spark):
    from pyspark.ml.feature import CountVectorizer

    rnd = random.Random(5)
    rows = [(k, [f"t{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(20)] + [f"once{k}"] * 90) for k in range(50)] + [(50, None), (51, [])]
    df = spark.createDataFrame(rows, "_id long, w array<string>")
    got = counterfactual.vocabulary(df.repartition(3), "w")
    want = CountVectorizer(inputCol="w", outputCol="x", minDF=2, vocabSize=5000).fit(df.where("w IS NOT NULL")).vocabulary
    assert sorted(got) == sorted(want) and not any(t.startswith("once") for t in got)
    n = {t: sum(w.count(t) for _, w in rows if w) for t in got}
    assert got == sorted(got, key=lambda t: (-n[t], t)) and counterfactual.vocabulary(df.repartition(5), "w", 7) == got[:7]


def test_responses_alone_give_nothing_away(spark):
    t = spark.createDataFrame([(k, R.RULES[k % 10]["rule_id"], k // 10) for k in range(60)], "template_id long, rule_id string, i int")
    r = counterfactual.response_only(R.vignettes(t, R.rule_table(spark))).first()
    assert (r["n"], r["accuracy"]) == (240, 0.5)


def test_first_phase_parser_reads_no_json(spark):
    from varipair.functions import parsing as P

    raw = ['{"answer": "B"}', "(c).", "A or B", "none", None, "", "b b", "IV"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, s string").orderBy("k")
    got = [tuple(r[0]) for r in df.select(P.parse_first_phase(F.col("s"), P.LETTERS)).collect()]
    assert got == [("B", "ok"), ("C", "ok"), (None, "ambiguous"), (None, "unparseable"), (None, "unparseable"), (None, "unparseable"), ("B", "ok"), (None, "unparseable")]
    assert tuple(df.where("k = 7").select(P.parse_first_phase(F.col("s"), F.array(F.lit("I"), F.lit("IV")))).first()[0]) == ("IV", "ok")


def test_template_diversity(spark):
    rows = [("g", 1, "a 45-year-old man with 3 pills"), ("g", 2, "a 50-year-old man with 4 pills"), ("g", 3, "another text"), ("one", 4, "alone")]
    got = {r["grp"]: r for r in overlap.template_diversity(spark.createDataFrame(rows, "grp string, id int, text string")).collect()}
    assert (got["g"]["n_items"], got["g"]["n_skeletons"], got["g"]["n_pairs"]) == (3, 2, 3)
    assert (got["one"]["n_pairs"], got["one"]["mean_j"], got["one"]["flagged"]) == (0, 0.0, False)


def test_rescues_by_one_aggregation(spark):
    """Repeated and missing keys and null outcomes count as in a join, but no side of one can be broadcast."""
    side = lambda rows: spark.createDataFrame(rows, "k long, correct boolean")
    b = side([(1, False), (1, None), (1, True), (2, True), (3, False), (None, False)])
    m = side([(1, False), (1, False), (2, None), (3, False), (4, True), (None, False)])
    l = side([(1, True), (1, False), (2, False), (3, None), (4, False), (None, True)])
    got = relational.rescues(b, m, l, ["k"])
    j = b.withColumnRenamed("correct", "b").join(m.withColumnRenamed("correct", "m"), "k").join(l.withColumnRenamed("correct", "l"), "k").collect()
    wins = sum(r["b"] is False and r["m"] is False and r["l"] is True for r in j)
    hurts = sum(bool(r["b"] or r["m"]) and r["l"] is False for r in j)
    assert tuple(got.first()) == (len(j), wins, hurts, wins - hurts) == (14, 2, 3, -1)
    assert tuple(relational.rescues(b.limit(0), m, l, ["k"]).first()) == (0, 0, 0, 0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_expanded_rows_are_not_broadcast(spark, tmp_path):
    """Rows that were expanded from a small file look small to Spark, but grow with it."""
    spark.createDataFrame([(k, f"name {k}", "brand", f"type {k % 3}", k % 50, 1.0) for k in range(20)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("examples", "semantic_audit", "audit_summary", "structural_checks", "pairs_built", "unbuildable_questions", "observed_failures", "rescue_hurt_three"):
        assert "Broadcast" not in catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString(), name


def test_near_pairs_against_all_pairs(spark):
    """Bitmaps leave out no pair, also of repeated ids, long texts and null groups; words meet only where bitmaps allow."""
    draw = random.Random(5)
    words = [f"word{k:04d}" for k in range(900)]
    rows = []
    for k in range(40):
        base = draw.sample(words, draw.choice([3, 8, 40, 700])) + [f"seldom{k}"]
        rows += [(draw.choice("gh"), 10 * k, " ".join(base)), (draw.choice("gh"), 10 * k + 1, " ".join([*base[1:], draw.choice(words)])), (None, 10 * k + 2, " ".join(base))]
    rows += [("g", 1, rows[0][2]), ("g", 0, "seldom1 other"), ("g", None, rows[0][2]), ("g", 999, None)]
    sets = [(g, i, frozenset(t.split())) for g, i, t in rows if t]

    def expected(x, y, most, both):
        """Pairs of ids with a rare word in common; of those, all texts of the ids that are alike."""
        count = {}
        for g, _, s in y:
            for w in s:
                count[g if both else 0, w] = count.get((g if both else 0, w), 0) + 1
        found = {(g if both else 0, i, j) for g, i, s in x for h, j, t in y if i is not None and j is not None and (not both or (g is not None and g == h and i < j)) and any(count[g if both else 0, w] <= most and len(w) >= 5 for w in s & t)}
        return sorted((g, i, j, round(len(s & t) / len(s | t), 9)) for g, i, j in found for _, a, s in x if a == i for _, b, t in y if b == j and len(s & t) / len(s | t) >= 0.8)

    frame = spark.createDataFrame(rows, "grp string, id long, text string")
    near = overlap.near_duplicates(frame, threshold=0.8)
    assert sorted((*r[:3], round(r[3], 9)) for r in near.collect()) == expected(sets, sets, 8, True)
    a, b = ([r for r in rows if r[2] and r[1] is not None and r[1] % 2 == k] for k in (0, 1))
    a = [r for r in a if all(r[2] != t for _, _, t in b)]
    a, b = ([(g, i, frozenset(t.split())) for g, i, t in side] for side in (a, b))
    over = overlap.near_overlap(frame.where("id % 2 = 0"), frame.where("id % 2 = 1"), threshold=0.8)
    assert sorted((0, *r[:2], round(r[2], 9)) for r in over.collect()) == expected(a, b, 8, False)
    assert all("bit_count" in f._jdf.queryExecution().executedPlan().toString() for f in (near, over))
