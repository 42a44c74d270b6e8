"""Operators on hand-made rows: filters, rules, links, curation, splits, scaling, metrics, vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindmill.functions import scalars
from bindmill.operators import (cascade, curation, dedup, filters, grouping, linking, metrics, models, profiling,
                                sampling, scaling, similarity, splitting, vectors)
from bindmill.queries import learning
from bindmill.schema import matching_columns, nan_to_null, numeric_columns, require_columns
from bindmill.sources import sinks


def values(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


# --- scalars and schema -------------------------------------------------------

def test_scalars(spark):
    df = spark.createDataFrame([("N/A", "1.5", "NaN", "-3", "12", " A ,B,, A")], "a string, b string, c string, d string, e string, f string")
    row = df.select(
        scalars.to_number("a").alias("a"), scalars.to_number("b").alias("b"), scalars.to_number("c").alias("c"),
        scalars.digits_to_int("d").alias("d"), scalars.digits_to_int("e").alias("e"), scalars.split_list("f").alias("f"),
        scalars.coverage(F.lit(1), F.lit(10), F.lit(1), F.lit(20)).alias("g"),
        scalars.coverage(F.lit(1), F.lit(10), F.lit(5), F.lit(4)).alias("h"),
        scalars.p_activity(F.lit(10.0)).alias("p"), scalars.swap_extension(F.lit("x.cif"), "cif", "ent").alias("x"),
        scalars.composite_key("b", F.lit(None), "e").alias("k")).first()
    assert tuple(row[:6]) == (None, 1.5, None, None, 12, ["A", "B"])
    assert row.g == 0.5 and row.h is None and abs(row.p - 8) < 1e-12
    assert row.x == "x.ent" and row.k == "1.5|nan|12"


def test_vector_scalars(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [1, 2], [2, 3])], "a array<double>, b array<double>, s array<int>, t array<int>")
    row = df.select(scalars.dot("a", "b").alias("d"), scalars.l2_norm("a").alias("n"), scalars.cosine("a", "b").alias("c"),
                    scalars.set_tanimoto("s", "t").alias("t")).first()
    assert (row.d, row.n, round(row.c, 6), round(row.t, 6)) == (24.0, 5.0, 0.96, round(1 / 3, 6))


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, float("nan"), "x")], "ESM2_1 int, MolWt double, name string")
    assert nan_to_null(df).first().MolWt is None
    assert numeric_columns(df) == ["ESM2_1", "MolWt"]
    assert matching_columns(df, prefix="ESM2_") == ["ESM2_1"] and matching_columns(df, contains=("Mol",)) == ["MolWt"]
    with pytest.raises(ValueError):
        require_columns(df, ["CANONICAL_SMILES"])


# --- rules --------------------------------------------------------------------

def ligand(code="ABC", name="THING", kind="non-polymer", smiles="C", mw=100.0, rot=1, hd=1, ha=1):
    return (code, name, kind, smiles, mw, rot, hd, ha)


LIGAND = "ligand_id string, name string, ligand_type string, canonical_smiles string, mw double, rot_bonds int, h_donors int, h_acceptors int"


@pytest.mark.parametrize("row, reason", [
    (ligand(), None),
    (ligand("NA"), "listed code"),
    (ligand("AB"), "code length"),
    (ligand(kind=None), "not found"),
    (ligand(name="CATION"), None),
    (ligand(name="SODIUM ION"), "forbidden word"),
    (ligand(kind="buffer thing"), "forbidden word"),
    (ligand(kind="dna linking"), "nucleic acid"),
    (ligand(kind="l-peptide linking"), "linking type"),
    (ligand(kind="d-saccharide"), None),
    (ligand(smiles=None), "no valid structure"),
    (ligand(mw=800.0), None),
    (ligand(mw=800.0, rot=16), "failed criteria"),
    (ligand(mw=None, rot=16), None),
    (ligand(mw=750.0, rot=15, hd=10, ha=15), None),
])
def test_exclusion_cascade(spark, row, reason):
    judged = cascade.exclusion_cascade(spark.createDataFrame([row], LIGAND), cascade.LigandRules())
    assert judged.first().exclude_reason == reason
    assert cascade.kept(judged).count() + cascade.excluded(judged).count() == 1


def test_rule_of_five_counts_missing_as_violation(spark):
    df = spark.createDataFrame([(500.0, 5.0, 5, 10), (501.0, None, 5, 10)], "mw double, logp double, h_donors int, h_acceptors int")
    out = cascade.rule_of_five(df, cascade.RULE_OF_FIVE).orderBy("mw").collect()
    assert [(r.violations, r.drug_like) for r in out] == [(0, True), (2, False)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, None, None), (3, "y", -1.0)], "id int, s string, v double")
    assert values(filters.not_equal_or_missing(df, "s", "x"), "id") == [(2,), (3,)]
    assert values(filters.measure_filter(df, {"s": "x"}, positive="v"), "id") == [(1,)]
    assert values(filters.measure_filter(df, {"s": "y"}, present="v"), "id") == [(3,)]
    assert filters.constant_shares(df, "s", "x").first().n_kept == 1


def test_column_hygiene(spark):
    df = spark.createDataFrame([("a", 1.0, 5, None), ("b", 2.0, 5, 1.0)], "k string, good double, constant int, gap double")
    assert filters.drop_weak_columns(df, ["k", "good", "absent"]).columns == ["k", "good"]
    assert filters.clean_columns(df.limit(1).drop("gap")) == ["good", "constant"]   # one row has no variance


def test_gates(spark):
    df = spark.createDataFrame([("f", 1, True), ("f", 2, False), ("g", 3, True)], "f string, id int, ok boolean")
    assert values(filters.group_gate(df, "f", ~F.col("ok")), "id") == [(3,)]
    gated = filters.ratio_gate(df, "f", ~F.col("ok"), F.col("ok"), 0.5)
    assert values(gated, "f", "share") == [("f", 1.0)]


# --- links and keys -----------------------------------------------------------

def test_fallback_lookup(spark):
    rows = spark.createDataFrame([(1, "k1", "s1"), (2, "none", "s2"), (3, None, "sx"), (4, None, None), (5, "k5", "s1")],
                                 "id int, inchikey string, smiles string")
    table = spark.createDataFrame([("M1", "k1", "s9"), ("M2", "k7", "s2"), ("M3", "k8", "s2"), ("M5", "k5", "s0"), ("M6", "k5", "s3")],
                                  "mol string, key string, text string")
    out = linking.fallback_lookup(rows, table, ("inchikey", "key"), ("smiles", "text"), "mol")
    assert values(out, "id", "mol") == [(1, "M1"), (2, "M2"), (2, "M3"), (3, None), (4, None), (5, "M5"), (5, "M6")]


def test_facts_and_missing_keys(spark):
    rows = spark.createDataFrame([("m", "t", 1), ("m", "t", 1), ("n", None, 2)], "mol string, tgt string, e int")
    facts = spark.createDataFrame([("m", "t", 5.0), ("m", "t", 5.0), ("m", "u", 6.0)], "mol string, tgt string, v double")
    fetched = linking.facts_for_pairs(facts, rows, ["mol", "tgt"])
    assert values(fetched) == [("m", "t", 5.0)]
    joined = linking.attach_facts(rows, fetched, ["mol", "tgt"])
    assert joined.columns == ["mol", "tgt", "e", "v"] and joined.count() == 1
    assert values(linking.missing_keys(rows, facts, "mol", "mol")) == [("n",)]
    assert values(linking.all_null_keys(rows, "mol", "tgt")) == [("n",)]


def test_duplicates_and_holdings(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    flags = grouping.duplicate_flags(df, ["k"], ["id"])
    assert values(flags, "id", "is_duplicate") == [(1, False), (2, True), (3, False), (4, True), (5, False)]
    assert grouping.duplicate_count(df, ["k"]).first()[0] == 2
    held = spark.createDataFrame([("current", "1ABC"), ("removed", "2xyz"), ("removed", "1abc")], "status string, entry string")
    assert dedup.holdings_overlaps(held, "status", "entry", "current").first().n_shared == 1
    with pytest.raises(ValueError):
        dedup.check_holdings(held, "status", "entry", "current")
    assert dedup.check_holdings(held.filter("entry != '1abc'"), "status", "entry", "current").count() == 2


# --- curation -----------------------------------------------------------------

MEASURES = "mol string, seq string, v double, e string, c string, cov double, res double, acc string"
ROLES = curation.CurationRoles("mol", "seq", "v", "e", "c", "cov", "res", "acc", ties=["e", "c", "v"])


def test_curation_reasons_and_ties(spark):
    rows = [
        ("one", "s", 5.0, "e1", "A", 0.9, 2.0, "P"),
        ("same", "s", 6.0, "e1", "A", 0.5, None, "P"), ("same", "s", 6.0, "e2", "A", 0.5, 2.0, "P"),
        ("two", "s", 4.0, "e1", "A", 0.5, 2.0, "P"), ("two", "s", 8.0, "e2", "A", 0.7, 2.0, "P"),
        *[("five", "s", v, f"e{v}", "A", 0.5, 2.0, "P") for v in (5.0, 5.1, 5.2, 5.3, 9.0)],
        ("gone", "s", None, "e1", "A", 0.5, 2.0, "P"),
    ]
    got = {r.mol: r for r in curation.curate(spark.createDataFrame(rows, MEASURES), ROLES, False).collect()}
    assert set(got) == {"one", "same", "two", "five"}
    assert got["one"].z is None and got["one"].z_reason == "identical_or_single_value"
    assert got["same"].e == "e2"                                     # missing resolution comes last
    assert got["two"].v == 8.0 and got["two"].z_reason == "within_range"   # a tie goes to the better coverage
    data = np.array([5.0, 5.1, 5.2, 5.3, 9.0])
    assert got["five"].v == 5.3 and got["five"].z == pytest.approx((5.3 - data.mean()) / data.std())


def test_chain_dedup_changes_the_result(spark):
    rows = [("m", "s", 4.0, "e1", "A", 0.9, 2.0, "P"), ("m", "s", 8.0, "e1", "A", 0.5, 2.0, "P")]
    df = spark.createDataFrame(rows, MEASURES)
    assert curation.curate(df, ROLES, True).first().z is None
    assert curation.curate(df, ROLES, False).first().z is not None


def _random_measures(spark, seed=7, n=4000):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.4                                        # one interaction holds two fifths of the rows
    mol = np.where(hot, 0, rng.integers(1, 60, n))
    seq = np.where(hot, 0, rng.integers(0, 5, n))
    rows = [(f"m{a}", f"s{b}", float(v), f"e{i % 37}", "ABC"[i % 3], float(rng.integers(0, 4)) / 4,
             None if i % 11 == 0 else float(rng.integers(1, 4)), f"p{b}")
            for i, (a, b, v) in enumerate(zip(mol, seq, np.round(rng.normal(6, 1, n), 2)))]
    return spark.createDataFrame(rows, MEASURES)


@pytest.mark.parametrize("chain_dedup", [False, True])
def test_labels_do_not_follow_the_input_order(spark, chain_dedup):
    df = _random_measures(spark)
    shown = ["mol", "seq", "v", "e", "c", F.round("z", 9).alias("z"), "z_reason"]
    other = df.orderBy(F.xxhash64("e", "v")).repartition(5)
    assert values(curation.curate(other, ROLES, chain_dedup), *shown) == values(
        curation.curate(df, ROLES, chain_dedup), *shown)


def test_distance_digits(spark):
    rows = [("m", "s", 6.0, "e2", "A", 0.9, 2.0, "P"), ("m", "s", 7.00004, "e1", "A", 0.9, 2.0, "P")]
    rows.append(("m", "s", 8.0001, "e3", "A", 0.9, 2.0, "P"))
    rows.append(("m", "s", 7.0000, "e0", "A", 0.9, 2.0, "P"))  # nearly as near to the mean as e1
    df = spark.createDataFrame(rows, MEASURES)
    assert curation.curate(df, ROLES, False).first().e == "e1"
    assert curation.curate(df, ROLES, False, distance_digits=3).first().e == "e0"


def test_ranks_are_narrowed(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    monkeypatch.setattr(sampling, "STEP_DIGITS", 1)
    monkeypatch.setattr(sampling, "RANKED_KEYS", 3)
    tokens = sorted(r.t for r in df.select(sampling.token(["k"], 1).alias("t")).collect())
    cuts = sampling.rank_tokens(df, ["k"], 1, lambda n: {"a": 1, "b": n // 2, "c": n, "none": 0, "far": n + 1})
    assert cuts == {"a": tokens[0], "b": tokens[1499], "c": tokens[-1], "none": None, "far": None}
    assert sampling.rank_tokens(df.limit(0), ["k"], 1, lambda n: {"a": n}) == {"a": None}


def test_curation_against_brute_force(spark):
    df = _random_measures(spark, seed=3, n=800)
    pdf = df.toPandas()
    pdf["o1"], pdf["o2"] = -pdf["cov"], pdf["res"].fillna(1e9)
    pdf = pdf.sort_values(["acc", "o1", "o2", "e", "c", "v"], kind="stable")
    first = pdf.drop_duplicates(["mol", "v", "seq"])
    want = {}
    for key, group in first.groupby(["mol", "seq"]):
        if group["v"].nunique() == 1:
            want[key] = (group.iloc[0]["v"], group.iloc[0]["e"], "identical_or_single_value")
        else:
            distance = (group["v"] - group["v"].mean()).abs().round(9)
            row = group.loc[distance.idxmin()]
            want[key] = (row["v"], row["e"], "within_range")
    got = {(r.mol, r.seq): (r.v, r.e, r.z_reason) for r in curation.curate(df, ROLES, False).collect()}
    assert got == want


# --- quantiles, running totals, metrics ----------------------------------------

def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(50, 500)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "g string, v double")
    got = {r.g: r for r in profiling.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.975, 1.0]).collect()}
    assert [got["a"][c] for c in ("q0", "q25", "q50", "q97_5", "q100")] == pytest.approx(
        np.quantile(x, [0, 0.25, 0.5, 0.975, 1]))
    assert got["b"].q50 == 1.0


def test_running_totals(spark):
    rng = np.random.default_rng(2)
    order = rng.permutation(2000)
    df = spark.createDataFrame([("g", int(o), int(w)) for o, w in zip(order, rng.integers(1, 9, 2000))], "g string, o int, w int")
    out = grouping.running_totals(df, ["g"], "o", ["w"]).toPandas().sort_values("o")
    assert (out["w_before"].to_numpy() == np.cumsum(out["w"]) - out["w"]).all()
    assert (out["w_total"] == out["w"].sum()).all()


def _auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_metrics(spark):
    rng = np.random.default_rng(4)
    label, score = rng.integers(0, 2, 600), np.round(rng.random(600), 2)
    rows = [("s", int(a), float(b)) for a, b in zip(label, score)] + [("none", 0, 0.1), ("none", 0, 0.2)]
    got = {r.split: r for r in metrics.evaluate(spark.createDataFrame(rows, "split string, y int, p double"), "split", "y", "p").collect()}
    assert got["s"].auc == pytest.approx(_auc(label, score))
    assert got["s"].mcc == pytest.approx(np.corrcoef(label, score >= 0.5)[0, 1])
    assert got["none"].auc is None and (got["none"].precision, got["none"].recall, got["none"].f1, got["none"].mcc) == (0, 0, 0, 0)


def test_label_cut(spark):
    df = spark.createDataFrame([(6.5,), (6.6,)], "v double")
    row = df.agg(F.sum(scalars.binary_label("v", 6.5)).alias("a"), F.sum(scalars.binary_label("v", 6.5, False)).alias("b")).first()
    assert tuple(row) == (2, 1)


def test_describe_and_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    bins = values(profiling.histogram(df, "v", 5), "bin", "n")
    assert bins == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]          # the last bin is closed
    row = profiling.describe(df, ["v"]).first()
    assert (row["count"], row["mean"], row["q25"], row["q50"], row["max"]) == (11, 5.0, 2.5, 5.0, 10.0)
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert values(profiling.histogram(same, "v", 5), "bin", "n") == [(0, 2)]


# --- samples and splits ---------------------------------------------------------

@pytest.mark.parametrize("n, sizes", [(0, (0, 0)), (1, (1, 0)), (10, (1, 1)), (2744, (275, 275)), (10323, (1033, 1033))])
def test_part_sizes(n, sizes):
    assert splitting.part_sizes(n) == sizes


@pytest.mark.parametrize("n", [0, 1, 10, 2744])
def test_random_parts_have_exact_counts(spark, n):
    out = splitting.random_parts(spark.range(n), ["id"])
    sizes = {r.split: r.n_rows for r in splitting.split_sizes(out).collect()}
    test, val = splitting.part_sizes(n)
    assert (sizes.get("test", 0), sizes.get("val", 0), sum(sizes.values())) == (test, val, n)


def test_six_way_split_is_leakage_free(spark):
    df = spark.createDataFrame([(f"l{i % 83}", f"p{i % 59}") for i in range(83 * 59)], "lig string, prot string").distinct()
    out = splitting.six_way_split(df, "lig", "prot", ["lig", "prot"])
    assert out.count() == 83 * 59 and out.select("lig", "prot").distinct().count() == 83 * 59
    axes = {"pair": scalars.composite_key("lig", "prot"), "ligand": F.col("lig"), "protein": F.col("prot")}
    shared = {(r.axis, r.split): r.n_shared for r in splitting.overlap_report(
        out, axes, "split", ["train", "val", "test"], ["blind", "blind_protein", "blind_ligand"]).collect()}
    assert {k for k, v in shared.items() if v == 0} == {
        ("pair", "blind"), ("pair", "blind_protein"), ("pair", "blind_ligand"), ("ligand", "blind"), ("protein", "blind"),
        ("protein", "blind_protein"), ("ligand", "blind_ligand")}
    blind = out.filter("split = 'blind'")
    assert blind.select("lig").distinct().count() == math.floor(0.15 * 83)
    assert blind.select("prot").distinct().count() == math.floor(0.15 * 59)


def test_sample_depends_on_seed_only(spark):
    df = spark.range(5000)
    a = values(sampling.sampled_keys(df.repartition(13), "id", 0.15, 42))
    assert a == values(sampling.sampled_keys(df.repartition(2), "id", 0.15, 42)) and len(a) == 750
    assert a != values(sampling.sampled_keys(df, "id", 0.15, 43))
    assert dedup.exact_sample(df, "id", 10).count() == 10


def test_scaler(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (200, 2))
    df = spark.createDataFrame([("train" if i < 150 else "test", [float(a), float(b), 4.0]) for i, (a, b) in enumerate(x)],
                               "split string, features array<double>")
    out = scaling.scale_on_train(df).toPandas()
    train = np.array(out[out.split == "train"].features.tolist())
    assert train.mean(axis=0) == pytest.approx([0, 0, 0], abs=1e-9) and train.std(axis=0) == pytest.approx([1, 1, 0])
    mean, std = x[:150].mean(axis=0), x[:150].std(axis=0)
    assert np.array(out.features.tolist())[:, :2] == pytest.approx((x - mean) / std)


def test_features_are_computed_once_per_key(spark):
    def lengths(frames):
        for frame in frames:
            yield frame.assign(n=frame["seq"].str.len())

    df = spark.createDataFrame([(1, "AAA"), (2, "AAA"), (3, "AX"), (4, None)], "id int, seq string")
    out = scaling.attach_per_distinct(df, "seq", lengths, "seq string, n long", skip="X")
    assert values(out, "id", "n") == [(1, 3), (2, 3), (3, None), (4, None)]


# --- vectors --------------------------------------------------------------------

def _vectors(spark, n=120, d=6, seed=6):
    x = np.random.default_rng(seed).normal(size=(n, d)) * np.arange(1, d + 1)
    return x, spark.createDataFrame([(i, i % 3, row.tolist()) for i, row in enumerate(x)], "id int, g int, v array<double>")


def test_pca(spark):
    x, df = _vectors(spark)
    centred = x - x.mean(axis=0)
    singular = np.linalg.svd(centred, compute_uv=False) ** 2
    got = vectors.explained_variance(df, "v", 4).orderBy("pc").toPandas()
    assert got["share"].to_numpy() == pytest.approx(singular[:4] / singular.sum())
    needed = {r.target: r.n_components for r in vectors.components_needed(vectors.explained_variance(df, "v", 2), 2).collect()}
    assert needed[0.95] == 3                                          # two components do not reach it
    scores = vectors.pca_scores(df, "v").toPandas()
    assert scores[["pc1", "pc2"]].mean().to_numpy() == pytest.approx([0, 0], abs=1e-9)


def test_vector_stats(spark):
    x, df = _vectors(spark)
    row = vectors.norm_stats(df, "v").first()
    norms = np.linalg.norm(x, axis=1)
    assert (row.mean_norm, row.std_norm) == pytest.approx((norms.mean(), norms.std()))
    means = {r.g: r.v for r in vectors.mean_vectors(df, "g", "v").collect()}
    assert means[1] == pytest.approx(x[1::3].mean(axis=0))


def test_pair_scores(spark):
    x, df = _vectors(spark, n=300)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.round((unit @ unit.T)[np.triu_indices(300, k=1)], 6)
    row = similarity.pair_summary(similarity.pair_scores(df, "id", "v", 400), (0.5,)).first()
    assert row.n_pairs == len(want) and row.median_score == pytest.approx(np.median(want))
    assert row.ordered_above_50 == 2 * (want > 0.5).sum()


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "A  b c d"), (3, "one"), (4, "other")], "id int, t string")
    prints = similarity.with_fingerprint(df, "t")
    bits = {r.id: set(r.bits) for r in prints.collect()}
    assert bits[1] < bits[2] and len(bits[1]) == 2 and bits[3] == set()
    scores = similarity.pair_scores(prints, "id", "bits", 10, bits=similarity.FINGERPRINT_BITS)
    assert {round(r.score, 3): r.n for r in scores.collect()} == {0.667: 1, 0.0: 4, 1.0: 1}


def test_near_duplicate_vectors_of_a_whole_table(spark, monkeypatch):
    """Recall against the exact self-join of the embeddings at sf0.01 with near and equal copies; every score is exact."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()])
    rng = np.random.default_rng(4)
    near = x[:400].repeat(3, axis=0)
    near = near + rng.normal(size=near.shape) * near.std() * rng.uniform(0.05, 0.4, size=(len(near), 1))
    x = np.concatenate([x, near, x[:50], x[:1].repeat(20, axis=0) + rng.normal(size=(20, 64)) * 0.01])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, [0.0] * 64), (9002, None), (9003, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for tile in (1000, 7):
        monkeypatch.setattr(similarity, "TILE", tile)
        got = similarity.near_duplicate_vectors(df, "id", "v", 0.95).collect()
        want = {(a, b) for a, b in zip(*np.nonzero(np.triu(score, 1) > 0.95))}
        first = {tuple(v): i for i, v in reversed(list(enumerate(x.tolist())))}
        root = [first[tuple(v)] for v in x.tolist()]
        nodes = {(min(root[a], root[b]), max(root[a], root[b])) for a, b in want}
        found = {(r.a, r.b) for r in got}
        assert found <= nodes and len(found) == len(got) and len(found) >= 0.995 * len(nodes) and len(want) > 1000
        assert all(r.score == pytest.approx(score[r.a, r.b], abs=2e-6) for r in got)
        assert sum(r.n_pairs for r in got) >= 0.995 * len(want)


def test_near_duplicate_texts_of_a_whole_table(spark, monkeypatch):
    """Recall against the exact self-join of all documents at sf0.01."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text.lower().split()) for r in df.collect() if r.text and r.text.split()]
    grams = {i: {" ".join(w[k:k + 2]) for k in range(max(1, len(w) - 1))} for i, w in texts}
    ids = sorted(grams)
    want = set()
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            x, y = grams[i], grams[j]
            if min(len(x), len(y)) > 0.8 * max(len(x), len(y)) and (c := len(x & y)) / (len(x) + len(y) - c) > 0.8000005:
                want.add((i, j))
    monkeypatch.setattr(similarity, "TILE", 5)
    got = similarity.near_duplicate_texts(df, "doc_id", "text", 0.8).collect()
    assert len(want) > 10 and sum(r.n_pairs for r in got) >= 0.995 * len(want)
    assert all((r.a, r.b) in want for r in got if r.a != r.b) and sum(r.n_pairs for r in got) <= len(want)
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "one"), (4, "One"), (5, "two"), (None, "one")], "id long, t string")
    assert values(similarity.near_duplicate_texts(odd, "id", "t"), "a", "b", "n_pairs", "score") == [(3, 3, 1, 1.0)]


# --- models ---------------------------------------------------------------------

def test_selection_queries_search_the_whole_ranges(spark, small, monkeypatch):
    """The registered queries search 400 draws from the operators' own ranges; stages are cut short here."""
    asked, search_all = {}, models.search.successive_halving

    def cut_short(rows, label, candidates, staged, stages, **options):
        asked[staged.__name__] = candidates
        return search_all(rows, label, candidates[:8], staged, (2, 3), **options)

    monkeypatch.setattr(models.search, "successive_halving", cut_short)
    assert learning.QUERIES["selected_model_report"](spark, small).count() > 0
    assert learning.QUERIES["selected_network_report"](spark, small).count() > 0
    assert asked["StagedTrees"] == models.draw_tree_params(400)
    assert asked["StagedNetwork"] == models.draw_network_params(400)
    assert learning.TREE["maxIter"] >= 100 and learning.QUERIES["boosted_tree_report"](spark, small).count() > 0


def test_model_selection(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    part = np.where(np.arange(300) < 200, "train", np.where(np.arange(300) < 250, "val", "test"))
    df = spark.createDataFrame([(str(s), int(a), row.tolist()) for s, a, row in zip(part, y, x)],
                               "split string, y int, features array<double>")
    ranges = {**models.TREE_RANGES, "maxIter": (3, 5), "maxDepth": (2, 3)}
    model, trials = models.select_by_f1(df, "y", models.draw_tree_params(2, ranges=ranges), models.boosted_trees)
    assert trials.count() == 2
    scored = models.score(model, models.with_vector(df, "y"))
    got = {r.split: r for r in metrics.evaluate(scored, "split", "y", "predicted_proba").collect()}
    assert got["test"].auc > 0.8 and got["val"].f1 == pytest.approx(trials.agg(F.max("f1")).first()[0])
    model.write().overwrite().save(str(tmp_path / "model"))
    network = models.feed_forward({"units": [4], "maxIter": 40}, 3).fit(models.with_vector(df, "y"))
    assert models.validation_f1(network, models.with_vector(df.filter("split = 'val'"), "y")) > 0.8
    right = metrics.well_predicted(scored.withColumn("y", F.col("label").cast("int")), "y", "predicted_proba", ["split"])
    assert right.filter("true_label != predicted_label").count() == 0
    sinks.write_split_matrices(df, str(tmp_path / "matrices"))
    assert spark.read.parquet(str(tmp_path / "matrices")).filter("split = 'val'").count() == 50


@pytest.mark.parametrize("held", [10 ** 6, 1])
def test_lookup_deals_keys_of_many_rows_over_tasks(spark, monkeypatch, held):
    """customers of a nation met all its suppliers in one task."""
    monkeypatch.setattr(linking, "HELD_ROWS", held)
    monkeypatch.setattr(linking, "MATCHES", 10_000)
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 2 else f"k{i}") for i in range(1000)], "id int, k string")
    table = spark.createDataFrame([("hot", f"v{i}") for i in range(300)] + [("k2", "x"), (None, "none")], "key string, v string")
    out = linking.multimap_lookup(rows.coalesce(1), table, "k", "key", "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks would be put together here
    spread = out.select("k", F.spark_partition_id().alias("task")).where("k = 'hot'").groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.id, r.v) for r in out.select("id", "v").collect()}
    assert got == {(i, f"v{j}") for i in range(1, 1000, 2) for j in range(300)} | {
        (i, "x" if i == 2 else None) for i in range(0, 1000, 2)}
    assert out.count() == len(got) and len(spread) > 4 and max(r["count"] for r in spread) < 75_000


def test_expanding_lookup_is_written_in_runs(spark, tmp_path, monkeypatch):
    """customers met all suppliers of their nation in an order that left a code per row in the files."""
    monkeypatch.setattr(linking, "MATCHES", 400_000)
    rows = spark.range(4000).union(spark.createDataFrame([(-1,)] * 500, "id long")).withColumn(
        "k", F.when(F.col("id") < 3999, F.concat(F.lit("k"), F.pmod("id", F.lit(4)))))
    table = spark.range(2000).select(F.concat(F.lit("k"), F.pmod("id", F.lit(4))).alias("key"),
                                     F.concat(F.lit("value of "), "id").alias("v"))
    linking.multimap_lookup(rows, table, "k", "key", "v").select("id", "v").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    told = out.groupBy("id", "v").count().groupBy("count", F.col("v").isNull().alias("none")).agg(
        F.count("*").alias("pairs"), F.min("id"), F.max("id")).collect()
    assert sorted(map(tuple, told)) == [(1, False, 3999 * 500, 0, 3998), (1, True, 1, 3999, 3999), (500, False, 500, -1, -1)]
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.4 * (3999 * 500 + 250_001)
