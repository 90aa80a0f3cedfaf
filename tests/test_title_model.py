from hirelake.operators import title_model as M

LABELS = "normalized_title string, classification_status string"


def labels(spark):
    rows = [(f"senior java wizard {k}", "target") for k in range(6)] + [(f"night warehouse picker {k}", "non_target") for k in range(9)] + [("data engineer", "target"), ("data engineer helper", "non_target")]
    return spark.createDataFrame(rows, LABELS)


def test_exclusive_features_decide_alone(spark):
    asked = spark.createDataFrame([("java wizard",), ("warehouse picker",), ("java warehouse",), ("data engineer",), ("nothing known",)], "normalized_title string")
    found = {r.normalized_title: (r.predicted, r.confidence, r.evidence) for r in M.exclusive_predict(labels(spark), asked).collect()}
    assert found["java wizard"] == ("target", 0.995, "b:java_wizard, s:wizard, w:wizard, s:java, w:java")
    assert found["warehouse picker"] == ("non_target", 0.995, "b:warehouse_picker, s:warehouse, w:warehouse, w:picker, s:pick") or found["warehouse picker"][:2] == ("non_target", 0.995)
    assert found["java warehouse"] == ("non_target", 0.5, "") and found["data engineer"][1] == 0.5 and found["nothing known"] == ("non_target", 0.5, "")


def test_without_both_labels_nothing_is_known(spark):
    one = labels(spark).where("classification_status = 'target'")
    assert {(r.predicted, r.confidence, r.evidence) for r in M.exclusive_predict(one, one).collect()} == {("non_target", 0.5, "")}
    assert M.exclusive_predict(labels(spark), one.limit(0)).count() == 0


def test_evidence_is_bounded_and_ordered(spark):
    known = labels(spark)
    asked = spark.createDataFrame([("senior java wizard java", "target"), ("picker", "non_target"), ("?", "target")], "normalized_title string, predicted string")
    found = {r.normalized_title: r.evidence for r in M.nb_evidence(known, asked).collect()}
    assert found == {"senior java wizard java": "b:java_wizard, b:senior_java, w:java, w:senior, w:wizard", "picker": "w:picker", "?": None}


def test_variants_are_compared_on_held_out_titles(spark):
    rows = M.compare_variants(labels(spark)).collect()
    assert len(rows) == 9 * 2 * 6 and {r.variant for r in rows} == {*M.VARIANTS, "exclusive"}
    assert all((r.precision is None) == (r.selected == 0) and 0 <= r.recall <= 1 for r in rows)
    alone = {r.label: (r.precision, r.recall) for r in rows if r.variant == "exclusive" and r.threshold == 0.99}
    assert alone["target"][0] == 1.0 and alone["target"][1] > 0.8
