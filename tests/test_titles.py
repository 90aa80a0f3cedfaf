from hirelake.operators.titles import SENIOR_RULE, apply_rules, decide_titles


def test_rules_follow_their_order(spark):
    rules = spark.createDataFrame(
        [
            ("non_target", None, "senior", "(^|[^a-z])senior([^a-z]|$)", SENIOR_RULE, 10, True), ("non_target", None, "b", "bad", "second", 5, True), ("non_target", None, "bb", "bad", "longer", 5, True),
            ("target", "r", "engineer", "engineer", "for", 10, True), ("non_target", None, "off", "engineer", "off", 1, False),
        ],
        "rule_type string, canonical_role string, term string, regex_pattern string, decision_reason string, priority int, active boolean",
    )
    titles = spark.createDataFrame([("Senior Engineer",), ("senior product manager",), ("sr. project manager",), ("bad engineer",), ("engineer",), ("engineer",), ("エンジニア engineer",), ("",), (None,)], "normalized_title string")
    found = {r.normalized_title: tuple(r)[1:] for r in decide_titles(titles, rules).collect()}
    exception = ("target", "candidate_profile_track: product", "profile_target_pm_senior_exception")
    assert found == {
        "Senior Engineer": ("non_target", None, SENIOR_RULE), "senior product manager": exception, "sr. project manager": exception, "bad engineer": ("non_target", None, "longer"),
        "engineer": ("target", "r", "for"), "エンジニア engineer": ("non_target", None, "profile_non_us_language_signal"), "": ("review", None, "profile_no_rule_match"),
    }
    assert decide_titles(titles.limit(0), rules).count() == 0
    labels = spark.createDataFrame([("engineer", "review", None), ("bad engineer", "target", "manual-1"), ("Senior Engineer", "non_target", "x"), ("", "target", "x")], "normalized_title string, classification_status string, rule_version string")
    after = {r.normalized_title: (r.classification_status, r.previous_status) for r in apply_rules(labels, decide_titles(titles, rules)).collect()}
    assert after == {"engineer": ("target", "review"), "bad engineer": ("target", None), "Senior Engineer": ("non_target", None), "": ("target", None)}
