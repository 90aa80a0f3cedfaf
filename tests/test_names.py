from pyspark.sql import functions as F

from hirelake.functions import names


def test_titles_in_capitals(spark):
    cases = {
        "IT MANAGER II": "IT Manager II", "DIRECTOR OF (SQL) SYSTEMS": "Director of SQL() Systems", "[(QA LEAD": "QA([ Lead", "Mixed CASE": "Mixed CASE", "  A  B ": "A B", "THE END OF X": "The End of X",
        "123 - 4": "123 - 4", "": "", "É. ANALYST!!": "É. Analyst!!", "ENGINEER IIX - OF": "Engineer IIX - of",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", names.display_title(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_terms_of_names(spark):
    df = spark.createDataFrame([("Zürich Labs Inc / IBM (US)",), ("AT&T",), ("//",), (None,)], "name string")
    extra = spark.createDataFrame([("AT&T", "att", "prefix"), ("AT&T", "at-and-t", "prefix"), ("Gone", "x", "exact")], "name string, match_key string, match_kind string")
    found = sorted((r.name, r.match_key, r.match_kind, r.term_source) for r in names.match_terms(df, extra).collect())
    assert found == [
        ("AT&T", "at-and-t", "prefix", "brand"), ("AT&T", "att", "prefix", "manual_alias"), ("Zürich Labs Inc / IBM (US)", "ibm", "exact", "brand"),
        ("Zürich Labs Inc / IBM (US)", "zurich-labs", "prefix", "brand:stripped"), ("Zürich Labs Inc / IBM (US)", "zurich-labs-inc", "prefix", "brand"), ("Zürich Labs Inc / IBM (US)", "zurich-labs-inc-ibm-us", "prefix", "linkedin_name"),
    ]


def test_guessed_boards(spark):
    rows = [("Acme Rocket Works dba Foo", "https://careers.acme.io/x", None), ("Global Co", "https://jobs.newscorp.com", "hr"), (None, None, "www.idb.com"), ("Zed", "https://a.b", "zed-inc.com")]
    found = spark.createDataFrame(rows, "n string, u string, d string").select(names.slug_variants(F.col("n"), F.col("u"), F.col("d"), ("co",))).collect()
    assert [r[0] for r in found] == [["acmerocketworks", "acme-rocket-works", "acmerocket", "acme-rocket", "acme"], ["newscorp"], [], ["zed"]]


def test_best_mapping_of_a_title(spark):
    rows = [(2, "IT LEAD ", "15-1252", "SOFTWARE", "1,000", "5"), (1, "IT LEAD", "15-1252.00", "OTHER", None, "5"), (3, "IT LEAD", "15-1252", "LAST", "3", "4"), (4, "", "15-1252", "x", "1", "1"), (5, "T", "bad", "x", "1", "1")]
    df = spark.createDataFrame(rows, "row_number int, raw_job_title string, soc_code string, soc_title string, soc_count string, raw_count string")
    assert [tuple(r) for r in names.title_mappings(df).collect()] == [("IT LEAD", "15125200", "Other", 0, 5, "IT Lead")]
