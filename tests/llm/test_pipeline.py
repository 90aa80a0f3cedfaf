import corpus_pipeline as P
from hirelake.llm.queries import op1_simhash, op7_langid, op8_decontaminate
from tests.conftest import SMALL
from tests.llm.test_pii import base


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = [f for _, f in P.STAGES]
    known = stages[0](spark, docs, SMALL)
    identified = {r.doc_id for r in op7_langid(spark, SMALL).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == identified
    single = {r.doc_id for r in stages[1](spark, docs, SMALL).collect()}
    assert single == {r.component_id for r in op1_simhash(spark, SMALL).collect()}
    dirty = {r.doc_id for r in op8_decontaminate(spark, SMALL).collect()}
    assert {r.doc_id for r in stages[2](spark, docs, SMALL).collect()} == {r.doc_id for r in docs.collect()} - dirty
    redacted = stages[3](spark, docs, SMALL)
    assert redacted.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in redacted.collect():
        assert not base(r.text) and (base(texts[r.doc_id]) or r.text == texts[r.doc_id]) and r.n_chars == len(r.text)


def test_run_keeps_what_every_stage_keeps(spark):
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert 0 < out.count() < 200


def test_nulls_empty_texts_and_clashing_columns_pass_every_stage(spark):
    rows = [(k, t, lang, s, 3, "x") for k, (t, lang, s) in enumerate([("the small house is here", "en", "a"), (None, "en", None), ("", None, None), ("la petite maison est la", "fr", "a"), ("the small house is here", "en", "b"), ("mail to a@b.co or pay", None, "c")] * 4)]
    rows.append((None, "the house again", "en", None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cands string")
    for table in (df, df.limit(0)):
        for _, stage in P.STAGES[:-1]:
            table = stage(spark, table, SMALL)
            assert table.columns == df.columns
        out = P.STAGES[-1][1](spark, table, SMALL)
        assert "doc_id" in out.columns and out.count() == table.count()
