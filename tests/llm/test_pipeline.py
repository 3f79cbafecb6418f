import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorloom.llm import secrets, tokens


@pytest.fixture(scope="module")
def docs(spark):
    """Near copies, a repeated row, null and empty texts, a secret, null ids, a column that operators also use."""
    base = " ".join(f"word{k} and" for k in range(60))
    texts = [(1, base), (2, base.replace("word59", "edited")), (3, base + " token=abc123def"), (3, base + " token=abc123def"), (4, None), (5, ""), (None, base)]
    texts += [(6, "quite another text about rivers, lakes and hills with password: hunter2x"), (7, "the last of them says nothing of the kind at all")]
    rows = [(i, t, "en", f"s{k % 2}", len(t or ""), 9, "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality long, secrets string")


def _rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_quality_stage_keeps_rows_whole(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = docs.drop("secrets")
    got = corpus_pipeline.quality_stage(spark, plain, str(tmp_path))
    assert got.columns == plain.columns
    want, kept = _rows(plain, *plain.columns), _rows(got, *plain.columns)
    assert all(kept.count(r) in (0, want.count(r)) for r in kept) and all(r[1] for r in kept)


def test_secret_stage(spark, docs):
    plain, model = docs.drop("secrets"), secrets.fit_model()
    want = []
    for i, t, lang, source, n, q in (tuple(r) for r in plain.collect()):
        c = secrets.redact_text(t, secrets.find_spans(t, model)[1], "[SECRET]") if t else t
        want.append((i, c, lang, source, None if c is None else len(c), q))
    got = corpus_pipeline.secret_stage(spark, plain, "")
    assert _rows(got, *plain.columns) == sorted(want, key=repr) and not got.where(F.col("text").contains("hunter2x")).count()


def test_packing_stage(spark, docs):
    enc = tokens.encoder(tokens.default_tokenizer())
    want = sorted(((r.doc_id, len(enc.encode(r.text) + tokens.END_BYTES) // 4) for r in docs.collect()), key=repr)
    assert _rows(corpus_pipeline.packing_stage(spark, docs, ""), "doc_id", "length") == want
