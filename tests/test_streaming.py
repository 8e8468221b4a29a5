"""A stream of words gives what a batch gives."""

from foliolens.streaming import ingest


def test_stream_matches_batch(spark, tmp_path):
    pages = {"a": ["DANFE Documento", "CNPJ 11.222.333/0001-81"], "b": ["DOCUMENTO AUXILIAR DE VENDA", "Total a pagar: 10,00"]}
    rows = [(p, i, 0.0, 30.0 * i, 400.0, 30.0 * i + 20, t) for p, texts in pages.items() for i, t in enumerate(texts)]
    words = spark.createDataFrame(rows, ingest.WORDS)
    words.where("page_id = 'a'").write.parquet(str(tmp_path / "in"))
    words.where("page_id = 'b'").write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest.start(ingest.word_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination(120)
    got = {r["page_id"]: (r["tipo"], r["cnpjs"], r["valores"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("DANFE", ["11.222.333/0001-81"], {}), "b": ("DAV", [], {"Total a pagar": 1000})}
    assert got == {r["page_id"]: (r["tipo"], r["cnpjs"], r["valores"]) for r in ingest.typed_pages(words).collect()}
