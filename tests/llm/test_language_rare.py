from hearscore.llm import language


def test_rare_language_is_in_the_model(spark):
    ids = [r.id for r in spark.range(7000).orderBy(language.F.xxhash64("id")).collect()]
    rare = set(ids[-4:])  # no sample by the smallest hashes has them
    rows = [(i, "jotka ovat niin mutta kuin", "fi") if i in rare else (i, "the then there with this", "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, language.F.lit(True))
    assert model.langs == ["en", "fi"]
    found = language.identify(docs.filter("lang = 'fi'"), model).collect()
    assert [r.lang_pred for r in found] == ["fi"] * 4
